"""Linear-model, PCA and clustering queries (REG*, TST5-6, PCA*, CLU1, WIN5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.operators import gram, linear, reduce, sampling, stats
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register
from statfold.sources import standins

EXAM_TERMS = ["ugpa", "C(race1)", "C(tier)", "gpa"]
CHURN_NUM = ["credit_score", "age", "tenure", "balance", "products_number", "credit_card", "active_member",
             "estimated_salary"]


def _exam(spark, sf):
    return standins.exam(Tables(spark, sf).lineitem)


def _churn(spark, sf):
    return standins.churn(Tables(spark, sf).lineitem)


@register("reg1_simple_ols", """
SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem
""")
def reg1_simple_ols(spark, sf):
    coef, model, _, res = linear.ols(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity"])
    out = model.select(F.col("n").cast("long").alias("n"), F.lit(res.intercept).alias("intercept"),
                       F.lit(res.beta["_x0"]).alias("slope"), F.col("r2"))
    return out.select("n", F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"),
                      F.round("r2", 6).alias("r2"))


@register("reg1_ols_coefficients")
def reg1_ols_coefficients(spark, sf):
    coef, _, _, _ = linear.ols(_exam(spark, sf), "lsat", EXAM_TERMS)
    return coef


@register("reg1_ols_model")
def reg1_ols_model(spark, sf):
    ex = _exam(spark, sf)
    _, model, d, res = linear.ols(ex, "lsat", EXAM_TERMS)
    return model


@register("reg1_residual_diagnostics")
def reg1_residual_diagnostics(spark, sf):
    _, _, d, res = linear.ols(_exam(spark, sf), "lsat", EXAM_TERMS)
    return linear.residual_diagnostics(d, res, None)


@register("reg2_design_matrix", f"""
SELECT customer_id, CAST(country = 'Germany' AS DOUBLE) AS "C(country)[T.Germany]",
       CAST(country = 'Spain' AS DOUBLE) AS "C(country)[T.Spain]", CAST(age AS DOUBLE) AS age,
       CAST(gender = 'Male' AS DOUBLE) AS "C(gender)[T.Male]"
FROM {standins.churn_sql()}
""")
def reg2_design_matrix(spark, sf):
    ch = _churn(spark, sf)
    d = linear.design(ch, "churn", ["customer_id", "C(country)", "age", "C(gender)"])
    return d.frame.select(F.col(d.columns[0]).cast("long").alias("customer_id"),
                          *[F.col(c).alias(lbl) for c, lbl in zip(d.columns[1:], d.labels[1:])])


@register("reg3_confint")
def reg3_confint(spark, sf):
    coef, _, _, _ = linear.ols(_churn(spark, sf), "churn", ["C(country)", "age", "C(gender)"])
    return coef.select("term", "coef", "ci_lo", "ci_hi")


@register("reg4_linear_mllib")
def reg4_linear_mllib(spark, sf):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    ex = sampling.exact_split(_exam(spark, sf), "id", 0.25, 42)
    vec = VectorAssembler(inputCols=["ugpa", "gpa", "fam_inc", "tier"], outputCol="features").transform(ex)
    train, test = vec.where(F.col("split") == "train"), vec.where(F.col("split") == "test")
    model = LinearRegression(featuresCol="features", labelCol="lsat", regParam=0.0, solver="normal").fit(train)
    r2 = RegressionEvaluator(labelCol="lsat", metricName="r2").evaluate(model.transform(test))
    return spark.createDataFrame([(float(model.intercept), [float(v) for v in model.coefficients], float(r2))],
                                 "intercept double, coef array<double>, test_r2 double")


def _exam_folds(spark, sf, k=10):
    ex = sampling.kfold(_exam(spark, sf), "id", k, "shuffled", 42)
    cols = ["ugpa", "gpa", "fam_inc", "tier", "lsat"]
    return gram.moments_by(ex, cols, "fold")


@register("reg5_cv_linear")
def reg5_cv_linear(spark, sf):
    folds = _exam_folds(spark, sf)
    return spark.createDataFrame(linear.cv_linear(folds, ["ugpa", "gpa", "fam_inc", "tier"], "lsat"))


@register("reg6_lasso_cv")
def reg6_lasso_cv(spark, sf):
    folds = _exam_folds(spark, sf, 5)
    path, best = linear.lasso_cv(folds, ["ugpa", "gpa", "fam_inc", "tier"], "lsat", n_alphas=30)
    out = spark.createDataFrame(path)
    return out.withColumn("chosen", F.col("alpha") == F.lit(best["alpha"]))


@register("reg7_ridge_cv")
def reg7_ridge_cv(spark, sf):
    ex = _exam(spark, sf)
    xs = ["ugpa", "gpa", "fam_inc", "tier"]
    frame = ex.select(*[F.col(c).cast("double").alias(c) for c in xs + ["lsat"]])
    m = gram.moments(frame, xs + ["lsat"])
    return spark.createDataFrame(linear.ridge_loo(frame, m, xs, "lsat", (0.1, 1.0, 10.0)))


@register("reg9_mse", """
SELECT round(avg(power(l_extendedprice - (a + b * l_quantity), 2)), 2) AS mse,
       round(sqrt(avg(power(l_extendedprice - (a + b * l_quantity), 2))), 4) AS rmse
FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
""")
def reg9_mse(spark, sf):
    li = Tables(spark, sf).lineitem
    _, _, _, res = linear.ols(li, "l_extendedprice", ["l_quantity"])
    pred = li.withColumn("pred", F.lit(res.intercept) + F.lit(res.beta["_x0"]) * F.col("l_quantity"))
    out = linear.mse(pred, "l_extendedprice", "pred")
    return out.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))


@register("reg13_pcr_cv")
def reg13_pcr_cv(spark, sf):
    ex = sampling.exact_split(_exam(spark, sf), "id", 0.25, 42)
    train = sampling.kfold(ex.where(F.col("split") == "train").drop("split"), "id", 10, "shuffled", 42)
    table, _, model = reduce.pcr_cv(train, ["ugpa", "gpa", "fam_inc", "tier", "fulltime"], "lsat", "fold",
                                    test=ex.where(F.col("split") == "test"))
    out = spark.createDataFrame(table).withColumn("chosen", F.col("k") == F.lit(model.k))
    return out.withColumn("test_rmse", F.when(F.col("chosen"), F.lit(model.test_rmse).cast("double")))


@register("reg14_best_subsets")
def reg14_best_subsets(spark, sf):
    ch = _churn(spark, sf)
    m = gram.moments(ch, CHURN_NUM + ["churn"])
    out = linear.best_subsets(m, CHURN_NUM, "churn", "exhaustive")
    return spark.createDataFrame(out)


def _small_subsets_sql() -> str:
    """R2 of every single variable and pair from correlations, and the best of either size."""
    corr = ", ".join(f"corr({a}, {b}) AS r{i}_{j}" for i, a in enumerate(CHURN_NUM) for j, b in enumerate(CHURN_NUM) if i < j)
    corr += ", " + ", ".join(f"corr({a}, churn) AS y{i}" for i, a in enumerate(CHURN_NUM))
    ways = [f"SELECT 1 AS size, '{a}' AS variables, y{i} * y{i} AS r2 FROM c" for i, a in enumerate(CHURN_NUM)]
    ways += [f"SELECT 2, '{a},{b}', (y{i} * y{i} + y{j} * y{j} - 2 * y{i} * y{j} * r{i}_{j}) / (1 - r{i}_{j} * r{i}_{j}) FROM c"
             for i, a in enumerate(CHURN_NUM) for j, b in enumerate(CHURN_NUM) if i < j]
    return f"""WITH c AS (SELECT {corr} FROM {standins.churn_sql()}), w AS ({' UNION ALL '.join(ways)})
SELECT CAST(size AS BIGINT) AS size, variables, round(r2, 8) AS r2 FROM w
QUALIFY row_number() OVER (PARTITION BY size ORDER BY r2 DESC) = 1"""


@register("reg14_small_subsets", _small_subsets_sql())
def reg14_small_subsets(spark, sf):
    m = gram.moments(_churn(spark, sf), CHURN_NUM + ["churn"])
    out = linear.best_subsets(m, CHURN_NUM, "churn", "exhaustive", nvmax=2)[["size", "variables", "r2"]]
    return round_doubles(spark.createDataFrame(out), 8)


@register("reg14_forward_backward")
def reg14_forward_backward(spark, sf):
    ch = _churn(spark, sf)
    m = gram.moments(ch, CHURN_NUM + ["churn"])
    parts = []
    for method in ("forward", "backward", "seqrep"):
        t = linear.best_subsets(m, CHURN_NUM, "churn", method)
        t.insert(0, "method", method)
        parts.append(t)
    import pandas as pd
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


@register("tst5_anova_type2")
def tst5_anova_type2(spark, sf):
    ex = _exam(spark, sf)
    d = linear.design(ex, "lsat", EXAM_TERMS)
    m = gram.moments(d.frame, d.columns + [d.y])
    res = linear.ols_from_moments(m, d.columns, d.y, dict(zip(d.columns, d.labels)))
    return spark.createDataFrame(linear.anova_type2(m, d, res))


@register("tst6_overall_f")
def tst6_overall_f(spark, sf):
    _, model, _, _ = linear.ols(_exam(spark, sf), "lsat", EXAM_TERMS)
    return model.select("f_stat", "f_p_value", "df_model", "df_resid")


@register("pca1_summary")
def pca1_summary(spark, sf):
    p = reduce.pca(_churn(spark, sf), CHURN_NUM, scale=True)
    return spark.createDataFrame(p.summary())


@register("pca1_loadings")
def pca1_loadings(spark, sf):
    p = reduce.pca(_churn(spark, sf), CHURN_NUM, scale=True)
    return spark.createDataFrame(p.loadings())


@register("pca2_scores")
def pca2_scores(spark, sf):
    ch = sampling.exact_split(_churn(spark, sf), "customer_id", 0.3, 42)
    train = ch.where(F.col("split") == "train")
    p = reduce.pca(train, CHURN_NUM, scale=True)
    return ch.select("customer_id", "split", *p.score_columns(4))


@register("clu1_kmeans")
def clu1_kmeans(spark, sf):
    ex = _exam(spark, sf)
    _, centers, cost = reduce.kmeans_best_of(ex, ["lsat", "ugpa", "gpa"], k=2, restarts=10, seed=1)
    centers["cost"] = cost
    return spark.createDataFrame(centers)


@register("win5_lagged_diff", """
SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), 4) AS diff FROM orders
""")
def win5_lagged_diff(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    out = linear.lagged_differences(o, "o_totalprice", ["o_orderkey"], "diff")
    return round_doubles(out.select("o_orderkey", "diff"))


@register("win5_durbin_watson")
def win5_durbin_watson(spark, sf):
    ex = _exam(spark, sf)
    _, _, d, res = linear.ols(ex, "lsat", ["ugpa", "gpa"])
    e = ex.select("id", (F.col("lsat") - (F.lit(res.intercept) + F.lit(res.beta["_x0"]) * F.col("ugpa")
                                            + F.lit(res.beta["_x1"]) * F.col("gpa"))).alias("e"))
    return spark.createDataFrame([(linear.durbin_watson(e, "e", "id"),)], "durbin_watson double")


@register("reg15_qq_points")
def reg15_qq_points(spark, sf):
    from statfold.operators.diag import qq_points
    return qq_points(Tables(spark, sf).customer, "c_acctbal")


@register("reg15_qq_residuals")
def reg15_qq_residuals(spark, sf):
    """``sm.qqplot(ols.resid, line='s')``: QQ points of the exam model's residuals."""
    from statfold.operators.diag import qq_points
    _, _, d, res = linear.ols(_exam(spark, sf), "lsat", EXAM_TERMS)
    return qq_points(linear.residuals(d, res), "resid")


@register("tst11_shapiro_wilk_residuals")
def tst11_shapiro_wilk_residuals(spark, sf):
    """``stats.shapiro(ols.resid)`` on the exam model's residuals."""
    _, _, d, res = linear.ols(_exam(spark, sf), "lsat", EXAM_TERMS)
    return stats.shapiro_wilk(linear.residuals(d, res), "resid")


@register("reg12_profile_intervals")
def reg12_profile_intervals(spark, sf):
    from statfold.operators.diag import profile_intervals
    return profile_intervals(_churn(spark, sf), "churn", ["age", "active_member"], "binomial")
