import math

import pytest
from pyspark.sql import functions as F

from statfold.functions import dist
from statfold.operators import stats


def _table(spark, counts):
    rows = []
    for (a, b), n in counts.items():
        rows += [(a, b)] * n
    return spark.createDataFrame(rows, "a string, b string")


def test_chi_square_2x2_yates_and_plain(spark):
    df = _table(spark, {("x", "u"): 10, ("x", "v"): 20, ("y", "u"): 25, ("y", "v"): 12})
    yates = stats.chi_square_p(df, "a", "b", correction=True).first()
    plain = stats.chi_square(df, "a", "b", correction=False).first()
    assert yates["statistic"] == pytest.approx(6.4705, abs=1e-4)
    assert plain["statistic"] == pytest.approx(7.7822, abs=1e-4)
    assert plain["df"] == 1
    assert dist.chi2_sf(plain["statistic"], 1) == pytest.approx(0.0053, abs=1e-4)
    assert yates["reject"]


def test_distribution_functions():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert dist.f_sf(3.0, 2, 20) == pytest.approx(0.07252, abs=1e-4)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)


def test_population_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = stats.moments(df, "x").first()
    assert r["skew"] == pytest.approx(1.01823, abs=1e-5)
    assert r["kurtosis"] == pytest.approx(-0.7696, abs=1e-4)


def test_anova_three_groups(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0)] + [("c", v) for v in (7.0, 8.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    out = {r["term"]: r for r in stats.anova_oneway(df, ["y"], ["g"]).collect()}
    assert out["C(g)"]["sum_sq"] == pytest.approx(54.0)
    assert out["Residual"]["sum_sq"] == pytest.approx(6.0)
    assert out["C(g)"]["F"] == pytest.approx(27.0)


def test_t_interval_and_correlation_test(spark):
    df = spark.createDataFrame([(float(x), float(2 * x + (x % 3))) for x in range(1, 21)], "x double, y double")
    t = stats.t_interval(df, "x", 0.95).first()
    assert t["t"] == pytest.approx(10.5 / (math.sqrt(35.0) / math.sqrt(20)), rel=1e-9)
    assert t["lower"] < 10.5 < t["upper"]
    c = stats.correlation_test_p(df, "x", "y").first()
    assert c["df"] == 18 and c["lower"] < c["r"] < c["upper"] and c["p_value"] < 1e-6


def test_shapiro_normal_vs_skewed(spark):
    from statistics import NormalDist
    nd = NormalDist()
    normal = spark.createDataFrame([(nd.inv_cdf((i + 0.5) / 200),) for i in range(200)], "x double")
    skewed = spark.createDataFrame([(math.exp(nd.inv_cdf((i + 0.5) / 200) * 1.5),) for i in range(200)], "x double")
    w_n = stats.shapiro_wilk(normal, "x").first()
    w_s = stats.shapiro_wilk(skewed, "x").first()
    assert w_n["W"] > 0.99 and w_n["p_value"] > 0.5
    assert w_s["W"] < 0.8 and w_s["p_value"] < 1e-6


def test_ols_residuals_feed_qq_and_shapiro(spark):
    from statfold.operators import linear, stats
    from statfold.operators.diag import qq_points
    rows = [(float(i), float(i % 7), 2.0 + 0.5 * i + (i % 7) + ((i * 7919) % 13 - 6) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    _, _, d, res = linear.ols(df, "y", ["a", "b"])
    e = linear.residuals(d, res)
    total = e.agg(F.sum("resid").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert abs(total["s"]) < 1e-6 and total["n"] == 300
    qq = qq_points(e, "resid")
    assert qq.count() == 300
    w = stats.shapiro_wilk(e, "resid").first()
    assert 0.0 < w["W"] <= 1.0


def test_levels_of_several_columns_in_one_pass(spark):
    from statfold.operators.profile import distinct_levels as _levels
    df = spark.createDataFrame([(10, "b", 1.5), (2, "a", None), (10, None, 0.5), (None, "c", 1.5)],
                               "i int, s string, d double")
    got = _levels(df, ["i", "s", "d"])
    assert got == {"i": [2, 10], "s": ["a", "b", "c"], "d": [0.5, 1.5]}
    with pytest.raises(ValueError):
        _levels(df, ["s", "i"], max_levels=2)
