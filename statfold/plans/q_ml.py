"""Model queries (REG8, REG10-11, ML1-2, ML14-17, SNK1, UDF*) and file sources (SRC1, SRC3-4, SRC8)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from statfold.operators import evaluate, freq, glm, sampling, score, trees
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register
from statfold.session import scratch_path
from statfold.sources import archives, dataset, files, standins

CHURN_TERMS = ["credit_score", "C(country)", "C(gender)", "age", "tenure", "balance", "products_number",
               "credit_card", "active_member", "estimated_salary"]


def _churn(spark, sf):
    return standins.churn(Tables(spark, sf).lineitem)


@register("reg10_glm_binomial")
def reg10_glm_binomial(spark, sf):
    coef, _, _, _ = glm.glm(_churn(spark, sf), "churn", CHURN_TERMS, "binomial")
    return coef


@register("reg10_glm_gaussian_model")
def reg10_glm_gaussian_model(spark, sf):
    _, model_row, _, _ = glm.glm(_churn(spark, sf), "churn", ["age", "balance"], "gaussian")
    return model_row


@register("reg11_wald_intervals")
def reg11_wald_intervals(spark, sf):
    coef, _, _, _ = glm.glm(_churn(spark, sf), "churn", ["age", "balance", "C(country)"], "binomial")
    return coef.select("term", "estimate", "wald_lo", "wald_hi")


# The five compared feature lists of the churn study (models 1-5).
MODEL_TERMS = {
    "model1": ["age", "balance"],
    "model2": ["credit_card", "age", "balance"],
    "model3": ["credit_score", "age", "tenure", "balance", "estimated_salary"],
    "model4": ["credit_score", "C(country)", "C(gender)", "age", "tenure", "balance", "estimated_salary"],
    "model5": ["credit_score", "C(country)", "C(gender)", "age", "tenure", "balance", "active_member",
               "estimated_salary"],
}


@register("ml14_compare_models")
def ml14_compare_models(spark, sf):
    return glm.compare_models(_churn(spark, sf), "churn", MODEL_TERMS, "gaussian")


@register("ml2_logistic")
def ml2_logistic(spark, sf):
    ex = sampling.exact_split(standins.exam(Tables(spark, sf).lineitem), "id", 0.2, 42)
    feats = ["lsat", "ugpa", "gpa"]
    model, _ = glm.logistic(ex.where(F.col("split") == "train"), feats, "pass_bar", C=1.0)
    test = glm.logistic_scores(model, ex.where(F.col("split") == "test"), feats, "pass_bar", 0.5)
    acc = evaluate.accuracy(test, "y", "pred")
    auc = evaluate.auc(test, "y", "p")
    return acc.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("ml1_random_forest")
def ml1_random_forest(spark, sf):
    ev = Tables(spark, sf).events
    feats = ev.select("event_id", "event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
                      F.hour("ts").alias("hour"), F.col("user_id").cast("double").alias("user"), "value",
                      F.get_json_object("props", "$.k").cast("double").alias("k"))
    split = sampling.exact_split(feats, "event_id", 0.2, 42)
    model = trees.random_forest(split.where(F.col("split") == "train"), ["day", "hour", "user", "value", "k"],
                                "event_type", 100, 42)
    pred = model.transform(split.where(F.col("split") == "test"))
    return evaluate.accuracy(pred, "_label", "prediction")


_EXAM_FEATURES = ["ugpa", "gpa", "fam_inc", "tier"]


@register("reg8_first_split", f"""
WITH t AS (
  SELECT l_extendedprice / 1000 AS lsat, l_discount * 40 AS ugpa, l_tax * 50 + l_discount * 10 AS gpa,
         l_linenumber::DOUBLE AS fam_inc, (l_partkey % 6 + 1)::DOUBLE AS tier
  FROM lineitem),
m AS (SELECT avg(lsat) AS mean, count(*) AS rows FROM t),
runs AS (
  SELECT f, v, count(*) AS n, sum(y) AS s FROM (
    {" UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, lsat - mean AS y FROM t, m" for i, c in enumerate(_EXAM_FEATURES))})
  GROUP BY f, v),
c AS (
  SELECT f, (v + lead(v) OVER w) / 2 AS threshold, v, sum(n) OVER w AS ln, sum(s) OVER w AS ls,
         sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
  FROM runs WINDOW w AS (PARTITION BY f ORDER BY v)),
g AS (
  SELECT *, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain
  FROM c, m WHERE ln >= ceil(0.1 * rows) AND n - ln >= ceil(0.1 * rows))
SELECT ['ugpa', 'gpa', 'fam_inc', 'tier'][f + 1] AS feature, round(threshold, 6) AS threshold, ln::BIGINT AS n_left,
       (n - ln)::BIGINT AS n_right, round(gain, 3) AS gain
FROM g ORDER BY gain DESC, f, v LIMIT 1
""")
def reg8_first_split(spark, sf):
    tree = trees.regression_tree(standins.exam(Tables(spark, sf).lineitem), _EXAM_FEATURES, "lsat", 1, 0.1)
    top = tree.frame(spark)
    sides = top.where("depth = 1").agg(F.min_by("n", "node").alias("n_left"), F.max_by("n", "node").alias("n_right"))
    return top.where("depth = 0").join(sides).select("feature", F.round("threshold", 6).alias("threshold"), "n_left",
                                                     "n_right", F.round("gain", 3).alias("gain"))


@register("reg8_regression_tree")
def reg8_regression_tree(spark, sf):
    ex = sampling.exact_split(standins.exam(Tables(spark, sf).lineitem), "id", 0.2, 42)
    model = trees.regression_tree(ex.where(F.col("split") == "train"), _EXAM_FEATURES, "lsat", 4, 0.1)
    pred = model.transform(ex.where(F.col("split") == "test"))
    from statfold.operators.linear import mse
    return mse(pred, "lsat", "prediction")


def _emb_split(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", "embedding", "label")
    return sampling.exact_split(e, "vec_id", 0.2, 42)


@register("ml15_weighted_multiclass")
def ml15_weighted_multiclass(spark, sf):
    s = _emb_split(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    weights = freq.class_weights(train, "label")
    model = score.weighted_multiclass(train, "embedding", "label", weights)
    pred = model.transform(test.withColumn("_features", array_to_vector(F.col("embedding").cast("array<double>"))))
    return evaluate.accuracy(pred.withColumn("prediction", F.col("prediction").cast("int")), "label", "prediction")


@register("ml16_batch_scoring")
def ml16_batch_scoring(spark, sf):
    from statfold.plans.q_freq import EMOTIONS
    s = _emb_split(spark, sf)
    model = score.weighted_multiclass(s.where(F.col("split") == "train"), "embedding", "label")
    coef = model.coefficientMatrix.toArray()
    icpt = model.interceptVector.toArray()
    predictor = score.linear_softmax_udf(coef, icpt)
    scored = score.score_batches(s.where(F.col("split") == "test"), "embedding", predictor, EMOTIONS)
    return scored.groupBy("predicted_class", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def _docs_labelled(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    return dataset.with_hash_split(d, "doc_id", (("train", 0.8), ("test", 0.2)))


@register("ml17_text_classifier")
def ml17_text_classifier(spark, sf):
    d = _docs_labelled(spark, sf).withColumn("quality", F.col("quality").cast("double"))
    model = score.text_classifier(d.where(F.col("split") == "train"), "text", "quality", 1 << 16, 0.01)
    pred = model.transform(d.where(F.col("split") == "test"))
    return evaluate.accuracy(pred, "quality", "prediction")


@register("snk1_save_reload_model")
def snk1_save_reload_model(spark, sf):
    d = _docs_labelled(spark, sf).withColumn("quality", F.col("quality").cast("double"))
    model = score.text_classifier(d.where(F.col("split") == "train"), "text", "quality", 1 << 12, 0.01)
    path = scratch_path(spark, "model")
    score.save_model(model, path)
    again = score.load_pipeline(path)
    a = model.transform(d).select("doc_id", F.col("prediction").alias("p1"))
    b = again.transform(d).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p1") == F.col("p2")).cast("long")).alias("same"))


@register("udf1_batched_map", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def udf1_batched_map(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", "text")
    return score.batched_map(docs, lambda pdf: pdf.assign(n_chars=pdf["text"].str.len().astype("int64"))[["doc_id", "n_chars"]],
                             "doc_id long, n_chars long")


@register("udf2_row_predicate", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 1000")
def udf2_row_predicate(spark, sf):
    d = Tables(spark, sf).documents
    return d.where(F.col("text").isNotNull() & (F.length("text") > 1000)).select("doc_id")


@register("udf5_pie_labels", """
SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       printf('%d (%.1f%%)', count(*), 100.0 * count(*) / sum(count(*)) OVER ()) AS pie_label
FROM orders GROUP BY 1
""")
def udf5_pie_labels(spark, sf):
    rel = freq.relative_counts(Tables(spark, sf).orders, "o_orderpriority")
    return round_doubles(score.pie_labels(rel), 6)


# ---------------------------------------------------------------- sources and sinks

_NA_SQL = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS c_name, round(c_acctbal, 4) AS c_acctbal FROM customer"""


@register("src1_read_csv_na", _NA_SQL)
def src1_read_csv_na(spark, sf):
    c = Tables(spark, sf).customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("c_name"), "c_acctbal")
    path = scratch_path(spark, "csv")
    c.write.mode("overwrite").option("header", True).csv(path)
    back = files.read_csv(spark, path)
    return round_doubles(back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", "c_name",
                                     F.col("c_acctbal").cast("double").alias("c_acctbal")))


@register("src3_parquet_roundtrip", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def src3_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "parquet")
    dataset.save_table(Tables(spark, sf).documents.select("doc_id", "lang", "n_chars"), path)
    back = dataset.load_table(spark, path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("src8_partitioned_subsets", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def src8_partitioned_subsets(spark, sf):
    path = scratch_path(spark, "subsets")
    dataset.save_table(Tables(spark, sf).documents.select("doc_id", "lang"), path, partition_by=["lang"])
    back = dataset.read_dataset(spark, path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("src4_document_files", "SELECT page_id, md5(html) AS text_md5 FROM pages")
def src4_document_files(spark, sf):
    path = scratch_path(spark, "docs")
    folders = files.write_documents(Tables(spark, sf).pages, path, "page_id", "html")
    docs = files.read_documents(spark, folders, "*.txt")
    return docs.where(~F.col("rejected")).select(
        F.regexp_extract("path", r"page_id=([0-9]+)", 1).try_cast("long").alias("page_id"),
        F.md5(F.regexp_replace("text", r"\n$", "")).alias("text_md5"))


@register("src4_document_archives", """
SELECT page_id, octet_length(encode(html)) AS bytes, md5(html) AS text_md5 FROM pages
""")
def src4_document_archives(spark, sf):
    path = scratch_path(spark, "archives")
    pages = Tables(spark, sf).pages.select(F.concat(F.lit("page/"), F.col("page_id"), F.lit(".html")).alias("name"), "html")
    archives.write_archives(pages, path, "name", "html")
    docs = archives.read_archives(spark, path)
    return docs.where(~F.col("rejected")).select(
        F.regexp_extract("member", r"^page/([0-9]+)\.html$", 1).cast("long").alias("page_id"), "bytes",
        F.md5("text").alias("text_md5"))


@register("udf3_model_callable")
def udf3_model_callable(spark, sf):
    """A user model per batch: nearest class centroid (centroids from a Spark aggregate)."""
    from statfold.plans.q_freq import EMOTIONS
    s = _emb_split(spark, sf)
    train = s.where(F.col("split") == "train")
    dim = len(train.select("embedding").first()[0])
    cents = (train.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
             .groupBy("label", "j").agg(F.avg("x").alias("m")).collect())
    labels = sorted({r["label"] for r in cents})
    c = np.zeros((len(labels), dim))
    for r in cents:
        c[labels.index(r["label"]), r["j"]] = r["m"]
    # logits = -||x - c||^2 = 2 x.c - |c|^2 - |x|^2; the |x|^2 term does not change the arg-max
    predictor = score.linear_softmax_udf(2 * c, -(c * c).sum(axis=1))
    scored = score.score_batches(s.where(F.col("split") == "test"), "embedding", predictor,
                                 {i: EMOTIONS.get(lbl, str(lbl)) for i, lbl in enumerate(labels)})
    return evaluate.accuracy(scored.withColumn("pred", F.element_at(F.array(*[F.lit(v) for v in labels]),
                                                                    F.col("predicted_class") + 1)), "label", "pred")


@register("udf4_metric_callback")
def udf4_metric_callback(spark, sf):
    """Metric callback on (predictions, labels): the ML8 function applied to a cut-off classifier."""
    from statfold.plans.q_eval import scored
    s = scored(spark, sf).withColumn("pred", evaluate.cutoff("score", 0.5))
    return evaluate.averaged_scores(s, "y", "pred")
