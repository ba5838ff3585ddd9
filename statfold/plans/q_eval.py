"""Classifier-evaluation queries (ML3-8, ML10-13, TOP2, AGG16, JOI5-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions import arrays
from statfold.functions.hashing import hash_uniform, sql_hash_uniform
from statfold.operators import evaluate
from statfold.plans.common import round_doubles
from statfold.plans.q_freq import USAGE, USAGE_SQL
from statfold.plans.registry import Tables, register
from statfold.sources import dataset, standins


def scored(spark, sf):
    """Binary labels (stand-in churn) with a tie-heavy score rounded to 2 decimals."""
    ch = standins.churn(Tables(spark, sf).lineitem)
    score = F.round(F.lit(0.6) * (F.col("age") - 17) / 50 + F.lit(0.4) * hash_uniform(8, "customer_id"), 2)
    return ch.select("customer_id", F.col("churn").alias("y"), score.alias("score"))


SCORED_SQL = f"""(SELECT customer_id, churn AS y,
  round(0.6 * (age - 17) / 50 + 0.4 * {sql_hash_uniform(8, 'customer_id')}, 2) AS score FROM {standins.churn_sql()})"""


def predicted(spark, sf):
    """Multi-class truth (embedding label) and a prediction that never says class 9."""
    e = Tables(spark, sf).embeddings
    head = F.slice("embedding", 1, 10)
    return e.select("vec_id", "label", F.least(arrays.argmax(head), F.lit(8)).alias("pred"))


PRED_SQL = """(SELECT vec_id, label, least(CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER), 8) AS pred
FROM embeddings)"""

CONF_SQL = f"""
WITH p AS {PRED_SQL},
     k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM p UNION SELECT pred FROM p)),
     cells AS (SELECT label, pred, count(*) AS n FROM p GROUP BY 1, 2),
     full_ AS (SELECT a.c AS label, b.c AS pred, coalesce(cells.n, 0) AS n FROM k a CROSS JOIN k b
               LEFT JOIN cells ON cells.label = a.c AND cells.pred = b.c)"""

PER_CLASS_SQL = CONF_SQL + """,
     pc AS (SELECT c AS cls, sum(n) FILTER (WHERE label = c AND pred = c) AS tp, sum(n) FILTER (WHERE label = c) AS support,
                   sum(n) FILTER (WHERE pred = c) AS predicted FROM full_, k GROUP BY c),
     pc2 AS (SELECT cls, tp, support, predicted,
                    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
     pc3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc2)"""


@register("ml3_cutoff", f"""
SELECT y, CAST(score > 0.5 AS INTEGER) AS pred, count(*) AS n FROM {SCORED_SQL} GROUP BY 1, 2
""")
def ml3_cutoff(spark, sf):
    s = scored(spark, sf).withColumn("pred", evaluate.cutoff("score", 0.5))
    return s.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def _auc_sql(score_expr: str) -> str:
    return f"""
WITH t AS (SELECT {score_expr} AS score, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED_SQL} GROUP BY 1),
     r AS (SELECT pos, neg, sum(pos + neg) OVER (ORDER BY score) - (pos + neg) + (pos + neg + 1) / 2.0 AS rank FROM t)
SELECT round((sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r"""


@register("ml4_no_skill", _auc_sql("0.0"))
def ml4_no_skill(spark, sf):
    s = scored(spark, sf).withColumn("score", F.lit(0.0))
    return round_doubles(evaluate.auc(s, "y", "score"), 6)


@register("ml5_confusion", CONF_SQL + """,
     rows_ AS (SELECT label, sum(n) AS r FROM full_ GROUP BY 1)
SELECT label, pred, CAST(n AS BIGINT) AS n, round(CASE WHEN r > 0 THEN n / r ELSE 0.0 END, 6) AS row_share
FROM full_ JOIN rows_ USING (label)
""")
def ml5_confusion(spark, sf):
    return round_doubles(evaluate.confusion(predicted(spark, sf), "label", "pred"), 6)


@register("ml6_classification_report", PER_CLASS_SQL + """
SELECT CAST(cls AS VARCHAR) AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pc3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc3
""")
def ml6_classification_report(spark, sf):
    return round_doubles(evaluate.classification_report(predicted(spark, sf), "label", "pred"), 6)


@register("ml7_accuracy", f"""
SELECT round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM {PRED_SQL}
""")
def ml7_accuracy(spark, sf):
    return round_doubles(evaluate.accuracy(predicted(spark, sf), "label", "pred"), 6)


@register("ml8_macro_micro", PER_CLASS_SQL + """
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(CASE WHEN avg(precision) + avg(recall) > 0 THEN 2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)) ELSE 0 END, 6) AS macro_f1_of_means,
       round(avg(f1), 6) AS macro_f1_mean, round(sum(tp) / sum(predicted), 6) AS micro_precision,
       round(sum(tp) / sum(support), 6) AS micro_recall,
       round(2 * (sum(tp) / sum(predicted)) * (sum(tp) / sum(support)) / (sum(tp) / sum(predicted) + sum(tp) / sum(support)), 6) AS micro_f1
FROM pc3
""")
def ml8_macro_micro(spark, sf):
    return round_doubles(evaluate.averaged_scores(predicted(spark, sf), "label", "pred"), 6)


_ROC_SQL = f"""
WITH t AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED_SQL} GROUP BY 1),
     c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
                  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM t)"""


@register("ml10_roc_curve", _ROC_SQL + """
SELECT score AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0, 0, 0
""")
def ml10_roc_curve(spark, sf):
    return round_doubles(evaluate.roc_curve(scored(spark, sf), "y", "score"), 6)


@register("ml10_auc", _auc_sql("score"))
def ml10_auc(spark, sf):
    return round_doubles(evaluate.auc(scored(spark, sf), "y", "score"), 6)


@register("ml10_roc_area", _ROC_SQL + """,
     pts AS (SELECT score AS threshold, fp / N AS fpr, tp / P AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0)
SELECT round(sum((fpr - px) * (tpr + py) / 2), 6) AS area
FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC) AS px, lag(tpr) OVER (ORDER BY threshold DESC) AS py FROM pts)
WHERE px IS NOT NULL
""")
def ml10_roc_area(spark, sf):
    roc = evaluate.roc_curve(scored(spark, sf), "y", "score")
    return round_doubles(evaluate.curve_area(roc, "fpr", "tpr"), 6)


@register("ml11_pr_curve", _ROC_SQL + """
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM c
UNION ALL SELECT 'inf'::DOUBLE, 1.0, 0.0
""")
def ml11_pr_curve(spark, sf):
    return round_doubles(evaluate.pr_curve(scored(spark, sf), "y", "score"), 6)


@register("ml11_pr_area", _ROC_SQL + """,
     pts AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM c UNION ALL SELECT 'inf'::DOUBLE, 1.0, 0.0)
SELECT round(sum((recall - px) * (precision + py) / 2), 6) AS area
FROM (SELECT recall, precision, lag(recall) OVER (ORDER BY threshold DESC) AS px, lag(precision) OVER (ORDER BY threshold DESC) AS py FROM pts)
WHERE px IS NOT NULL
""")
def ml11_pr_area(spark, sf):
    pr = evaluate.pr_curve(scored(spark, sf), "y", "score")
    return round_doubles(evaluate.curve_area(pr, "recall", "precision"), 6)


@register("ml12_matthews", PER_CLASS_SQL + """
SELECT round(CASE WHEN d > 0 THEN num / d ELSE 0 END, 6) AS mcc FROM (
  SELECT sum(tp) * sum(support) - sum(predicted * support) AS num,
         sqrt(CAST(sum(support) * sum(support) - sum(predicted * predicted) AS DOUBLE)) *
         sqrt(CAST(sum(support) * sum(support) - sum(support * support) AS DOUBLE)) AS d FROM pc3)
""")
def ml12_matthews(spark, sf):
    return round_doubles(evaluate.matthews(predicted(spark, sf), "label", "pred"), 6)


@register("ml13_compare_distributions", f"""
SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM
  (SELECT label, count(*) AS n FROM embeddings WHERE {sql_hash_uniform(3, 'vec_id')} < 0.8 GROUP BY 1) a
  FULL JOIN (SELECT label, count(*) AS n FROM embeddings WHERE {sql_hash_uniform(3, 'vec_id')} >= 0.8 GROUP BY 1) b
  ON a.label = b.label
""")
def ml13_compare_distributions(spark, sf):
    e = Tables(spark, sf).embeddings
    u = hash_uniform(3, "vec_id")
    return evaluate.compare_distributions(e.where(u < 0.8), e.where(u >= 0.8), "label")


@register("top2_topk_accuracy", "SELECT " + ", ".join(
    f"round(avg(CAST(rnk <= {k} AS DOUBLE)), 6) AS top{k}" for k in range(1, 8)) + """
FROM (SELECT 1 + len(list_filter(range(10), lambda i: h[i + 1] > h[label + 1] OR (h[i + 1] = h[label + 1] AND i > label))) AS rnk
      FROM (SELECT label, embedding[1:10] AS h FROM embeddings))
""")
def top2_topk_accuracy(spark, sf):
    e = Tables(spark, sf).embeddings.select("label", F.slice("embedding", 1, 10).alias("h"))
    return round_doubles(evaluate.topk_accuracy(e, "label", "h"), 6)


@register("agg16_batch_accuracy", f"""
SELECT round(avg(acc), 6) AS mean_batch_accuracy, round(sum(hit) / sum(n), 6) AS overall_accuracy, count(*) AS batches
FROM (SELECT b, avg(CAST(label = pred AS DOUBLE)) AS acc, sum(CAST(label = pred AS INTEGER)) AS hit, count(*) AS n
      FROM (SELECT label, pred, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS b FROM {PRED_SQL}) GROUP BY b)
""")
def agg16_batch_accuracy(spark, sf):
    return round_doubles(evaluate.batch_accuracy(predicted(spark, sf), "label", "pred", "vec_id", 32), 6)


@register("joi5_align_predictions", f"""
SELECT e.vec_id, e.label, p.pred FROM embeddings e JOIN {PRED_SQL} p ON e.vec_id = p.vec_id
""")
def joi5_align_predictions(spark, sf):
    p = predicted(spark, sf)
    truth = Tables(spark, sf).embeddings.select("vec_id", "label")
    return evaluate.align_predictions(truth, p.select("vec_id", "pred"), "vec_id")


@register("joi6_append_batches", f"""
SELECT vec_id, pred, {USAGE_SQL} AS usage FROM {PRED_SQL}
""")
def joi6_append_batches(spark, sf):
    # predictions made frame by frame (Training / PublicTest / PrivateTest), appended into one table
    p = dataset.with_hash_split(predicted(spark, sf).select("vec_id", "pred"), "vec_id", USAGE, 11, "usage")
    return evaluate.append_batches([p.where(F.col("usage") == name) for name, _ in USAGE])
