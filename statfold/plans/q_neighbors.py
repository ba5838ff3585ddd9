"""Nearest-neighbour queries (ML9, JOI4, BAL2) on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions.hashing import sql_hash_uniform
from statfold.operators import neighbors, sampling
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register

CLASSES = list(range(10))


def _split(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", "embedding", "label")
    return sampling.exact_split(e, "vec_id", 0.2, 42)


_SPLIT_SQL = f"""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label,
                  CASE WHEN row_number() OVER (ORDER BY {sql_hash_uniform(42, 'vec_id')}, vec_id) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
           FROM embeddings),
     d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, r.label AS ry, list_distance(q.v, r.v) AS dist
           FROM s q, s r WHERE q.split = 'test' AND r.split = 'train'),
     nn AS (SELECT qid, rid, ry, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM d)"""


@register("joi4_nearest_neighbours", _SPLIT_SQL + """
SELECT qid, rank, rid, ry FROM nn WHERE rank <= 5
""")
def joi4_nearest_neighbours(spark, sf):
    s = _split(spark, sf)
    nn = neighbors.nearest(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"),
                           "vec_id", "embedding", "label", 5)
    return nn.select("qid", F.col("rank").cast("long").alias("rank"), "rid", "ry")


@register("ml9_knn_error_curve", _SPLIT_SQL + """,
     ks AS (SELECT range AS k FROM range(1, 40)),
     votes AS (SELECT nn.qid, ks.k, nn.ry, count(*) AS c FROM nn JOIN ks ON nn.rank <= ks.k GROUP BY 1, 2, 3),
     pred AS (SELECT qid, k, ry AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY c DESC, ry) AS o FROM votes) WHERE o = 1)
SELECT CAST(pred.k AS INTEGER) AS k, round(avg(CAST(pred.pred <> s.label AS DOUBLE)), 6) AS error_rate, count(*) AS n
FROM pred JOIN s ON s.vec_id = pred.qid GROUP BY pred.k
""")
def ml9_knn_error_curve(spark, sf):
    s = _split(spark, sf)
    test = s.where(F.col("split") == "test")
    nn = neighbors.nearest(test, s.where(F.col("split") == "train"), "vec_id", "embedding", "label", 39)
    votes = neighbors.vote_curve(nn, test, "vec_id", "label", CLASSES, 39)
    return round_doubles(neighbors.error_curve(votes), 6)


@register("ml9_knn_predictions")
def ml9_knn_predictions(spark, sf):
    s = _split(spark, sf)
    test = s.where(F.col("split") == "test")
    nn = neighbors.nearest(test, s.where(F.col("split") == "train"), "vec_id", "embedding", "label", 39)
    return neighbors.vote_curve(nn, test, "vec_id", "label", CLASSES, 39).where(F.col("k") == 9)


@register("bal2_smote")
def bal2_smote(spark, sf):
    lab = Tables(spark, sf).labels
    e = Tables(spark, sf).embeddings.select("vec_id", "embedding")
    data = lab.join(e, lab.doc_id == e.vec_id).select("vec_id", "embedding", "quality")
    out = neighbors.smote(data, "vec_id", "embedding", "quality", k=5, seed=42)
    return out.groupBy("quality", "synthetic").agg(F.count(F.lit(1)).alias("n"))
