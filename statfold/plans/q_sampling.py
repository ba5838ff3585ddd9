"""Split, sample, fold, batch, slice and over-sampling queries (SRC2, SRC5-7, SPL*, BAL1, BAL3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions.hashing import sql_hash_uniform
from statfold.operators import rebalance, sampling
from statfold.plans.registry import Tables, register
from statfold.sources import dataset

U_DOC = sql_hash_uniform(42, "doc_id")
SPLIT_SQL = f"CASE WHEN {U_DOC} < 0.8 THEN 'train' WHEN {U_DOC} < 0.9 THEN 'validation' ELSE 'test' END"


@register("src2_read_dataset", f"""
SELECT doc_id, lang FROM documents WHERE {SPLIT_SQL} = 'train' AND lang = 'en'
""")
def src2_read_dataset(spark, sf):
    docs = dataset.with_hash_split(Tables(spark, sf).documents.select("doc_id", "lang"), "doc_id")
    return dataset.select_split(docs, "train", "en", "split", "lang").select("doc_id", "lang")


@register("src5_prefix_percent", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM documents)
WHERE pos <= floor(n * 10 / 100)
""")
def src5_prefix_percent(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id")
    return sampling.prefix_percent(docs, ["doc_id"], 10)


@register("src6_prefix_slices", """
SELECT doc_id, CASE WHEN pos <= 1000 THEN 'train' WHEN pos <= 1250 THEN 'validation' ELSE 'test' END AS slice
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE text IS NOT NULL) WHERE pos <= 1500
""")
def src6_prefix_slices(spark, sf):
    # the reference drops rows without a summary, then slices [0:1000], [1000:1250], [1250:1500]
    docs = Tables(spark, sf).documents.where(F.col("text").isNotNull()).select("doc_id")
    return sampling.prefix_slices(docs, ["doc_id"], {"train": (0, 1000), "validation": (1000, 1250),
                                                     "test": (1250, 1500)})


@register("src7_split_frames", f"""
SELECT {SPLIT_SQL} AS split, count(*) AS n FROM documents GROUP BY 1
""")
def src7_split_frames(spark, sf):
    docs = dataset.with_hash_split(Tables(spark, sf).documents.select("doc_id"), "doc_id")
    frames = sampling.split_frames(docs, "split", ["train", "validation", "test"])
    out = None
    for name, frame in frames.items():
        part = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("split"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("n") > 0)


U_CUST = sql_hash_uniform(42, "c_custkey")


@register("spl1_exact_split", f"""
SELECT c_custkey, CASE WHEN pos <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT c_custkey, row_number() OVER (ORDER BY {U_CUST}, c_custkey) AS pos, count(*) OVER () AS n FROM customer)
""")
def spl1_exact_split(spark, sf):
    return sampling.exact_split(Tables(spark, sf).customer.select("c_custkey"), "c_custkey", 0.2, 42)


@register("spl2_bernoulli_split", f"""
SELECT c_custkey, CASE WHEN {U_CUST} < 0.7 THEN 'train' ELSE 'test' END AS split FROM customer
""")
def spl2_bernoulli_split(spark, sf):
    return sampling.bernoulli_split(Tables(spark, sf).customer.select("c_custkey"), "c_custkey", (0.7, 0.3))


@register("spl3_sample_rows", f"""
SELECT o_orderkey FROM orders ORDER BY {sql_hash_uniform(42, 'o_orderkey')}, o_orderkey LIMIT 100
""")
def spl3_sample_rows(spark, sf):
    return sampling.sample_rows(Tables(spark, sf).orders.select("o_orderkey"), "o_orderkey", 100, 42)


def _fold_sql(order: str, k: int) -> str:
    return f"""
SELECT c_custkey, CAST(CASE WHEN pos <= (n % {k}) * (n // {k} + 1) THEN (pos - 1) // (n // {k} + 1)
       ELSE (n % {k}) + (pos - 1 - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold
FROM (SELECT c_custkey, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () AS n FROM customer)"""


@register("spl4_kfold_shuffled", _fold_sql(f"{U_CUST}, c_custkey", 7))
def spl4_kfold_shuffled(spark, sf):
    return sampling.kfold(Tables(spark, sf).customer.select("c_custkey"), "c_custkey", 7, "shuffled", 42)


@register("spl4_kfold_contiguous", _fold_sql("c_custkey", 5))
def spl4_kfold_contiguous(spark, sf):
    return sampling.kfold(Tables(spark, sf).customer.select("c_custkey"), "c_custkey", 5, "contiguous")


@register("spl4_kfold_stratified", f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {sql_hash_uniform(42, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels
""")
def spl4_kfold_stratified(spark, sf):
    lab = Tables(spark, sf).labels.select("doc_id", "quality")
    return sampling.kfold(lab, "doc_id", 5, "stratified", 42, label="quality")


@register("spl5_batches", f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 6 AS BIGINT) AS batch,
       CAST((row_number() OVER (ORDER BY {U_DOC}, doc_id) - 1) // 6 AS BIGINT) AS shuffled_batch FROM documents
""")
def spl5_batches(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id")
    seq = sampling.batches(docs, "doc_id", 6)
    shuf = sampling.batches(docs, "doc_id", 6, shuffle=True, seed=42, out="shuffled_batch")
    return seq.join(shuf, "doc_id")


@register("bal1_oversample_minority", f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
     mino AS (SELECT quality, n FROM c ORDER BY n, CAST(quality AS VARCHAR) LIMIT 1),
     need AS (SELECT 2 * (SELECT max(n) FROM c) - (SELECT sum(n) FROM c) AS k),
     m AS (SELECT l.doc_id, l.quality, l.toxic, row_number() OVER (ORDER BY l.doc_id) AS r FROM labels l JOIN mino USING (quality)),
     d AS (SELECT range AS draw FROM range(CAST((SELECT k FROM need) AS BIGINT)))
SELECT doc_id, quality, toxic, NULL::BIGINT AS draw FROM labels
UNION ALL
SELECT m.doc_id, m.quality, m.toxic, d.draw FROM d JOIN m
  ON m.r = (('0x' || substr(md5('42|' || CAST(d.draw AS VARCHAR)), 1, 8))::BIGINT % (SELECT n FROM mino)) + 1
""")
def bal1_oversample_minority(spark, sf):
    return rebalance.oversample_minority(Tables(spark, sf).labels, "quality", "doc_id", None, 42)


@register("bal3_oversample_equal", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
     p AS (SELECT label, n, max(n) OVER () - n AS need FROM c),
     q AS (SELECT label, n, sum(need) OVER (ORDER BY label) - need AS lo, sum(need) OVER (ORDER BY label) AS hi FROM p WHERE need > 0),
     m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
     d AS (SELECT range AS draw FROM range(CAST((SELECT max(hi) FROM q) AS BIGINT)))
SELECT vec_id, label, NULL::BIGINT AS draw FROM embeddings
UNION ALL
SELECT m.vec_id, m.label, d.draw FROM d JOIN q ON d.draw >= q.lo AND d.draw < q.hi
  JOIN m ON m.label = q.label AND m.r = (('0x' || substr(md5('42|' || CAST(d.draw AS VARCHAR)), 1, 8))::BIGINT % q.n) + 1
""")
def bal3_oversample_equal(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", "label")
    return rebalance.oversample_equal(e, "label", "vec_id", 42)
