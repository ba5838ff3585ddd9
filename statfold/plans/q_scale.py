"""Scaling, encoding, array and math queries (SCL*, ENC*, ARR*, MTH1, ARG1, TOP3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions import arrays, dates
from statfold.functions.hashing import sql_hash_uniform
from statfold.operators import sampling, scale
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register


@register("scl1_zscore_sample", """
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer
""")
def scl1_zscore_sample(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal")
    return round_doubles(scale.standardize(c, ["c_acctbal"], ddof=1), 6)


@register("scl2_zscore_fit_train", f"""
WITH s AS (SELECT o_orderkey, o_totalprice, CASE WHEN pos <= ceil(0.25 * n) THEN 'test' ELSE 'train' END AS split
           FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {sql_hash_uniform(42, 'o_orderkey')}, o_orderkey) AS pos,
                        count(*) OVER () AS n FROM orders)),
     f AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM s WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - m) / sd, 6) AS o_totalprice FROM s, f WHERE split = 'test'
""")
def scl2_zscore_fit_train(spark, sf):
    o = sampling.exact_split(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 0.25, 42)
    train, test = o.where(F.col("split") == "train"), o.where(F.col("split") == "test")
    return round_doubles(scale.standardize(test, ["o_totalprice"], ddof=0, fit_on=train), 6)


@register("scl3_minmax_array", """
SELECT vec_id, i AS idx, round((CAST(embedding[i + 1] AS DOUBLE) - lo) / (hi - lo + 1e-8), 6) AS value
FROM (SELECT vec_id, embedding, list_min(CAST(embedding AS DOUBLE[])) AS lo, list_max(CAST(embedding AS DOUBLE[])) AS hi,
             unnest(range(len(embedding))) AS i FROM embeddings)
""")
def scl3_minmax_array(spark, sf):
    e = arrays.with_minmax(Tables(spark, sf).embeddings.select("vec_id", "embedding"), "embedding", "a")
    return round_doubles(e.select("vec_id", F.posexplode("a").alias("idx", "value")), 6)


@register("enc1_one_hot", """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N,
       CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R, CAST(l_linestatus = 'F' AS INTEGER) AS l_linestatus_F,
       CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O FROM lineitem
""")
def enc1_one_hot(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return scale.one_hot_wide(li, ["l_returnflag", "l_linestatus"])


@register("enc2_one_hot_label", """
SELECT vec_id, label, 1.0::DOUBLE AS hot_sum, label AS back FROM embeddings
""")
def enc2_one_hot_label(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", "label", scale.one_hot_array("label", 10).alias("h"))
    return e.select("vec_id", "label", F.aggregate("h", F.lit(0.0), lambda a, x: a + x).alias("hot_sum"),
                    arrays.argmax("h").alias("back"))


@register("enc3_date_days", """
SELECT o_orderkey, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders
""")
def enc3_date_days(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", dates.days_since_epoch("o_orderdate").alias("days"))


_INTS = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER))"


@register("arr1_parse_ints", f"""
SELECT vec_id, CAST(len(a) AS INTEGER) AS n, CAST(list_sum(a) AS BIGINT) AS total, a[1] AS first, a[-1] AS last
FROM (SELECT vec_id, list_transform(string_split_regex(array_to_string({_INTS}, ' '), '\\s+'), lambda t: TRY_CAST(t AS INTEGER)) AS a
      FROM embeddings)
""")
def arr1_parse_ints(spark, sf):
    e = Tables(spark, sf).embeddings
    ints = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    s = e.select("vec_id", F.array_join(ints, " ").alias("pixels"))
    a = s.select("vec_id", arrays.parse_int_array("pixels").alias("a"))
    return a.select("vec_id", F.size("a").alias("n"),
                    F.aggregate("a", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"),
                    F.element_at("a", 1).alias("first"), F.element_at("a", -1).alias("last"))


@register("arr2_reshape", """
SELECT vec_id, r, c, round(CAST(embedding[r * 8 + c + 1] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT range AS r FROM range(8)), (SELECT range AS c FROM range(8))
""")
def arr2_reshape(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", arrays.reshape("embedding", 8, 8).alias("m"))
    rows = e.select("vec_id", F.posexplode("m").alias("r", "row"))
    cells = rows.select("vec_id", F.col("r").cast("long").alias("r"), F.posexplode("row").alias("c", "value"))
    cells = cells.select("vec_id", "r", F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value"))
    return round_doubles(cells, 6)


@register("arr3_float32", """
SELECT vec_id, round(list_sum(CAST(CAST(embedding AS DOUBLE[]) AS FLOAT[])), 4) AS total FROM embeddings
""")
def arr3_float32(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", arrays.to_float32(F.col("embedding").cast("array<double>")).alias("a"))
    return round_doubles(e.select("vec_id", F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x).alias("total")), 4)


@register("mth1_softmax", """
SELECT vec_id, round(1.0 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS p_max,
       CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS arg
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
""")
def mth1_softmax(spark, sf):
    e = arrays.with_softmax(Tables(spark, sf).embeddings.select("vec_id", "embedding"), "embedding", "p")
    return round_doubles(e.select("vec_id", F.array_max("p").alias("p_max"), arrays.argmax("p").alias("arg")), 6)


@register("arg1_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS arg FROM embeddings
""")
def arg1_argmax(spark, sf):
    e = Tables(spark, sf).embeddings
    return e.select("vec_id", arrays.argmax("embedding").alias("arg"))


@register("top3_last_tokens", r"""
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w[greatest(len(w) - 299, 1):], ' ')) AS tail_md5,
       md5(right(text, 512)) AS tail_chars_md5
FROM (SELECT doc_id, text, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN []::VARCHAR[]
             ELSE string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') END AS w FROM documents)
""")
def top3_last_tokens(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", arrays.whitespace_words("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"),
                    F.md5(F.array_join(arrays.last_n("w", 300), " ")).alias("tail_md5"),
                    F.md5(F.expr("right(text, 512)")).alias("tail_chars_md5"))
