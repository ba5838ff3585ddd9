"""Frequency, period and share queries (AGG*, JOI1-3, WIN1-3, TOP1, DAT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions import dates
from statfold.functions.hashing import sql_hash_uniform
from statfold.operators import freq
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register
from statfold.sources import dataset

# Minimum slice: sparse subset of orders so that empty months exist.
SPARSE_ORDERS = "o_totalprice > 495000"


@register("win1_monthly_running", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n
           FROM orders WHERE o_totalprice > 495000 GROUP BY 1),
     s AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period FROM m)
SELECT s.period, CAST(coalesce(m.n, 0) AS BIGINT) AS n,
       CAST(sum(coalesce(m.n, 0)) OVER (ORDER BY s.period) AS BIGINT) AS running
FROM s LEFT JOIN m USING (period)
""")
def win1_monthly_running(spark, sf):
    orders = Tables(spark, sf).orders.where(SPARSE_ORDERS)
    return freq.monthly_running(orders, "o_orderdate", "month")


@register("agg1_value_counts", """
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def agg1_value_counts(spark, sf):
    return freq.value_counts(Tables(spark, sf).lineitem, "l_returnflag")


@register("agg2_relative_counts", """
SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def agg2_relative_counts(spark, sf):
    return round_doubles(freq.relative_counts(Tables(spark, sf).orders, "o_orderpriority"), 6)


@register("agg3_group_share", """
SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS label
FROM customer GROUP BY 1
""")
def agg3_group_share(spark, sf):
    return round_doubles(freq.group_share(Tables(spark, sf).customer, "c_mktsegment"), 6)


@register("agg4_pair_counts", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2
""")
def agg4_pair_counts(spark, sf):
    return freq.pair_counts(Tables(spark, sf).lineitem, "l_returnflag", "l_linestatus")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("agg5_crosstab", "SELECT o_orderstatus, " + ", ".join(
    f"nullif(count(*) FILTER (WHERE o_orderpriority = '{p}'), 0) AS \"{p}\"" for p in _PRIORITIES)
    + " FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def agg5_crosstab(spark, sf):
    return freq.crosstab(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority", _PRIORITIES)


@register("agg5_crosstab_filled", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def agg5_crosstab_filled(spark, sf):
    return freq.crosstab(Tables(spark, sf).lineitem, "l_returnflag", "l_linestatus", None, fill=0)


@register("agg6_class_weights", """
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS weight
FROM embeddings WHERE label IS NOT NULL GROUP BY 1
""")
def agg6_class_weights(spark, sf):
    return round_doubles(freq.class_weights(Tables(spark, sf).embeddings, "label"), 6)


@register("agg7_daily_counts", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1
""")
def agg7_daily_counts(spark, sf):
    return freq.period_counts(Tables(spark, sf).events, "ts", "day")


@register("agg8_dense_month_end", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n
           FROM orders WHERE o_totalprice > 495000 GROUP BY 1),
     s AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period FROM m)
SELECT s.period, last_day(s.period) AS period_end, CAST(coalesce(m.n, 0) AS BIGINT) AS n FROM s LEFT JOIN m USING (period)
""")
def agg8_dense_month_end(spark, sf):
    orders = Tables(spark, sf).orders.where(SPARSE_ORDERS)
    dense = freq.dense_periods(freq.period_counts(orders, "o_orderdate", "month"), "period", "month")
    return freq.period_end_label(dense, "period")


@register("agg9_group_moments", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
       round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max
FROM lineitem GROUP BY 1
""")
def agg9_group_moments(spark, sf):
    li = Tables(spark, sf).lineitem
    out = li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"),
        F.stddev_samp("l_extendedprice").alias("sd"), F.min("l_extendedprice").alias("min"),
        F.max("l_extendedprice").alias("max"))
    return round_doubles(out)


@register("agg10_box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_lo,
       round(max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi,
       count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM lineitem l JOIN q USING (l_returnflag) GROUP BY l.l_returnflag, q1, median, q3
""")
def agg10_box_stats(spark, sf):
    from statfold.operators.stats import box_stats
    return round_doubles(box_stats(Tables(spark, sf).lineitem, "l_extendedprice", ["l_returnflag"]))


@register("agg11_histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
     h AS (SELECT CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin,
                  lo, (hi - lo) / 10 AS w FROM lineitem, b WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * w, 4) AS "left", round(lo + bin * w + w, 4) AS "right", count(*) AS n FROM h GROUP BY bin, lo, w
""")
def agg11_histogram(spark, sf):
    return round_doubles(freq.histogram(Tables(spark, sf).lineitem, "l_extendedprice", 10, "minmax"))


@register("agg12_grouped_histogram", """
WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
     h AS (SELECT l_linestatus, CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0
                  ELSE ceil((l_quantity - lo + (hi - lo) / 10 / 2) / ((hi - lo) / 10)) - 1 END AS INTEGER) AS bin,
                  lo, (hi - lo) / 10 AS w FROM lineitem, b WHERE l_quantity IS NOT NULL)
SELECT l_linestatus, bin, round(lo - w / 2 + bin * w, 4) AS "left", round(lo - w / 2 + bin * w + w, 4) AS "right", count(*) AS n
FROM h GROUP BY l_linestatus, bin, lo, w
""")
def agg12_grouped_histogram(spark, sf):
    li = Tables(spark, sf).lineitem
    return round_doubles(freq.histogram(li, "l_quantity", 11, "centered", ["l_linestatus"]))


@register("agg13_stacked_counts", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events
WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2
""")
def agg13_stacked_counts(spark, sf):
    ev = Tables(spark, sf).events.select(F.to_date(F.date_trunc("day", "ts")).alias("day"), "event_type")
    return freq.pair_counts(ev, "day", "event_type")


# A short English stop-word list for the word-frequency table.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "it", "this", "that",
              "by", "as", "at", "from", "be", "are", "was", "were"]


# Fixed value: a word cloud shows at most 200 words by default.
CLOUD_WORDS = 200


@register("agg14_word_frequencies", r"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}'']+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) > 0 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + f""") GROUP BY 1 ORDER BY n DESC, word LIMIT {CLOUD_WORDS}
""")
def agg14_word_frequencies(spark, sf):
    return freq.word_frequencies(Tables(spark, sf).documents, "text", STOP_WORDS, CLOUD_WORDS)


@register("top1_top10", """
SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10
""")
def top1_top10(spark, sf):
    return freq.top_values(Tables(spark, sf).orders, "o_custkey", 10)


@register("win2_cumulative_share", """
SELECT o_orderpriority, count(*) AS n,
       round(sum(count(*)) OVER (ORDER BY o_orderpriority) / sum(count(*)) OVER (), 6) AS cum_share
FROM orders GROUP BY 1
""")
def win2_cumulative_share(spark, sf):
    shares = freq.relative_counts(Tables(spark, sf).orders, "o_orderpriority")
    out = freq.running_total(shares, "o_orderpriority", "share", "cum_share").drop("share")
    return round_doubles(out, 6)


@register("win3_group_total", """
SELECT c_mktsegment, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM customer GROUP BY 1
""")
def win3_group_total(spark, sf):
    return freq.with_total(freq.value_counts(Tables(spark, sf).customer, "c_mktsegment"), "n", "total")


# Facial-expression class names by class id.
EMOTIONS = {0: "Angry", 1: "Disgust", 2: "Fear", 3: "Happy", 4: "Sad", 5: "Surprise", 6: "Neutral"}


@register("joi1_label_lookup", """
SELECT label, CASE label WHEN 0 THEN 'Angry' WHEN 1 THEN 'Disgust' WHEN 2 THEN 'Fear' WHEN 3 THEN 'Happy'
       WHEN 4 THEN 'Sad' WHEN 5 THEN 'Surprise' WHEN 6 THEN 'Neutral' END AS emotion, count(*) AS n
FROM embeddings GROUP BY 1, 2
""")
def joi1_label_lookup(spark, sf):
    e = freq.lookup_labels(Tables(spark, sf).embeddings, "label", EMOTIONS, "emotion")
    return e.groupBy("label", "emotion").agg(F.count(F.lit(1)).alias("n"))


USAGE = (("Training", 0.8), ("PublicTest", 0.1), ("PrivateTest", 0.1))
U_VEC = sql_hash_uniform(11, "vec_id")
USAGE_SQL = f"CASE WHEN {U_VEC} < 0.8 THEN 'Training' WHEN {U_VEC} < 0.9 THEN 'PublicTest' ELSE 'PrivateTest' END"


@register("joi2_fill_missing_levels", f"""
WITH c AS (SELECT {USAGE_SQL} AS usage, label, count(*) AS n FROM embeddings GROUP BY 1, 2),
     k AS (SELECT u.usage, e.label FROM (VALUES ('Training'), ('PublicTest'), ('PrivateTest')) u(usage),
                  (VALUES {", ".join(f"({k})" for k in EMOTIONS)}) e(label))
SELECT usage, label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM k FULL JOIN c USING (usage, label)
""")
def joi2_fill_missing_levels(spark, sf):
    # counts per usage frame; emotion keys absent from a frame are added with 0
    e = dataset.with_hash_split(Tables(spark, sf).embeddings.select("vec_id", "label"), "vec_id", USAGE, 11, "usage")
    counts = e.groupBy("usage", "label").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(u, k) for u, _ in USAGE for k in EMOTIONS], "usage string, label int")
    return freq.fill_missing_levels(counts, ["usage", "label"], spine, keep_unlisted=True)


@register("dat1_parse_dates", """
SELECT CASE WHEN CAST(right(s, 2) AS INTEGER) >= 69 THEN 1900 ELSE 2000 END + CAST(right(s, 2) AS INTEGER) AS yr, count(*) AS n
FROM (SELECT strftime(o_orderdate, '%d-%b-%y') AS s FROM orders) GROUP BY 1
""")
def dat1_parse_dates(spark, sf):
    o = Tables(spark, sf).orders.select(dates.format_day_mon_yy("o_orderdate").alias("s"))
    return o.select(F.year(dates.parse_day_mon_yy("s")).alias("yr")).groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@register("dat2_month_labels", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, strftime(date_trunc('month', o_orderdate), '%b-%Y') AS label,
       count(*) AS n FROM orders GROUP BY 1, 2
""")
def dat2_month_labels(spark, sf):
    o = Tables(spark, sf).orders.select(dates.month_key("o_orderdate").alias("period"))
    return o.groupBy("period", dates.month_label("period").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("dat3_daily_by_type", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, " + ", ".join(
    f"nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in _EVENT_TYPES)
    + " FROM events GROUP BY 1")
def dat3_daily_by_type(spark, sf):
    ev = Tables(spark, sf).events.select(F.to_date(F.date_trunc("day", "ts")).alias("day"), "event_type")
    return freq.crosstab(ev, "day", "event_type", _EVENT_TYPES)


@register("joi3_dense_months", """
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS n
           FROM lineitem WHERE l_quantity >= 50 GROUP BY 1),
     s AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period FROM m)
SELECT s.period, CAST(coalesce(m.n, 0) AS BIGINT) AS n FROM s LEFT JOIN m USING (period)
""")
def joi3_dense_months(spark, sf):
    li = Tables(spark, sf).lineitem.where(F.col("l_quantity") >= 50)
    return freq.dense_periods(freq.period_counts(li, "l_shipdate", "month"), "period", "month")


@register("win4_global_position", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders
""")
def win4_global_position(spark, sf):
    from statfold.operators.position import with_position
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return with_position(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "pos").select("o_orderkey", "pos")


@register("srt1_sort_by_share", """
SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1 ORDER BY share, c_mktsegment
""")
def srt1_sort_by_share(spark, sf):
    rel = freq.relative_counts(Tables(spark, sf).customer, "c_mktsegment")
    return round_doubles(rel.orderBy("share", "c_mktsegment"), 6)
