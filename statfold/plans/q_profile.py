"""Profiling, projection, filter and cleaning queries (PRF*, PRJ*, FIL*, CLN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.operators import clean, freq, profile
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register


def _union(parts):
    return "\nUNION ALL\n".join(parts)


_CUST_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
               ("c_acctbal", "double"), ("c_mktsegment", "string")]


@register("prf1_profile_columns", _union([
    f"SELECT '{c}' AS col_name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"'{t}' AS dtype FROM customer" for c, t in _CUST_TYPES]))
def prf1_profile_columns(spark, sf):
    return profile.profile_columns(Tables(spark, sf).customer)


@register("prf2_total_nulls", """
SELECT CAST(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT
    + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT) AS total_nulls
FROM orders
""")
def prf2_total_nulls(spark, sf):
    return profile.total_nulls(Tables(spark, sf).orders)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("prf3_describe", _union([
    f"SELECT '{c}' AS col_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem" for c in _LI_NUM]))
def prf3_describe(spark, sf):
    return round_doubles(profile.describe(Tables(spark, sf).lineitem, _LI_NUM))


_STR_COLS = ["o_orderstatus", "o_orderpriority"]


@register("prf4_describe_strings", _union([
    f"""SELECT '{c}' AS col_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS top,
       max(n) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)""" for c in _STR_COLS]))
def prf4_describe_strings(spark, sf):
    return profile.describe_strings(Tables(spark, sf).orders, _STR_COLS)


@register("prf5_head", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice
FROM orders ORDER BY o_orderkey LIMIT 5
""")
def prf5_head(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return round_doubles(profile.head(o, ["o_orderkey"], 5))


@register("prf6_duplicate_keys", """
SELECT count(*) - count(DISTINCT o_custkey) AS duplicate_keys, count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys
FROM orders
""")
def prf6_duplicate_keys(spark, sf):
    return profile.duplicate_key_count(Tables(spark, sf).orders, "o_custkey")


@register("prf7_distinct_rows", """
SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem)
""")
def prf7_distinct_rows(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount")
    return profile.distinct_rows(li)


@register("prf8_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def prf8_distinct_values(spark, sf):
    return profile.distinct_values(Tables(spark, sf).orders, "o_orderpriority")


@register("prf9_range_quartiles", """
SELECT 'o_totalprice' AS col_name, round(max(o_totalprice) - min(o_totalprice), 4) AS range,
       round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q75
FROM orders
""")
def prf9_range_quartiles(spark, sf):
    return round_doubles(profile.range_quartiles(Tables(spark, sf).orders, "o_totalprice"))


@register("prj1_drop_columns", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
""")
def prj1_drop_columns(spark, sf):
    li = Tables(spark, sf).lineitem
    return clean.drop_columns(li, ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
                                   "l_linestatus", "l_shipdate"])


@register("prj2_select_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def prj2_select_columns(spark, sf):
    return clean.select_columns(Tables(spark, sf).orders, ["o_orderkey", "o_orderpriority"])


@register("prj3_select_numeric", "SELECT c_custkey, c_nationkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def prj3_select_numeric(spark, sf):
    return round_doubles(clean.select_numeric(Tables(spark, sf).customer))


@register("prj4_derived_sums", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_linenumber, 4) AS qty_line,
       round(l_tax + l_discount, 4) AS tax_disc FROM lineitem
""")
def prj4_derived_sums(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    out = clean.add_sums(li, {"qty_line": ["l_quantity", "l_linenumber"], "tax_disc": ["l_tax", "l_discount"]})
    return round_doubles(out.select("l_orderkey", "l_linenumber", "qty_line", "tax_disc"))


@register("prj5_safe_cast", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority_code,
       TRY_CAST(o_orderstatus AS BIGINT) AS status_code FROM orders
""")
def prj5_safe_cast(spark, sf):
    o = Tables(spark, sf).orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority_code"),
        F.col("o_orderstatus").alias("status_code"))
    return clean.safe_cast(o, {"priority_code": "bigint", "status_code": "bigint"})


@register("fil1_equal_filter", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'
""")
def fil1_equal_filter(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.filter_equal(li, "l_returnflag", "R")


_SEG_NULL = "nullif(c_mktsegment, 'BUILDING')"


@register("fil2_not_null", f"""
SELECT seg, count(*) AS n FROM (SELECT {_SEG_NULL} AS seg FROM customer) WHERE seg IS NOT NULL GROUP BY seg
""")
def fil2_not_null(spark, sf):
    c = Tables(spark, sf).customer.select(F.expr(_SEG_NULL).alias("seg"))
    return freq.value_counts(clean.filter_not_null(c, "seg"), "seg")


@register("fil3_drop_incomplete", f"""
SELECT c_custkey, seg, nat FROM (SELECT c_custkey, {_SEG_NULL} AS seg, nullif(c_nationkey, 3) AS nat FROM customer)
WHERE seg IS NOT NULL AND nat IS NOT NULL
""")
def fil3_drop_incomplete(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", F.expr(_SEG_NULL).alias("seg"),
                                         F.expr("nullif(c_nationkey, 3)").alias("nat"))
    return clean.drop_incomplete(c)


@register("fil4_valid_input", r"""
SELECT conv_id, turn, (text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0
       AND length(text) > 3 AND regexp_matches(text, '\p{L}')) AS valid
FROM conversations
""")
def fil4_valid_input(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", clean.valid_input(F.col("text")).alias("valid"))


@register("cln1_fill_nulls", f"""
SELECT coalesce(seg, 'Unknown') AS seg, count(*) AS n FROM (SELECT {_SEG_NULL} AS seg FROM customer) GROUP BY 1
""")
def cln1_fill_nulls(spark, sf):
    c = Tables(spark, sf).customer.select(F.expr(_SEG_NULL).alias("seg"))
    return freq.value_counts(clean.fill_nulls(c, {"seg": "Unknown"}), "seg")


@register("cln2_replace_blank", """
SELECT CASE WHEN seg = '' THEN '0' ELSE seg END AS seg, count(*) AS n
FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS seg FROM customer) GROUP BY 1
""")
def cln2_replace_blank(spark, sf):
    c = Tables(spark, sf).customer.select(
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("seg"))
    return freq.value_counts(clean.replace_blank(c, "0"), "seg")


# Stand-in recodes for the churn table (return flag -> country,
# line status -> gender) and segment -> integer code.
COUNTRY_OF_FLAG = {"A": "France", "N": "Germany", "R": "Spain"}
GENDER_OF_STATUS = {"F": "Female", "O": "Male"}
SEGMENT_CODE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}


@register("cln3_recode", """
SELECT CASE l_returnflag WHEN 'A' THEN 'France' WHEN 'N' THEN 'Germany' WHEN 'R' THEN 'Spain' ELSE l_returnflag END AS country,
       CASE l_linestatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE l_linestatus END AS gender,
       count(*) AS n
FROM lineitem GROUP BY 1, 2
UNION ALL
SELECT CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
       WHEN 'HOUSEHOLD' THEN 4 ELSE TRY_CAST(c_mktsegment AS BIGINT) END AS VARCHAR) AS country, 'segment' AS gender, count(*) AS n
FROM customer GROUP BY 1
""")
def cln3_recode(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.select(clean.recode("l_returnflag", COUNTRY_OF_FLAG).alias("country"),
                           clean.recode("l_linestatus", GENDER_OF_STATUS).alias("gender"))
    a = li.groupBy("country", "gender").agg(F.count(F.lit(1)).alias("n"))
    seg = t.customer.select(clean.recode("c_mktsegment", SEGMENT_CODE).cast("string").alias("country"),
                            F.lit("segment").alias("gender"))
    b = seg.groupBy("country", "gender").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@register("cln4_duplicated_rows", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1)
SELECT o_orderstatus, o_orderpriority FROM (SELECT o_orderstatus, o_orderpriority, unnest(generate_series(2, n)) AS k FROM c)
""")
def cln4_duplicated_rows(spark, sf):
    return clean.duplicated_rows(Tables(spark, sf).orders.select("o_orderstatus", "o_orderpriority"))


@register("cln5_drop_duplicates", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def cln5_drop_duplicates(spark, sf):
    return clean.drop_duplicates(Tables(spark, sf).orders.select("o_orderstatus", "o_orderpriority"))


def _hinge_report_sql(table: str, col: str) -> str:
    return f"""
SELECT '{col}' AS col_name, count(*) AS n, CAST(sum((x < lf OR x > uf)::INT) AS BIGINT) AS n_out,
       round(sum((x < lf OR x > uf)::INT) / count(*), 4) AS prop, round(avg(x), 4) AS mean_before,
       round(avg(CASE WHEN NOT (x < lf OR x > uf) THEN x END), 4) AS mean_after
FROM (
  SELECT x, lh - 1.5 * (uh - lh) AS lf, uh + 1.5 * (uh - lh) AS uf FROM (SELECT {col} AS x FROM {table} WHERE {col} IS NOT NULL),
  (SELECT avg(CASE WHEN rn IN (floor(lo_h), ceil(lo_h)) THEN x END) AS lh,
          avg(CASE WHEN rn IN (floor(hi_h), ceil(hi_h)) THEN x END) AS uh
   FROM (SELECT x, rn, floor((n + 3) / 2) / 2 AS lo_h, n + 1 - floor((n + 3) / 2) / 2 AS hi_h
         FROM (SELECT {col} AS x, row_number() OVER (ORDER BY {col}) AS rn, count(*) OVER () AS n
               FROM {table} WHERE {col} IS NOT NULL)))
)"""


@register("cln6_tukey_outliers", _union([_hinge_report_sql("lineitem", "l_extendedprice"),
                                          _hinge_report_sql("lineitem", "l_quantity")]))
def cln6_tukey_outliers(spark, sf):
    li = Tables(spark, sf).lineitem
    _, report = clean.tukey_outliers(li, ["l_extendedprice", "l_quantity"], 1.5, "null")
    return round_doubles(report.select("col_name", "n", "n_out", "prop", "mean_before", "mean_after"))


@register("cln7_equal_width_bins", """
WITH b AS (SELECT min(l_quantity) - (max(l_quantity) - min(l_quantity)) / 1000 AS lo,
                  max(l_quantity) + (max(l_quantity) - min(l_quantity)) / 1000 AS hi FROM lineitem)
SELECT CAST(greatest(1, least(20, ceil((l_quantity - lo) / ((hi - lo) / 20)))) AS INTEGER) AS bin, count(*) AS n
FROM lineitem, b GROUP BY 1
""")
def cln7_equal_width_bins(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_quantity")
    return freq.equal_width_bins(li, "l_quantity", 20).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
