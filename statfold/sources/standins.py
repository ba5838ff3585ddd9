"""Stand-in analysis tables derived from the driver tables (see FIXTURES.md).

The reference studies a bank-churn table and a law-exam table that are not
shipped; these frames give the same column roles, derived row by row from
``lineitem`` so their size grows with the data. Random-looking columns are
md5 hashes of the row id (reproducible in SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.functions.hashing import digest_u32, digest_uniform, hash_digest, hash_uniform, sql_digest_u32

# Level names of the stand-in categorical columns.
COUNTRIES = {"A": "France", "N": "Germany", "R": "Spain"}
GENDERS = {"F": "Female", "O": "Male"}
RACES = ["white", "black", "hisp", "asian", "other"]


def _row_id() -> F.Column:
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")


def _map(col: str, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def churn(lineitem: DataFrame) -> DataFrame:
    """Bank-churn roles: credit_score, country, gender, age, tenure, balance, products_number,
    credit_card, active_member, estimated_salary, churn (about 20 % positive, rising with age)."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
                         "l_linestatus", "l_discount")
    rid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    risk = F.lit(0.02) + F.lit(0.3) * F.col("l_quantity") / 50 + F.col("l_discount")
    # one md5 per row carries the four independent draws (windows 0..3)
    li = li.withColumn("_d", hash_digest("churn", rid))
    return li.select(
        rid.alias("customer_id"),
        (F.lit(350) + digest_u32(F.col("_d"), 0) % 501).cast("int").alias("credit_score"),
        _map("l_returnflag", COUNTRIES).alias("country"),
        _map("l_linestatus", GENDERS).alias("gender"),
        (F.lit(17) + F.col("l_quantity")).cast("int").alias("age"),
        F.col("l_linenumber").alias("tenure"),
        F.col("l_extendedprice").alias("balance"),
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("products_number"),
        (digest_uniform(F.col("_d"), 1) < 0.7).cast("int").alias("credit_card"),
        (digest_uniform(F.col("_d"), 2) < 0.5).cast("int").alias("active_member"),
        F.round(digest_uniform(F.col("_d"), 3) * 200000, 2).alias("estimated_salary"),
        (hash_uniform(5, rid) < risk).cast("int").alias("churn"))


def churn_sql() -> str:
    """DuckDB text of :func:`churn` (for oracle SQL)."""
    rid = "(l_orderkey * 8 + l_linenumber)"

    def u(seed):
        return f"(('0x' || substr(md5('{seed}|' || CAST({rid} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"

    def w(k):
        return f"({sql_digest_u32('churn', k, rid)} / 4294967296.0)"
    u32 = sql_digest_u32("churn", 0, rid)
    return f"""(SELECT {rid} AS customer_id, CAST(350 + {u32} % 501 AS INTEGER) AS credit_score,
  CASE l_returnflag WHEN 'A' THEN 'France' WHEN 'N' THEN 'Germany' WHEN 'R' THEN 'Spain' END AS country,
  CASE l_linestatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' END AS gender,
  CAST(17 + l_quantity AS INTEGER) AS age, l_linenumber AS tenure, l_extendedprice AS balance,
  CAST(l_linenumber % 4 + 1 AS INTEGER) AS products_number, CAST({w(1)} < 0.7 AS INTEGER) AS credit_card,
  CAST({w(2)} < 0.5 AS INTEGER) AS active_member, round({w(3)} * 200000, 2) AS estimated_salary,
  CAST({u(5)} < 0.02 + 0.3 * l_quantity / 50 + l_discount AS INTEGER) AS churn FROM lineitem)"""


def exam(lineitem: DataFrame) -> DataFrame:
    """Law-exam roles: lsat, ugpa, gpa, fam_inc, tier, race1, gender, fulltime, pass_bar."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                         "l_discount", "l_tax", "l_linestatus")
    rid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = li.withColumn("_d", hash_digest("exam", rid))
    race = F.element_at(F.array(*[F.lit(r) for r in RACES]), (digest_u32(F.col("_d"), 0) % 5 + 1).cast("int"))
    return li.select(
        rid.alias("id"),
        (F.col("l_extendedprice") / 1000).alias("lsat"),
        (F.col("l_discount") * 40).alias("ugpa"),
        (F.col("l_tax") * 50 + F.col("l_discount") * 10).alias("gpa"),
        F.col("l_linenumber").cast("int").alias("fam_inc"),
        (F.col("l_partkey") % 6 + 1).cast("int").alias("tier"),
        race.alias("race1"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("gender"),
        (digest_u32(F.col("_d"), 1) % 2 + 1).cast("int").alias("fulltime"),
        (F.col("l_quantity") > 10).cast("int").alias("pass_bar"))
