"""Profiling: counts, nulls, numeric and mixed summaries, distinct checks (PRF*).

Each profile is one aggregate pass over the table (one row of partial
aggregates per task), unpivoted afterwards into a long form with one row
per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.operators.position import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """PRJ3: names of numeric columns (pandas int64/float64, R ``is.numeric``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _long(one_row: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn ``{stat}__{col}`` columns of a one-row frame into rows per column."""
    spark = one_row.sparkSession
    rows = [F.struct(F.lit(c).alias("col_name"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols]
    if not rows:
        schema = "col_name string, " + ", ".join(f"{s} long" for s in stats)
        return spark.createDataFrame([], schema)
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """PRF1 + PRF2: rows, non-null and null count and type of every column."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"non_null__{c}"))
    one = df.agg(*aggs)
    for c in cols:
        one = one.withColumn(f"nulls__{c}", F.col("rows") - F.col(f"non_null__{c}"))
        one = one.withColumn(f"rows__{c}", F.col("rows"))
    long = _long(one, cols, ["rows", "non_null", "nulls"])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = []
    for c, t in types.items():
        pairs += [F.lit(c), F.lit(t)]
    return long.withColumn("dtype", F.create_map(*pairs)[F.col("col_name")])


def total_nulls(df: DataFrame) -> DataFrame:
    """PRF2 total: null cells over the whole table."""
    expr = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.sum(expr).alias("total_nulls"))


def _unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("u")
    ).select("u.*")


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """PRF3: count, mean, sd (ddof=1), min, quartiles (type 7), max per column.

    Quartiles are exact by default (range-partitioned order statistics; no
    group is gathered into one task). ``exact=False`` uses
    ``percentile_approx`` instead.
    """
    cols = list(cols or numeric_columns(df))
    long = _unpivot(df, cols).where(F.col("value").isNotNull())
    moments = long.groupBy("col_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    if exact:
        quart = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["col_name"], ["q25", "q50", "q75"],
                                max_groups=len(cols))
    else:
        quart = long.groupBy("col_name").agg(
            F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            "col_name", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"))
    return moments.join(quart, "col_name")


def describe_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRF4: count, unique, top, freq for string columns.

    ``top`` ties are broken by the smallest value (pandas leaves them open).
    """
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value")) for c in cols])).alias("u")).select("u.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("col_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("n").alias("freq"))


def head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """PRF5: first n rows under an explicit order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def duplicate_key_count(df: DataFrame, key: str) -> DataFrame:
    """PRF6: rows minus distinct keys (0 when the key is unique)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate_keys"),
                  F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """PRF7: number of distinct rows."""
    return df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """PRF8: the distinct values of one column."""
    return df.select(col).distinct()


def range_quartiles(df: DataFrame, col: str) -> DataFrame:
    """PRF9: max - min and the three quartiles of one column."""
    data = df.select(F.lit(col).alias("col_name"), F.col(col).cast("double").alias("value"))
    rng = data.groupBy("col_name").agg((F.max("value") - F.min("value")).alias("range"))
    q = exact_quantiles(data, "value", [0.25, 0.5, 0.75], ["col_name"], ["q25", "q50", "q75"], max_groups=1)
    return rng.join(q, "col_name")


def _typed(value: str, dtype: T.DataType):
    if isinstance(dtype, T.IntegralType):
        return int(value)
    if isinstance(dtype, T.FractionalType):
        return float(value)
    if isinstance(dtype, T.BooleanType):
        return value == "true"
    return value


def distinct_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 200) -> dict:
    """Sorted distinct non-null values of every column in ``cols``, in one distinct pass.

    Values travel as strings (one union of (column, value) pairs) and are read
    back in the column's type. The pass keeps at most ``len(cols) * (max_levels + 1)``
    rows: when every column is within the bound nothing is cut, and a column
    above it is refused.
    """
    cols = list(cols)
    if not cols:
        return {}
    parts = [df.where(F.col(c).isNotNull()).select(F.lit(c).alias("_k"), F.col(c).cast("string").alias("_v"))
             for c in cols]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    found: dict[str, list] = {c: [] for c in cols}
    for r in union.distinct().limit(len(cols) * (max_levels + 1)).collect():
        found[r["_k"]].append(r["_v"])
    out = {}
    for c in cols:
        if len(found[c]) > max_levels:
            raise ValueError(f"{c}: too many levels for a dummy expansion")
        dtype = df.schema[c].dataType
        out[c] = sorted(_typed(v, dtype) for v in found[c])
    return out
