"""Exact most frequent values without shuffling the whole vocabulary (AGG14, TOP1).

A plain count sends every different value of every task through the shuffle. Here the values are dealt into slices by
hash and each slice gets a mergeable frequent-items sketch (Misra-Gries counters), of fixed size whatever the
vocabulary. A sketch of ``tracked`` counters over ``m`` values misses no value that occurs more than
``ERROR * m / tracked`` times and overstates none by more. The values that can still be among the first ``k`` are then
counted exactly in a second scan. The result is proven if the k-th exact count is above what any value outside the
candidates can reach; else (a flat distribution, or ties at the edge) everything is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.session import broadcast_if_small, cut_lineage

TRACKED = 16_384
ERROR = 2.625      # 3.5 counters of a map that is filled to three quarters
FEW_PARTITIONS = 64   # inputs read in no more pieces are counted plainly: their partial counts are few


def _first(counts: DataFrame, col: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k)


def count_all(values: DataFrame, col: str, k: int) -> DataFrame:
    return _first(values.groupBy(col).agg(F.count(F.lit(1)).alias("n")), col, k)


def candidates(values: DataFrame, col: str, k: int, tracked: int = TRACKED) -> tuple[DataFrame, float]:
    """The values that may be among the ``k`` most frequent, and the most that any other value can occur."""
    spark = values.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tracked = max(tracked, k)
    sliced = values.select(F.col(col).alias("v"), F.pmod(F.xxhash64(col), F.lit(slices)).alias("slice"))
    sketch = sliced.groupBy("slice").agg(F.expr(f"approx_top_k(v, {tracked}, {tracked})").alias("top"),
                                         F.count(F.lit(1)).alias("m"))
    error = F.ceil(F.col("m") * F.lit(ERROR / tracked))
    # a sketch of fewer values than counters has dropped none
    sketch = cut_lineage(sketch.select("top", F.when(F.col("m") <= tracked // 2, F.lit(0)).otherwise(error).alias("error")))
    listed = sketch.select(F.explode("top").alias("t"), "error").select("t.item", F.col("t.count").alias("most"), "error")
    surest = listed.select((F.col("most") - F.col("error")).alias("least")).orderBy(F.desc("least")).limit(k)
    edge = surest.agg(F.min("least"), F.count(F.lit(1))).first()
    error = float(sketch.agg(F.max("error")).first()[0] or 0)
    if edge[1] < k:
        return listed.select(F.col("item").alias(col)), error
    # what is left out occurs less often than the edge
    return listed.where(F.col("most") >= edge[0]).select(F.col("item").alias(col)), max(error, float(edge[0]) - 1)


def most_frequent(values: DataFrame, col: str, k: int, tracked: int = TRACKED,
                  few_partitions: int = FEW_PARTITIONS) -> DataFrame:
    """(col, n): the ``k`` most frequent non-null values, by falling count, ties by value ascending. Exact."""
    values = values.select(col).where(F.col(col).isNotNull())
    if values.rdd.getNumPartitions() <= few_partitions:
        return count_all(values, col, k)
    found, outside = candidates(values, col, k, tracked)
    counted = values.join(broadcast_if_small(cut_lineage(found)), col, "left_semi")
    top = cut_lineage(count_all(counted, col, k))
    last = top.agg(F.min("n"), F.count(F.lit(1))).first()
    if last[1] == k and last[0] > outside or (last[1] < k and outside == 0):
        return _first(top, col, k)
    return count_all(values, col, k)
