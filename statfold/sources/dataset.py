"""Named datasets with splits and subsets (SRC2, SRC8) and columnar save/load (SRC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statfold.functions.hashing import hash_uniform


def select_split(df: DataFrame, split: str | None = None, subset: str | None = None,
                 split_col: str = "split", subset_col: str = "subset") -> DataFrame:
    """SRC2: rows of one split and/or subset (pushed down to the scan as filters)."""
    if split is not None:
        df = df.where(F.col(split_col) == split)
    if subset is not None:
        df = df.where(F.col(subset_col) == subset)
    return df


def read_dataset(spark: SparkSession, path: str, split: str | None = None, subset: str | None = None,
                 fmt: str = "parquet", split_col: str = "split", subset_col: str = "subset") -> DataFrame:
    """SRC2: ``load_dataset(name, subset, split)`` over a parquet/json folder."""
    df = spark.read.format(fmt).load(path)
    return select_split(df, split, subset, split_col, subset_col)


def with_hash_split(df: DataFrame, id_col: str, shares=(("train", 0.8), ("validation", 0.1), ("test", 0.1)),
                    seed: int = 42, out: str = "split") -> DataFrame:
    """A reproducible split column from ``md5(seed|id)`` (stand-in for shipped splits)."""
    u = hash_uniform(seed, id_col)
    edge, expr = 0.0, None
    for name, share in shares[:-1]:
        edge += share
        expr = F.when(u < edge, F.lit(name)) if expr is None else expr.when(u < edge, F.lit(name))
    last = F.lit(shares[-1][0])
    return df.withColumn(out, expr.otherwise(last) if expr is not None else last)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """SRC3 / SRC8: columnar save; ``partition_by`` writes one folder per subset
    (replaces a driver loop over subsets)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC3."""
    return spark.read.parquet(path)
