"""Driver tables (parquet) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows carry whole texts: per-row work (tokenising, regexes) outweighs a shuffle.
TEXT_TABLES = ("documents", "pages", "benchmark", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than the cluster has task slots.

    A parquet row group is never split, so a small file written as one row
    group is read by one task however many cores wait. Large inputs have far
    more splits than slots and are returned unchanged (no shuffle); Catalyst
    still prunes columns and pushes filters below the repartition.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)
