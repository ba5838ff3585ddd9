"""AGG7 over a growing folder of files: event-time period counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def period_counts_stream(spark: SparkSession, path: str, schema: T.StructType | str, ts: str,
                         period: str = "1 day", watermark: str = "1 day", fmt: str = "parquet",
                         max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of (period start, count); rows later than the watermark are dropped,
    finished periods are emitted once in ``append`` mode."""
    src = (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .load(path))
    ev = src.select(F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", watermark)
    counts = ev.groupBy(F.window("_ts", period).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date(F.col("w.start")).alias("period"), "n")


def run_to_table(stream: DataFrame, checkpoint: str, table: str, trigger_once: bool = True):
    """Write a streaming result to a memory table (tests) with a checkpoint for exactly-once state."""
    writer = (stream.writeStream.outputMode("append").format("memory").queryName(table)
              .option("checkpointLocation", checkpoint))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
