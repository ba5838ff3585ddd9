from pyspark.sql import functions as F

from statfold.session import scratch_path
from statfold.streaming.incremental import period_counts_stream, run_to_table

from .conftest import SF_SMALL


def test_streaming_period_counts_match_batch(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = scratch_path(spark, "stream-src")
    events.repartition(4).write.parquet(folder)  # a folder of files, as a landing zone would be
    q = run_to_table(period_counts_stream(spark, folder, events.schema, "ts", "1 day", "0 seconds"),
                     scratch_path(spark, "stream-ckpt"), "stream_counts")
    q.awaitTermination(120)
    got = {r["period"]: r["n"] for r in spark.sql("SELECT * FROM stream_counts").collect()}
    want = {r["d"]: r["n"] for r in events.groupBy(F.to_date("ts").alias("d")).count().withColumnRenamed("count", "n").collect()}
    # with a zero watermark every day except possibly the last one is final
    last = max(want)
    assert {k: v for k, v in got.items() if k != last} == {k: v for k, v in want.items() if k != last}
