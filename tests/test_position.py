import pytest
from pyspark.sql import functions as F

from statfold.operators.position import exact_quantiles, order_statistics, running_sum, with_group_rank, with_position


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_positions_same_for_any_partitioning(spark, parts):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    pos = with_position(df.repartition(parts), ["k", "id"], "pos", partitions=parts)
    got = {r["id"]: r["pos"] for r in pos.collect()}
    expect = {i: rank + 1 for rank, i in enumerate(sorted(range(1000), key=lambda i: ((i * 7919) % 1000, i)))}
    assert got == expect


def test_group_rank_matches_row_number(spark):
    df = spark.range(0, 500).withColumn("g", F.col("id") % 3).withColumn("v", (F.col("id") * 37) % 101)
    got = {r["id"]: r["rank"] for r in with_group_rank(df, ["g"], ["v", "id"], "rank").collect()}
    rows = sorted(((i % 3, (i * 37) % 101, i) for i in range(500)))
    expect, seen = {}, {}
    for g, v, i in rows:
        seen[g] = seen.get(g, 0) + 1
        expect[i] = seen[g]
    assert got == expect


def test_quartiles_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert (q["q25"], q["q50"], q["q75"]) == (1.75, 2.5, 4.75)


def test_order_statistics_hinges(spark):
    # R fivenum(c(1, 2, 3, 10)) -> 1.0 1.5 2.5 6.5 10.0
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    n4 = F.floor((F.col("_n") + 3) / 2) / 2
    r = order_statistics(df, "x", [n4, F.col("_n") + 1 - n4], [], ["lo", "hi"]).first()
    assert (r["lo"], r["hi"]) == (1.5, 6.5)


def test_running_sum_distributed(spark):
    df = spark.range(1, 2001).withColumn("v", F.lit(1))
    out = running_sum(df, ["id"], "v", "cum", partitions=7)
    assert all(r["cum"] == r["id"] for r in out.collect())


@pytest.mark.parametrize("bound", ["0", "1000000"])
def test_grouped_quantiles_with_and_without_broadcast(spark, bound):
    # bound 0 forces the shuffle semi-join and the shuffle join of group starts
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 997).cast("double").alias("x"))
    old = spark.conf.get("spark.statfold.broadcastMaxRows", "1000000")
    spark.conf.set("spark.statfold.broadcastMaxRows", bound)
    try:
        got = {r["g"]: (r["q25"], r["q50"], r["q75"]) for r in exact_quantiles(df, "x", [0.25, 0.5, 0.75], ["g"]).collect()}
        ranks = {r["id"]: r["rank"] for r in with_group_rank(
            df.withColumn("id", F.monotonically_increasing_id()), ["g"], ["x", "id"], "rank").collect()}
    finally:
        spark.conf.set("spark.statfold.broadcastMaxRows", old)
    import numpy as np
    vals = {}
    for i in range(3000):
        vals.setdefault(i % 7, []).append(float((i * 7919) % 997))
    for g, xs in vals.items():
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.75])))
    assert sorted(ranks.values()) == sorted(r for xs in vals.values() for r in range(1, len(xs) + 1))


def test_ties_split_a_hot_value_over_partitions(spark):
    from statfold.operators.position import _ranged
    # value 0 is held by a third of the rows
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("x"))
    sizes = [r["n"] for r in _ranged(df, [F.col("x")], 8, True)
             .groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 3000
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    import numpy as np
    xs = [0 if i % 3 == 0 else i for i in range(9000)]
    assert (q["q25"], q["q50"], q["q75"]) == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.75])))


def test_running_sum_two_columns_many_partitions(spark):
    df = spark.range(0, 5000).select("id", ((F.col("id") * 37) % 11).alias("a"), (F.col("id") % 7 * 0.5).alias("b"))
    out = running_sum(df.repartition(5), ["id"], ["a", "b"], ["ca", "cb"], partitions=13).collect()
    ca = cb = 0
    expect = {}
    for i in range(5000):
        ca += (i * 37) % 11
        cb += i % 7 * 0.5
        expect[i] = (ca, cb)
    assert all(r["ca"] == expect[r["id"]][0] and r["cb"] == pytest.approx(expect[r["id"]][1]) for r in out)
    assert len(out) == 5000


def test_previous_and_durbin_watson_across_partitions(spark):
    import numpy as np
    from statfold.operators.linear import durbin_watson
    from statfold.operators.position import with_previous
    e = [float(((i * 7919) % 101) - 50) for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(e)), "id long, e double").repartition(5)
    spark.conf.set("spark.statfold.rangePartitions", "9")
    try:
        prev = {r["id"]: r["p"] for r in with_previous(df, ["id"], "e", "p").collect()}
        dw = durbin_watson(df, "e", "id")
    finally:
        spark.conf.unset("spark.statfold.rangePartitions")
    assert prev[0] is None and all(prev[i] == e[i - 1] for i in range(1, 4000))
    arr = np.array(e)
    assert dw == pytest.approx(float(np.sum(np.diff(arr) ** 2) / np.sum(arr ** 2)))
