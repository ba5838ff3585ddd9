import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statfold.operators import position, sampling, select
from statfold.operators.position import exact_quantiles, order_statistics, sorted_statistics


def _frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, x {kind}").repartition(4)


def _check(df, values, ranks):
    got = select.values_at(df, "x", lambda n: ranks)
    order = sorted(values, key=lambda v: (v is not None, v is not None and v != v, 0 if v is None or v != v else v))
    n, at = got[()]
    assert n == len(values) and set(at) == {r for r in ranks if 1 <= r <= n}
    for r, (v, before, equal) in at.items():
        w = order[r - 1]
        same = [x for x in order if x == w or (x is not None and w is not None and x != x and w != w)]
        assert v == w or (v != v and w != w)
        assert equal == len(same) if w is not None else equal == order.count(None)
        if w is None:
            assert before == 0
        else:
            assert before == next(k for k, x in enumerate(order) if x == w or (x is not None and x != x and w != w))


@pytest.mark.parametrize("fetch", [50_000, 7])
def test_ranks_of_awkward_values(spark, monkeypatch, fetch):
    monkeypatch.setattr(select, "FETCH", fetch)
    monkeypatch.setattr(select, "SPLIT", 8)
    rng = np.random.default_rng(1)
    values = [None, None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 5e-324, -5e-324, 1.7e308, -1.7e308,
              *[7.25] * 300, *map(float, rng.normal(size=200) * 1e3), *map(float, 2.0 ** rng.integers(-900, 900, 100)),
              *[1 + k * 2.0 ** -52 for k in range(60)]]
    _check(_frame(spark, values), values, [0, 1, 2, 3, 5, 50, 200, 333, 400, 600, len(values) - 1, len(values), 10 ** 9])


def test_ranks_of_long_and_decimal(spark, monkeypatch):
    monkeypatch.setattr(select, "FETCH", 5)
    values = [2 ** 60 + k for k in range(40)] + [-(2 ** 62)] * 3 + [2 ** 63 - 1, -(2 ** 63), 0]
    _check(_frame(spark, values, "long"), values, [1, 2, 4, 5, 20, 45, 46])
    from decimal import Decimal
    values = [Decimal(k) / 100 for k in range(-30, 60)] * 2
    _check(_frame(spark, values, "decimal(12,2)"), values, [1, 2, 3, 60, 61, 180])


@pytest.mark.parametrize("n", [1, 5, 60])
def test_both_ways_agree(spark, n):
    rng = np.random.default_rng(n)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], float(rng.integers(-500, 500)) / 8) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double")
    places = [F.lit(p) * (F.col("_n") - 1) + 1 for p in (0.25, 0.5, 0.9)]
    a, b = (sorted(map(tuple, f(df, "x", places, ["g"], max_groups=3).collect()), key=str)
            for f in (order_statistics, sorted_statistics))
    assert a == b and len(a) == len({r[0] for r in rows})


def test_many_groups_take_the_sorted_way(spark, monkeypatch):
    monkeypatch.setattr(select, "MAX_CELLS", 20)
    df = spark.createDataFrame([(i % 50, float(i)) for i in range(500)], "g int, x double")
    got = {r["g"]: r["q50"] for r in exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    assert got == {g: float(np.median(np.arange(g, 500, 50))) for g in range(50)}


def test_quantiles_neither_sort_nor_write(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("rows were numbered")
    monkeypatch.setattr(position, "with_position", refuse)
    monkeypatch.setattr(sampling, "with_position", refuse)
    df = spark.range(3000).withColumn("x", F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.sqrt("id")))
    assert exact_quantiles(df, "x", [0.0, 1.0]).first()[:] == (1.0, math.sqrt(2999))
    split = sampling.exact_split(df, "id", 0.2, 7)
    assert split.where("split = 'test'").count() == 600
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    assert sampling.sample_rows(df, "id", 1000, topk_limit=10).count() == 1000
    folds = sampling.kfold(df, "id", 7).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == sorted(3000 // 7 + (i < 3000 % 7) for i in range(7))


def test_cut_between_ties_and_equal_rows(spark):
    df = spark.createDataFrame([(i // 40, i, "s") for i in range(200)], "a int, b long, s string")
    got = sampling.prefix_percent(df, ["a", "b"], 33)
    assert sorted(r["b"] for r in got.collect()) == list(range(66))
    parts = sampling.prefix_slices(df, ["a", "b"], {"x": (0, 50), "y": (50, 51), "z": (190, 999)})
    assert {r["slice"]: r["count"] for r in parts.groupBy("slice").count().collect()} == {"x": 50, "y": 1, "z": 10}
    # rows equal in every key lie on both sides, and string keys: positions
    assert sampling.prefix_percent(df, ["a"], 33).count() == 66
    assert sampling.prefix_percent(df, ["s", "b"], 50).count() == 100
    assert sampling.prefix_percent(df.where("b < 0"), ["a", "b"], 33).count() == 0


def test_splits_through_equal_rows_are_only_filtered(spark, monkeypatch):
    numbered = []

    def few(df, *a, **k):
        numbered.append(df.count())
        return position_of(df, *a, **k)
    position_of = position.with_position
    monkeypatch.setattr(position, "with_position", few)
    monkeypatch.setattr(sampling, "with_position", few)
    # every id three times: most cuts go through rows equal in all keys
    df = spark.createDataFrame([(i // 3, float(i)) for i in range(1000)] + [(None, -1.0)] * 31, "id long, x double")
    folds = sampling.kfold(df, "id", 10).collect()
    assert sorted(r["x"] for r in folds) == sorted(r["x"] for r in df.collect())
    assert [sum(r["fold"] == i for r in folds) for i in range(10)] == [104] + [103] * 9
    order = {r["id"]: r["u"] for r in df.select("id", sampling.hash_uniform(42, "id").alias("u")).collect()}
    seen = [(order[r["id"]] is not None, order[r["id"]] or 0.0) for r in sorted(folds, key=lambda r: r["fold"])]
    edges = [[s for s, r in zip(seen, sorted(folds, key=lambda r: r["fold"])) if r["fold"] == i] for i in range(10)]
    assert all(max(a) <= min(b) for a, b in zip(edges, edges[1:]))
    split = sampling.exact_split(df, "id", 0.25, 42)
    assert split.where("split = 'test'").count() == math.ceil(0.25 * 1031) and split.count() == 1031
    nulls = sampling.kfold(df.where("id is null"), "id", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in nulls) == [7, 8, 8, 8]
    assert numbered and max(numbered) <= 31


def test_cut_names_a_costly_key_once(spark):
    df = spark.range(5000).withColumn("id", F.col("id") * 3)
    plan = sampling.exact_split(df, "id", 0.25).where("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") <= 2
