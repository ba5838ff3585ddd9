from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statfold.operators import heavy


def _top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def _got(spark, values, k, **kw):
    df = spark.createDataFrame([(v,) for v in values], "w string" if isinstance(values[0], str) else "w long").repartition(6)
    return [tuple(r) for r in heavy.most_frequent(df, "w", k, few_partitions=0, **kw).collect()]


def test_skewed_words_by_sketch(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = [f"w{x}" for x in rng.zipf(1.3, 40_000) if x < 1 << 40]
    full = heavy.count_all
    monkeypatch.setattr(heavy, "count_all", lambda v, c, k: _only(v, full(v, c, k)))
    assert _got(spark, values, 20, tracked=512) == _top(values, 20)


def _only(values, out):
    """Only candidates may be counted: a plain count of all values would have no semi join."""
    assert "LeftSemi" in values._jdf.queryExecution().analyzed().toString()
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_flat_counts_fall_back(spark, k):
    values = list(range(3_000)) * 2 + [7, 9] * 5 + [None] * 9
    assert _got(spark, values, k, tracked=64) == _top(values, k)


def test_few_values(spark):
    assert _got(spark, ["b", "a", "b", None], 5) == [("b", 2), ("a", 1)]
    df = spark.createDataFrame([], "w string")
    assert heavy.most_frequent(df, "w", 3, few_partitions=-1).count() == 0


def test_what_is_left_out_is_less_frequent(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.zipf(1.2, 30_000) if x < 1 << 40]
    df = spark.createDataFrame([(v,) for v in values], "w long").repartition(5)
    found, outside = heavy.candidates(df, "w", 10, tracked=128)
    inside = {r[0] for r in found.collect()}
    assert {v for v, _ in _top(values, 10)} <= inside
    assert all(n <= outside for v, n in Counter(values).items() if v not in inside)
    assert found.select(F.count_distinct("w")).first()[0] == len(inside) < len(set(values)) / 4
