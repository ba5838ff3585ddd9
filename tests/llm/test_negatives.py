import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statfold.llm import negatives
from statfold.llm.negatives import FAR, hard_negatives, scaled, walk
from statfold.llm.queries import NEGATIVES_SQL, QUERIES
from tests.llm.helpers import rows

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(data, is_anchor, positives=5, negatives=3, low=50, high=95):
    data = [(i, v, y) for i, v, y in data if y is not None and v is not None and None not in v]
    dims = max((len(v) for _, v, _ in data), default=0)
    vecs = [[*map(int, v), *[0] * (dims - len(v))] for _, v, _ in data]
    out = []
    for a, (ai, _, ay) in enumerate(data):
        if ai is None or not is_anchor(ai):
            continue
        scored = sorted(((-sum(x * z for x, z in zip(vecs[a], vecs[b])), bi is None, bi or 0, b)
                         for b, (bi, _, _) in enumerate(data) if b != a))
        mine = [s for s in scored if data[s[3]][2] == ay][:positives]
        for p in mine:
            fit = [s for s in scored if data[s[3]][2] != ay and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(ai, data[p[3]][0], k + 1, data[s[3]][0], -p[0], -s[0]) for k, s in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def frame(spark, data):
    full = [(i, v, y, "r", 1, "z") for i, v, y in data]
    return spark.createDataFrame(full, "id long, vec array<long>, label int, rid string, score int, cell string").repartition(3)


def clouds(n, dims, seed, parts=6):
    """Clustered whole-number vectors with many ties."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-12, 13, (parts, dims))
    return [(k, [int(x) for x in middle[k % parts] + rng.integers(-4, 5, dims)], int(rng.integers(0, 4))) for k in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "CLUSTER_ROWS", 6)
    monkeypatch.setattr(negatives, "STEP", 8)
    for seed, dims in ((1, 3), (2, 10)):
        data = clouds(500, dims, seed)
        got = rows(hard_negatives(frame(spark, data), F.col("id") % 4 == 0), *COLUMNS)
        assert got == brute(data, lambda i: i % 4 == 0) and got


AWKWARD = [(0, [3, 4], 1), (0, [3, 4], 1), (None, [4, 4], 1), (None, [2, 2], 2), (2, None, 1), (4, [1, None], 1),
           (6, [5, 5], None), (8, [0, 0], 1), (9, [], 2), (10, [1, 1, 1], 1), (11, [-3, -4], 1), (12, [3, 3], 2),
           (13, [3, 3], 2), (14, [2, 4], 3), (16, [-1, 0], 7), (20, [2 ** 40, 1], 1), (21, [2 ** 40, 0], 2)]


def test_awkward_rows(spark):
    got = rows(hard_negatives(frame(spark, AWKWARD), F.col("id") % 2 == 0), *COLUMNS)
    cut = [(i, v and [x and min(x, 1 << 26) for x in v], y) for i, v, y in AWKWARD]
    assert got == brute(cut, lambda i: i % 2 == 0) and got


def test_no_rows(spark):
    assert hard_negatives(frame(spark, []), F.col("id") % 2 == 0).count() == 0
    assert hard_negatives(frame(spark, [(1, [1], 1)]), F.col("id") % 2 == 0).count() == 0
    assert hard_negatives(frame(spark, [(2, [1], 1)]), F.col("id") % 2 == 0).count() == 0


def test_one_vector_for_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    data = [(i, [9, 9, 1] if i % 3 == 0 else v, y) for i, v, y in clouds(600, 3, 5)]
    got = rows(hard_negatives(frame(spark, data), F.col("id") % 10 == 0), *COLUMNS)
    assert got == brute(data, lambda i: i % 10 == 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(-5, 5), min_size=2, max_size=2), st.integers(0, 2)), min_size=1, max_size=30),
       st.integers(1, 4), st.booleans())
def test_walk_keeps_the_best(points, keep, same):
    v, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
    n = len(v)
    block = {"v": v, "y": y, "rid": np.arange(n), "id": np.arange(n)[::-1].copy(), "null": np.zeros(n, bool)}
    member = {"v": v[:4], "y": y[:4], "rid": np.arange(min(4, n)), "low": np.full((min(4, n), 1), -FAR + 1),
              "high": np.full((min(4, n), 1), 7), "bar": np.full((min(4, n), 1), -FAR + 1)}
    old, negatives.STEP = negatives.STEP, 3
    try:
        got = walk(member, block, keep, same)
    finally:
        negatives.STEP = old
    for i in range(min(4, n)):
        fit = sorted((-(v[i] @ v[j]), block["id"][j], j) for j in range(n)
                     if (y[i] == y[j]) == same and (i != j) and v[i] @ v[j] <= 7)[:keep]
        assert [int(p) for p in got["place"][got["member"] == i]] == [j for _, _, j in fit]


def test_the_walk_ends_early():
    """Far fewer scores than pairs on clustered vectors: the bound certifies the rest."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16)) * 100
    v = np.floor(middle[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 5)
    near = np.argsort(((v - middle[3]) ** 2).sum(axis=1))[:40]
    full = lambda x: np.full((40, 1), x)
    y = np.zeros(4000, int)
    got = walk({"v": v[near], "y": y[near], "rid": near, "low": full(-FAR + 1), "high": full(FAR), "bar": full(-FAR + 1)},
               {"v": v, "y": y, "rid": np.arange(4000), "id": np.arange(4000), "null": np.zeros(4000, bool)}, 5, True)
    assert got["taken"] <= 40 * 4000 / 5


def test_scaled_vectors(spark):
    table = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None],), (None,), ([],)],
                                  "v array<float>")
    assert [r[0] for r in table.coalesce(1).select(scaled(table, "v")).collect()] == [[128, -1], None, None, None, None, []]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    got = QUERIES["op13_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert [f"{c} {t}" for c, t in got.dtypes] == ["anchor_id bigint", "positive_id bigint", "rank int", "negative_id bigint",
                                                    "positive_score bigint", "negative_score bigint"]
    assert rows(got, *COLUMNS) == sorted(duckdb.sql(NEGATIVES_SQL).fetchall(), key=str)
