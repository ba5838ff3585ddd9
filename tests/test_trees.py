import math

import numpy as np
import pytest

from statfold.operators import trees


def _exhaustive(x, y, rows, least):
    """Best (gain, feature, threshold) of all splits, one by one; the first feature and smallest value on ties."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for low, high in zip(values, values[1:]):
            left = rows[x[rows, f] <= low]
            right = rows[x[rows, f] > low]
            if len(left) < least or len(right) < least:
                continue
            sse = lambda r: ((y[r] - y[r].mean()) ** 2).sum()
            gain = sse(rows) - sse(left) - sse(right)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (low + high) / 2)
    return best if best and best[0] > 1e-9 else None


def _grow(x, y, rows, least, depth, at=0):
    found = _exhaustive(x, y, rows, least) if depth else None
    if not found:
        return {at: (len(rows), None, None, y[rows].mean())}
    _, f, t = found
    inside = x[rows, f] <= t
    return {at: (len(rows), f, t, y[rows].mean()), **_grow(x, y, rows[inside], least, depth - 1, 2 * at + 1),
            **_grow(x, y, rows[~inside], least, depth - 1, 2 * at + 2)}


@pytest.mark.parametrize("seed,fraction", [(1, 0.1), (2, 0.02)])
def test_thresholds_equal_exhaustive_search(spark, seed, fraction):
    rng = np.random.default_rng(seed)
    n = 300
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n).round(1)])
    y = np.where(x[:, 0] > 0.3, 4.0, 0) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    tree = trees.regression_tree(df.repartition(5), ["a", "b", "c"], "y", 4, fraction)
    want = _grow(x, y, np.arange(n), math.ceil(fraction * n), 4)
    assert set(tree.nodes) == set(want) and len(want) > 8
    for k, (rows, f, t, mean) in want.items():
        node = tree.nodes[k]
        assert (node.n, node.feature) == (rows, None if f is None else "abc"[f])
        assert node.threshold == (None if t is None else pytest.approx(t, abs=1e-12))
        assert tree.value(node) == pytest.approx(mean, abs=1e-9)
    leaf = {r["k"]: r["n"] for r in df.groupBy(tree.node_of().alias("k")).count().withColumnRenamed("count", "n").collect()}
    assert leaf == {k: w[0] for k, w in want.items() if w[1] is None}
    got = tree.transform(df).selectExpr("avg((prediction - y) * (prediction - y)) m").first()["m"]
    assert got == pytest.approx(sum(((y[r] - y[r].mean()) ** 2).sum() for r in _leaves(x, want)) / n, rel=1e-9)


def _leaves(x, tree, at=0, rows=None):
    rows = np.arange(len(x)) if rows is None else rows
    _, f, t, _ = tree[at]
    if f is None:
        return [rows]
    inside = x[rows, f] <= t
    return _leaves(x, tree, 2 * at + 1, rows[inside]) + _leaves(x, tree, 2 * at + 2, rows[~inside])


def test_awkward_tables(spark):
    schema = "a double, b int, y double"
    hot = [(1.0, 1, 5.0)] * 200 + [(2.0, 1, 9.0)] * 100 + [(None, 1, 3.0), (float("nan"), 2, 3.0), (1.0, 1, None)]
    tree = trees.regression_tree(spark.createDataFrame(hot, schema).repartition(4), ["a", "b"], "y")
    assert [(n.id, n.n, n.feature, n.threshold) for n in tree.nodes.values()] == [
        (0, 300, "a", 1.5), (1, 200, None, None), (2, 100, None, None)]
    same = trees.regression_tree(spark.createDataFrame([(1.0, 1, 2.0)] * 9, schema), ["a", "b"], "y")
    assert list(same.nodes) == [0] and same.value(same.nodes[0]) == 2.0
    none = trees.regression_tree(spark.createDataFrame([], schema), ["a", "b"], "y")
    assert list(none.nodes) == [0]


def test_one_pass_serves_all_runs(spark):
    from statfold.operators import reduce
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 2)) + c for c in ((0, 0), (5, 1), (2, 6))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "x0 double, x1 double").repartition(4)
    starts = reduce.random_starts(df, 3, 10, 4)
    assert starts.shape == (10, 3, 2)
    centers, cost, passes = reduce.lloyd_together(df, starts)
    longest = 0
    for r in range(10):
        c, steps = starts[r].copy(), 0
        while True:
            steps += 1
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(3)])
            if np.array_equal(moved, c):
                break
            c = moved
        longest = max(longest, steps)
        assert np.allclose(centers[r], c) and cost[r] == pytest.approx(((x[:, None] - c) ** 2).sum(2).min(1).sum())
    assert passes <= longest + 3
    out, frame, best = reduce.kmeans_best_of(df, ["x0", "x1"], 3, 10, scale=False, seed=4, tol=0.0)
    assert best == pytest.approx(cost.min())
    again = out.groupBy("cluster").agg({"x0": "avg", "x1": "avg"}).orderBy("cluster").collect()
    assert np.allclose([[r["avg(x0)"], r["avg(x1)"]] for r in again], frame[["x0", "x1"]].to_numpy())


def test_few_different_rows_and_nulls(spark):
    from statfold.operators import reduce
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(None, 1.0)], "a double, b double")
    out, frame, cost = reduce.kmeans_best_of(df, ["a", "b"], 3, 2, scale=False)
    assert len(frame) == 1 and cost == 0.0 and out.count() == 5
