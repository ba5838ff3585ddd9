import numpy as np
import pytest
from pyspark.sql import functions as F

from statfold.operators import neighbors


def _points(spark, n, seed):
    rng = np.random.default_rng(seed)
    pts = rng.normal(size=(n, 4)).round(1)  # rounding creates distance ties
    return spark.createDataFrame([(i, [float(v) for v in p], int(i % 3)) for i, p in enumerate(pts)],
                                 "id long, v array<double>, y long"), pts


def test_blocked_knn_matches_brute_force(spark):
    df, pts = _points(spark, 120, 5)
    q, r = df.where("id < 30"), df.where("id >= 30")
    got = neighbors.nearest(q, r, "id", "v", "y", 7, block_rows=16)
    got = {(row["qid"], row["rank"]): row["rid"] for row in got.collect()}
    for i in range(30):
        d = ((pts[30:] - pts[i]) ** 2).sum(1)
        ids = np.arange(30, 120)
        order = np.lexsort((ids, d))[:7]
        assert [got[(i, k + 1)] for k in range(7)] == list(ids[order])


def test_smote_points_lie_between_minority_neighbours(spark):
    df, pts = _points(spark, 60, 9)
    lab = df.withColumn("y", (F.col("id") < 12).cast("long"))
    out = neighbors.smote(lab, "id", "v", "y", k=3, seed=1, block_rows=8)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts[(1, True)] + counts[(1, False)] == counts[(0, False)]
    minority = pts[:12]
    for row in out.where("synthetic").collect():
        x = np.array(row["v"])
        # on a segment between two minority points: some pair (a, b) with x = a + u (b - a), 0 <= u <= 1
        ok = False
        for a in minority:
            for b in minority:
                d = b - a
                if not d.any():
                    continue
                u = float(np.dot(x - a, d) / np.dot(d, d))
                if -1e-9 <= u <= 1 + 1e-9 and np.allclose(a + u * d, x, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


@pytest.mark.parametrize("share", [65_536, 20])
def test_hot_vectors_ties_and_few_rows(spark, monkeypatch, share):
    """A third of all rows share one vector; cells smaller than k; fewer rows than k; blocks with many queries."""
    monkeypatch.setattr(neighbors, "SHARE_ROWS", share)
    rng = np.random.default_rng(3)
    pts = [[5.0, 5.0] if i % 3 == 0 else [float(x) for x in rng.integers(-9, 10, 2)] for i in range(400)]
    df = spark.createDataFrame([(i, p, i % 4) for i, p in enumerate(pts)], "id long, v array<double>, y int").repartition(5)
    got = neighbors.nearest(df, df, "id", "v", "y", 30, block_rows=50, exclude_self=True).collect()
    got = {(r["qid"], r["rank"]): r["rid"] for r in got}
    m = np.array(pts)
    for i in range(400):
        d = ((m - m[i]) ** 2).sum(1)
        order = [int(j) for j in np.lexsort((np.arange(400), d)) if j != i][:30]
        assert [got[(i, k + 1)] for k in range(30)] == order
    few = neighbors.nearest(df.where("id < 3"), df.where("id < 5"), "id", "v", None, 9, exclude_self=True)
    assert {tuple(r) for r in few.groupBy("qid").count().collect()} == {(0, 4), (1, 4), (2, 4)}
    assert neighbors.nearest(df, df.where("id < 0"), "id", "v", "y", 3).count() == 0
    assert neighbors.nearest(df.where("id < 0"), df, "id", "v", "y", 3).count() == 0


def test_clustered_rows_compare_a_fifth_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 8)) * 50
    pts = middle[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in p], 0) for i, p in enumerate(pts)], "id long, v array<double>, y int")
    looked = spark.sparkContext.accumulator(0)
    q = df.where("id % 10 = 0")
    got = neighbors.nearest(q, df, "id", "v", "y", 5, block_rows=1024, exclude_self=True, looked_at=looked).collect()
    assert 0 < looked.value <= 600 * 6000 / 5
    got = {(r["qid"], r["rank"]): r["rid"] for r in got}
    for i in range(0, 6000, 10):
        d = ((pts - pts[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[(i, k + 1)] for k in range(5)] == np.argsort(d, kind="stable")[:5].tolist()


def test_looks_only_inside_the_radius():
    r = {"d": np.arange(1000.0), "id": np.arange(1000), "v": np.stack([np.arange(1000.0), np.zeros(1000)], 1)}
    q = {"d": np.array([500.2]), "radius": np.array([2.5]), "v": np.array([[500.2, 0.0]]), "id": np.array([-1])}
    i, j, d2, looked = neighbors.near_rows(q, r, 3, False, 1e-6)
    assert j.tolist() == [500, 501, 499] and looked == 5


def test_rows_at_one_distance_stay_bounded_in_memory():
    """4,096 equal rows leave a million pairs to 256 queries; before, all their differences were held (1 GB)."""
    import tracemalloc

    import numpy as np

    from statfold.operators.neighbors import near_rows
    rng = np.random.default_rng(1)
    same, q = np.repeat(rng.normal(size=(1, 64)), 4096, axis=0), rng.normal(size=(256, 64))
    block = {"v": same, "id": np.arange(4096), "d": np.zeros(4096)}
    asked = {"v": q, "id": np.arange(5000, 5256), "d": np.zeros(256), "radius": np.full(256, np.inf)}
    tracemalloc.start()
    i, j, exact, _ = near_rows(asked, block, 5, False, 1e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20, peak
    assert i.tolist() == np.repeat(np.arange(256), 5).tolist() and j.tolist() == [0, 1, 2, 3, 4] * 256
    assert np.array_equal(exact, np.repeat(((q - same[0]) ** 2).sum(axis=1), 5))
