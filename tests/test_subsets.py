import itertools
import time

import numpy as np
import pytest

from statfold.operators import gram, linear


def _moments(x, y):
    data = np.column_stack([x, y])
    names = [f"x{i}" for i in range(x.shape[1])] + ["y"]
    mean = data.mean(axis=0)
    return gram.Moments(names, float(len(data)), mean, (data - mean).T @ (data - mean))


def _table(n, p, seed, related=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + related * rng.normal(size=(n, 1))
    y = x[:, ::3].sum(axis=1) - 0.7 * x[:, 1] + rng.normal(size=n) * 2
    return x, y


def _every_subset(m, xs):
    best = {}
    for size in range(1, len(xs) + 1):
        best[size] = min((linear._subset_rss(m, xs, "y", linear._mask(c)), linear._mask(c))
                         for c in itertools.combinations(range(len(xs)), size))
    return best


@pytest.mark.parametrize("seed,related", [(1, 0.0), (2, 1.5), (3, 6.0)])
def test_equals_all_subsets(seed, related):
    x, y = _table(200, 8, seed, related)
    m, xs = _moments(x, y), [f"x{i}" for i in range(8)]
    want = _every_subset(m, xs)
    got = linear.best_subsets(m, xs, "y", "exhaustive")
    assert got["size"].tolist() == list(range(1, 9))
    for row in got.itertuples():
        assert row.rss == pytest.approx(want[row.size][0], rel=1e-9)
        assert row.variables == ",".join(x for i, x in enumerate(xs) if want[row.size][1] >> i & 1)
    assert linear.best_subsets(m, xs, "y", "exhaustive", nvmax=3)["size"].tolist() == [1, 2, 3]


def test_dependent_variables():
    x, y = _table(150, 5, 4)
    x = np.column_stack([x, x[:, 0] + x[:, 3], x[:, 1], np.ones(150)])
    m, xs = _moments(x, y), [f"x{i}" for i in range(8)]
    want = _every_subset(m, xs)
    for row in linear.best_subsets(m, xs, "y", "exhaustive").itertuples():
        assert row.rss == pytest.approx(want[row.size][0], rel=1e-6)


@pytest.mark.parametrize("related", [0.0, 1.0])
def test_twenty_variables_in_seconds(related):
    x, y = _table(2000, 20, 5, related)
    m = _moments(x, y)
    t = time.time()
    best, looked = linear.search_subsets(m.comoment, 20)
    assert time.time() - t < 20 and looked < (1 << 20) / 10
    greedy = linear.best_subsets(m, m.names[:-1], "y", "seqrep")
    for row in greedy.itertuples():
        assert best[row.size][0] <= row.rss * (1 + 1e-9)
