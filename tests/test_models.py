"""Model queries that read the rows a bounded number of times give what passing over every row gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statfold.operators import diag, evaluate, glm, gram, reduce


def _deviance(x, y, offset, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-(x @ b + offset)))
        b = b + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-(x @ b + offset)))
    return -2 * float(np.sum(np.log(np.where(y == 1, mu, 1 - mu)))), b


def test_profile_intervals_read_counted_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 2000).astype(float)
    y = (rng.random(2000) < 0.2 + 0.1 * a).astype(float)
    written = []

    def seen(df):
        written.append(df.count())
        return cut(df)
    cut = diag.cut_lineage
    monkeypatch.setattr(diag, "cut_lineage", seen)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(a, y)], "a double, y double")
    got = diag.profile_intervals(df, "y", ["a"], "binomial").first()
    assert written == [4]
    ones = np.ones((2000, 1))
    least, b = _deviance(np.column_stack([ones, a]), y, np.zeros(2000))
    assert got["estimate"] == pytest.approx(b[1], rel=1e-6)
    for bound in ("profile_lo", "profile_hi"):
        assert math.sqrt(_deviance(ones, y, got[bound] * a)[0] - least) == pytest.approx(1.959964, abs=2e-4)


def test_gaussian_models_and_auc(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)).round(2)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v), "gh"[i % 2]) for i, (r, v) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, "g")],
                               "a double, b double, y double, g string").repartition(4)

    def refuse(*args, **kwargs):
        raise AssertionError("many passes over the rows")
    monkeypatch.setattr(glm.GeneralizedLinearRegression, "fit", refuse)
    monkeypatch.setattr(evaluate, "running_sum", refuse)
    got = glm.compare_models(df, "y", {"m": ["a", "C(g)"]}).first()
    full = np.column_stack([np.ones(400), x[:, 0], np.arange(400) % 2])
    p = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    rss = float(((y - p) ** 2).sum())
    assert got["aic"] == pytest.approx(400 * (math.log(2 * math.pi * rss / 400) + 1) + 2 + 6, rel=1e-9)
    p = p.round(12)
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    assert got["auc"] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean(), abs=1e-3)
    assert got["false_negatives"] == int(((y == 1) & (p <= 0.5)).sum())
    scores = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (1, 0.1)], "y int, p double").repartition(3)
    assert evaluate.auc(scores, "y", "p").first()[:] == (pytest.approx(4 / 6), 3, 2)


def test_moments_do_not_filter_derived_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (None, 5.0, 0), (3.0, float("nan"), 1), (4.0, 7.0, 0)], "a double, b double, k int")
    m = gram.moments_by(df, ["a", "b"], "k")
    assert list(m) == [0] and m[0].n == 2 and m[0].mean.tolist() == [2.5, 4.5]
    derived = df.withColumn("a", F.length(F.md5(F.col("a").cast("string"))).cast("double"))
    plan = gram._blanked(derived, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan and plan.count("md5(") == 1


def test_words_and_encoding_call_no_lambda_per_word(spark):
    from statfold.operators import text
    df = spark.createDataFrame([(1, "Äb1 c--C;"), (2, "..."), (3, ""), (4, None), (5, "b  äB1")], "id long, t string")
    told = df.select("id", text.words("t").alias("w"))
    assert dict(map(tuple, told.collect())) == {1: ["äb1", "c", "c"], 2: [], 3: [], 4: None, 5: ["b", "äb1"]}
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
    vocab = text.build_vocabulary(df, "t")
    assert {r["word"]: r["token_id"] for r in vocab.collect()} == {"c": 4, "äb1": 5, "b": 6}
    enc = {r["id"]: r["input_ids"] for r in text.encode(df, "id", "t", vocab, 5).collect()}
    assert enc[1] == [2, 5, 4, 4, 3] and enc[5] == [2, 6, 5, 3, 0] and enc[2] == [2, 3, 0, 0, 0]


def _pcr(x, y, fold, k, inside):
    """Mean fold RMSE and RMSE over all rows of a regression on k components, fitted ``inside`` the folds or on all rows."""
    def components(rows):
        mean, sd = x[rows].mean(axis=0), x[rows].std(axis=0, ddof=1)
        v = np.linalg.svd((x[rows] - mean) / sd, full_matrices=False)[2]
        return lambda at: ((x[at] - mean) / sd) @ v[:k].T
    errors = []
    for f in np.unique(fold):
        rows, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        score = components(rows if inside else np.arange(len(x)))
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(rows)), score(rows)]), y[rows], rcond=None)[0]
        errors.append((y[out] - np.column_stack([np.ones(len(out)), score(out)]) @ beta) ** 2)
    return np.mean([np.sqrt(e.mean()) for e in errors]), np.sqrt(np.concatenate(errors).mean())


def test_component_regression_is_refitted_and_tested(spark):
    rng = np.random.default_rng(8)
    n = 260
    base = rng.normal(size=(n, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 3 + rng.normal(size=n), base[:, 1] * 0.1, rng.normal(size=n) * 50 + 7])
    y = 2 * base[:, 0] + base[:, 1] + rng.normal(size=n) * 2
    fold = rng.integers(0, 5, n)
    part = np.where(np.arange(n) < 200, "train", "test")
    rows = [(*map(float, r), float(v), int(f), t) for r, v, f, t in zip(x, y, fold, part)]
    # incomplete rows take no part, on either side
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 0, "train"), (1.0, 1.0, None, 1.0, 9.0, 0, "test"), (1.0, 1.0, 1.0, 1.0, None, 0, "test"),
             (1.0, 1.0, 1.0, 1.0, math.nan, 0, "test")]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int, part string").repartition(3)
    cols = list("abcd")
    table, p, model = reduce.pcr_cv(df.where("part = 'train'"), cols, "y", "fold", test=df.where("part = 'test'"))
    x, y, fold, far, goal = x[:200], y[:200], fold[:200], x[200:], y[200:]
    for k, cv, mean, own in table.itertuples(index=False):
        assert (mean, cv) == pytest.approx(_pcr(x, y, fold, k, False), rel=1e-9)
        assert own == pytest.approx(_pcr(x, y, fold, k, True)[0], rel=1e-9)
    assert model.k == table["k"][table["mean_fold_rmse"].idxmin()]
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    v = np.linalg.svd((x - mean) / sd, full_matrices=False)[2][:model.k].T
    beta = np.linalg.lstsq(np.column_stack([np.ones(200), (x - mean) / sd @ v]), y, rcond=None)[0]
    off = goal - np.column_stack([np.ones(60), (far - mean) / sd @ v]) @ beta
    assert model.test_rmse == pytest.approx(np.sqrt((off ** 2).mean()), rel=1e-9)


def test_components_come_from_rows_without_y_too(spark):
    rows = [(float(i), float(i % 5), float(i * i % 7), i % 3) for i in range(30)] + [(40.0, 9.0, None, 0), (-3.0, 2.0, math.nan, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    _, p, model = reduce.pcr_cv(df, ["a", "b"], "y", "fold")
    want = reduce.pca(df, ["a", "b"])
    assert np.allclose(p.mean, want.mean) and np.allclose(p.rotation, want.rotation) and np.allclose(p.scale, want.scale)
    assert model.test_rmse is None and set(model.coef) == {"a", "b"}


def test_a_column_that_only_one_fold_varies(spark):
    rows = [(float(i % 6), float(i == 3), float(i), i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    table, _, _ = reduce.pcr_cv(df.where("fold <> 3 or b = 1"), ["a", "b"], "y", "fold")
    assert len(table) == 2 and table["fold_pca_rmse"].between(0, 100).all()
