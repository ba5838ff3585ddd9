"""Principal components (PCA1-2), principal-component regression (REG13), k-means (CLU1).

PCA needs only the covariance / correlation matrix, i.e. the one-pass
moments; the eigen-decomposition is p x p on the driver. Scores are linear
Column expressions (centre, scale, rotate) evaluated on executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statfold.operators import gram, linear


@dataclass
class Pca:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    sdev: np.ndarray
    rotation: np.ndarray  # columns are components

    def summary(self) -> pd.DataFrame:
        var = self.sdev ** 2
        share = var / var.sum()
        return pd.DataFrame({"pc": np.arange(1, len(var) + 1), "sdev": self.sdev, "var_share": share,
                             "cum_share": np.cumsum(share)})

    def loadings(self) -> pd.DataFrame:
        rows = [(v, k + 1, float(self.rotation[i, k])) for i, v in enumerate(self.names)
                for k in range(self.rotation.shape[1])]
        return pd.DataFrame(rows, columns=["variable", "pc", "loading"])

    def score_columns(self, k: int | None = None, prefix: str = "PC") -> list[Column]:
        """PCA2: score expressions for the first k components (centred, scaled with the fit's moments)."""
        k = k or len(self.sdev)
        z = [(F.col(c).cast("double") - float(self.mean[i])) / float(self.scale[i]) for i, c in enumerate(self.names)]
        out = []
        for j in range(k):
            expr = F.lit(0.0)
            for i in range(len(self.names)):
                expr = expr + z[i] * float(self.rotation[i, j])
            out.append(expr.alias(f"{prefix}{j + 1}"))
        return out


def pca_from_moments(m: gram.Moments, cols: Sequence[str], scale: bool = True) -> Pca:
    """PCA1: ``prcomp(scale=TRUE)``; signs fixed so each component's largest loading is positive."""
    sub = m.sub(list(cols))
    cov = sub.cov(1)
    sd = np.sqrt(np.diag(cov))
    if scale:
        if np.any(sd == 0):
            raise ValueError("cannot scale a constant column")
        mat = cov / np.outer(sd, sd)
        scl = sd
    else:
        mat = cov
        scl = np.ones(len(cols))
    vals, vecs = np.linalg.eigh(mat)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    return Pca(list(cols), sub.mean, scl, np.sqrt(vals), vecs)


def pca(df: DataFrame, cols: Sequence[str], scale: bool = True) -> Pca:
    return pca_from_moments(gram.moments(df, cols), cols, scale)


@dataclass
class Pcr:
    """REG13: a regression on the first ``k`` scores, written on the columns themselves."""
    k: int
    intercept: float
    coef: dict[str, float]
    test_rmse: float | None = None

    def prediction(self) -> Column:
        return sum((F.col(c).cast("double") * F.lit(b) for c, b in self.coef.items()), F.lit(self.intercept))


def _score_moments(m: gram.Moments, weights: np.ndarray, pcs: list[str]) -> gram.Moments:
    """Moments of the scores ``x @ weights`` and of y, from those of the columns and y (the last name)."""
    w = np.zeros((len(pcs) + 1, len(m.names)))
    w[:-1, :-1], w[-1, -1] = weights.T, 1.0
    return gram.Moments([*pcs, "_y"], m.n, w @ m.mean, w @ m.comoment @ w.T)


def _fold_rmse(train: gram.Moments, fold: gram.Moments, cols: list[str], scale: bool) -> list[float]:
    """RMSE on a fold for k = 1..p, scale and components being those of the other folds; without variance they count 0."""
    if train.n < 2:
        return [math.nan] * len(cols)
    pcs = [f"PC{j + 1}" for j in range(len(cols))]
    cov = train.sub(cols).cov(1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    every = np.sqrt(np.clip(np.diag((train + fold).sub(cols).cov(1)), 0, None))
    shrink = np.where(sd > 1e-6 * every, 1 / np.where(sd > 0, sd, 1), 0) if scale else np.ones(len(cols))
    vals, vecs = np.linalg.eigh(cov * np.outer(shrink, shrink))
    weights = shrink[:, None] * vecs[:, np.argsort(vals)[::-1]]
    own, other = _score_moments(train, weights, pcs), _score_moments(fold, weights, pcs)
    var = np.diag(own.comoment)[:-1]
    live = var > 1e-12 * var.max()
    beta = np.where(live, own.comoment[:-1, -1] / np.where(live, var, 1), 0)   # scores do not correlate
    return [math.sqrt(max(linear.sse_on(other, pcs[:k], "_y", beta[:k], own.mean[-1] - own.mean[:k] @ beta[:k]), 0) / fold.n)
            for k in range(1, len(cols) + 1)]


def pcr_cv(train: DataFrame, cols: Sequence[str], y: str, fold_col: str, scale: bool = True,
           test: DataFrame | None = None) -> tuple[pd.DataFrame, Pca, Pcr]:
    """REG13: CV RMSE of regressing y on the first k scores, k = 1..p, the refit at the best k and its test RMSE.

    ``cv_rmse`` and ``mean_fold_rmse`` take the components of the whole training table, as the reference does;
    ``fold_pca_rmse`` is the mean over folds when scale and components too come from the other folds alone. The best k
    has the least ``mean_fold_rmse`` (the smaller of equal ones); the model is refitted there on all training rows and
    predicts the complete rows of ``test``, scaled as the training rows are. Components need no y.

    One grouped pass gives the moments of the columns by fold; those of the scores, and every k, follow from them.
    """
    cols = list(cols)
    value = F.col(y).cast("double")
    parts = gram.moments_by(train.select(
        F.struct(F.col(fold_col).alias("fold"), (value.isNull() | F.isnan(value)).alias("bare")).alias("_part"),
        *[F.col(c).cast("double").alias(c) for c in cols],
        F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(0.0).alias("_y")), [*cols, "_y"], "_part")
    if all(part.bare for part in parts):
        raise ValueError("no complete training row")
    p = pca_from_moments(gram.combine(list(parts.values())), cols, scale)
    raw = {part.fold: m for part, m in parts.items() if not part.bare}
    pcs = [f"PC{j + 1}" for j in range(len(cols))]
    weights = p.rotation / p.scale[:, None]
    folds = {k: _score_moments(m, weights, pcs) for k, m in raw.items()}
    total = gram.combine(list(raw.values()))
    own = np.mean([_fold_rmse(total - m, m, cols, scale) for m in raw.values()], axis=0)
    rows = []
    for k in range(1, len(cols) + 1):
        cv = linear.cv_linear(folds, pcs[:k], "_y")
        rows.append((k, float(np.sqrt((cv["mse"] * cv["n"]).sum() / cv["n"].sum())), float(cv["rmse"].mean()), float(own[k - 1])))
    table = pd.DataFrame(rows, columns=["k", "cv_rmse", "mean_fold_rmse", "fold_pca_rmse"])
    best = int(table["k"][table["mean_fold_rmse"].fillna(math.inf).idxmin()])
    beta, _, intercept = linear._fit(gram.combine(list(folds.values())), pcs[:best], "_y")
    model = Pcr(best, intercept, dict(zip(cols, (weights[:, :best] @ beta).tolist())))
    if test is not None:
        known = gram._blanked(test, [*cols, y])
        model.test_rmse = linear.mse(known.withColumn("_pred", model.prediction()), y, "_pred").first()["rmse"]
    return table, p, model


def _assigned(centers: np.ndarray, schema):
    """mapInArrow body: per centre of every restart the count and sums of its rows, and their squared distances."""
    import pyarrow as pa

    def run(batches):
        runs, k, d = centers.shape
        count, total, cost = np.zeros((runs, k), np.int64), np.zeros((runs, k, d)), np.zeros((runs, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for r in range(runs):
                apart = np.stack([((x - c) ** 2).sum(axis=1) for c in centers[r]], axis=1)
                near = apart.argmin(axis=1)
                count[r] += np.bincount(near, minlength=k)
                cost[r] += np.bincount(near, apart[np.arange(len(x)), near], minlength=k)
                for j in range(d):
                    total[r, :, j] += np.bincount(near, x[:, j], minlength=k)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(runs, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), runs)),
            pa.array(count.ravel()), pa.array(cost.ravel()), *[pa.array(total[:, :, j].ravel()) for j in range(d)]],
            schema=schema)
    return run


def lloyd_together(rows: DataFrame, starts: np.ndarray, max_iter: int = 300, tol: float = 0.0):
    """k-means from every start at once: (centres, cost of each run, passes over the rows).

    ``rows`` has numeric columns without nulls, ``starts`` is runs x k x columns. A pass assigns each row to the
    nearest centre of every run that still moves and sums counts and coordinates per task, so only
    runs x k sums a task are shuffled. A run whose centres move by at most ``tol`` (squared, in all) is measured
    once more and drops out. A centre without rows stays where it is.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    runs, k, d = starts.shape
    schema = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("cost", T.DoubleType()),
                           *[T.StructField(f"s{i}", T.DoubleType()) for i in range(d)]])
    centers, cost = starts.astype(float).copy(), np.full(runs, np.inf)
    live, settled, passes = list(range(runs)), set(), 0
    while live:
        found = rows.mapInArrow(_assigned(centers[live], to_arrow_schema(schema)), schema).groupBy("r", "j").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)]).collect()
        passes += 1
        count, total, spent = np.zeros((len(live), k)), np.zeros((len(live), k, d)), np.zeros(len(live))
        for row in found:
            count[row["r"], row["j"]] = row["n"]
            total[row["r"], row["j"]] = [row[f"s{i}"] for i in range(d)]
            spent[row["r"]] += row["cost"]
        still = []
        for at, r in enumerate(live):
            cost[r] = spent[at]
            if r in settled:
                continue
            moved = np.where(count[at][:, None] > 0, total[at] / np.maximum(count[at], 1)[:, None], centers[r])
            shift = ((moved - centers[r]) ** 2).sum()
            if shift == 0:
                continue
            centers[r] = moved
            if shift <= tol or passes >= max_iter:
                settled.add(r)
            still.append(r)
        live = still
    return centers, cost, passes


START_POOL = 4_096   # rows, chosen by hash, from which the starts are drawn


def random_starts(rows: DataFrame, k: int, restarts: int, seed: int = 0) -> np.ndarray:
    """``restarts`` draws of k different rows out of a pool of at most ``START_POOL`` rows."""
    cols = rows.columns
    pool = rows.withColumn("_h", F.xxhash64(F.lit(seed), *cols)).orderBy("_h").limit(START_POOL).drop("_h").toPandas()
    points = np.unique(pool.to_numpy(dtype=float).reshape(len(pool), len(cols)), axis=0)
    k = min(k, len(points))
    return np.stack([points[np.random.default_rng([seed, r]).choice(len(points), k, replace=False)] for r in range(restarts)])


def kmeans_best_of(df: DataFrame, features: Sequence[str], k: int = 2, restarts: int = 10, max_iter: int = 300,
                   tol: float = 1e-4, seed: int = 0, scale: bool = True):
    """CLU1: k-means with random starts, the lowest-cost of ``restarts`` runs, all of which share each pass.

    ``tol`` is relative to the mean variance of the features. Returns (assignments DataFrame with ``cluster``,
    centroids pandas frame, cost). Rows with a null or NaN feature are left out.
    """
    cols = list(features)
    if scale:
        from statfold.operators.scale import standardize
        df = standardize(df, cols, ddof=0)
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    data = df.where(keep)
    rows = data.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).persist()
    variance = rows.agg(*[F.var_pop(c).alias(c) for c in rows.columns]).first()
    starts = random_starts(rows, k, restarts, seed)
    centers, cost, _ = lloyd_together(rows, starts, max_iter, tol * float(np.mean([v or 0.0 for v in variance])))
    rows.unpersist()
    best = int(cost.argmin())
    apart = F.array(*[sum((F.pow(F.col(c).cast("double") - F.lit(float(x)), 2) for c, x in zip(cols, center)), F.lit(0.0))
                      for center in centers[best]])
    out = data.withColumn("_apart", apart).withColumn(
        "cluster", (F.array_position("_apart", F.array_min("_apart")) - 1).cast("int")).drop("_apart")
    frame = pd.DataFrame(centers[best], columns=cols)
    frame.insert(0, "cluster", range(len(frame)))
    return out, frame, float(cost[best])


def explained_variance_check(p: Pca) -> float:
    """Share of variance of the first component (handy in tests)."""
    v = p.sdev ** 2
    return float(v[0] / v.sum()) if v.sum() > 0 else math.nan
