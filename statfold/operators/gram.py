"""One-pass moment aggregate: n, means and centred cross-products per group.

Every linear method here (OLS, ANOVA type II, ridge, lasso, subsets, PCA,
PCR, k-fold CV) needs only these moments. They are computed by one
``groupBy`` of plain ``sum``s of products of mean-shifted values (the
shift comes from a bounded sample, so the sums do not cancel; partial sums
are combined map-side); each group returns one row of
``p(p+1)/2`` numbers, so what reaches the driver is model-sized, never
data-sized. Groups (e.g. folds) are merged exactly with the parallel-axis
rule, so "all folds but k" costs no extra pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    names: list[str]
    n: float
    mean: np.ndarray
    comoment: np.ndarray  # sum of (x - mean)(x - mean)^T

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return self
        mean = (self.n * self.mean + other.n * other.mean) / n
        d1, d2 = self.mean - mean, other.mean - mean
        c = self.comoment + other.comoment + self.n * np.outer(d1, d1) + other.n * np.outer(d2, d2)
        return Moments(self.names, n, mean, c)

    def __sub__(self, other: Moments) -> Moments:
        """Moments of the rows in ``self`` that are not in ``other``."""
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / n
        c = self.comoment - other.comoment - other.n * np.outer(other.mean - self.mean, other.mean - self.mean) \
            - n * np.outer(mean - self.mean, mean - self.mean)
        return Moments(self.names, n, mean, c)

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def sub(self, names: Sequence[str]) -> Moments:
        idx = self.index(names)
        return Moments(list(names), self.n, self.mean[idx], self.comoment[np.ix_(idx, idx)])

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.comoment / (self.n - ddof)


SHIFT_SAMPLE_ROWS = 100_000


def _shift(data: DataFrame, cols: list[str]) -> list[float]:
    """A centring shift close to the means, read from a bounded sample.

    Sums of products of shifted values lose no precision as long as the
    shift is within a few standard deviations of the mean; any shift gives
    the same result mathematically.
    """
    row = data.limit(SHIFT_SAMPLE_ROWS).agg(*[F.avg(c).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    return [float(row[f"_s{i}"]) if row is not None and row[f"_s{i}"] is not None else 0.0 for i in range(len(cols))]


def moment_aggregates(cols: Sequence[str], shift: Sequence[float], counted: str | None = None) -> list[Column]:
    """count (of non-null ``counted``), sums and sums of products of the shifted columns (plain SUMs: codegen-friendly)."""
    cols = list(cols)
    sh = [F.col(c) - F.lit(float(s)) for c, s in zip(cols, shift)]
    aggs = [F.count(F.col(counted) if counted else F.lit(1)).alias("_n")]
    aggs += [F.sum(x).alias(f"_m{i}") for i, x in enumerate(sh)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.sum(sh[i] * sh[j]).alias(f"_c{i}_{j}"))
    return aggs


def _to_moments(row, names: list[str], shift: Sequence[float]) -> Moments:
    p = len(names)
    n = float(row["_n"])
    s1 = np.array([float(row[f"_m{i}"] or 0.0) for i in range(p)])
    s2 = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            v = row[f"_c{i}_{j}"]
            s2[i, j] = s2[j, i] = float(v) if v is not None else 0.0
    mean = np.array(shift) + (s1 / n if n else 0.0)
    c = s2 - (np.outer(s1, s1) / n if n else 0.0)
    return Moments(list(names), n, mean, c)


def _complete(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    keep = ([F.col(key)] if key else []) + [F.col(c).cast("double").alias(c) for c in cols]
    return df.select(*keep).na.drop("any", subset=cols)


def _blanked(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """Every row, with null in all of ``cols`` unless it is complete, and ``_full`` (1 or null).

    The sums leave nulls out. A filter would be pushed below the columns and work out each derived one again.
    """
    keep = [F.col(key)] if key else []
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    full = F.lit(True)
    for c in cols:   # as ``na.drop``: NaN counts as missing
        full = full & F.col(c).isNotNull() & ~F.isnan(c)
    marked = doubles.withColumn("_full", F.when(full, F.lit(1)))
    return marked.select(*keep, "_full", *[F.when(F.col("_full") == 1, F.col(c)).alias(c) for c in cols])


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Moments of complete rows (any null in ``cols`` drops the row)."""
    cols = list(cols)
    shift = _shift(_complete(df, cols), cols)
    row = _blanked(df, cols).agg(*moment_aggregates(cols, shift, "_full")).first()
    return _to_moments(row, cols, shift)


def moments_by(df: DataFrame, cols: Sequence[str], key: str) -> dict:
    """Moments per value of ``key`` (one output row per key, e.g. per fold)."""
    cols = list(cols)
    shift = _shift(_complete(df, cols, key), cols)
    out = {}
    for row in _blanked(df, cols, key).groupBy(key).agg(*moment_aggregates(cols, shift, "_full")).collect():
        if row["_n"]:
            out[row[key]] = _to_moments(row, cols, shift)
    return out


def combine(parts: Sequence[Moments]) -> Moments:
    total = parts[0]
    for m in parts[1:]:
        total = total + m
    return total
