"""Scaling and encoding (SCL1-2, ENC1-3).

Scalers are fitted with one aggregate (one row of moments) and applied with
a broadcast join of that row: fit on train, apply to test (quirk Q8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statfold.operators.profile import distinct_levels


def fit_standard(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Moments for z-scores: ddof=1 (R ``scale``), ddof=0 (sklearn ``StandardScaler``)."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    return df.agg(*[a for c in cols for a in (F.avg(c).alias(f"_mean__{c}"), sd(c).alias(f"_sd__{c}"))])


def apply_standard(df: DataFrame, fitted: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Apply a fitted scaler (a zero-variance column stays 0, not NaN)."""
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(fitted.withColumn("_one", F.lit(1))), "_one")
    for c in cols:
        sd = F.col(f"_sd__{c}")
        z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_mean__{c}")) / sd)
        j = j.withColumn(f"{c}{suffix}", z)
    return j.drop("_one", *[f"_{s}__{c}" for c in cols for s in ("mean", "sd")])


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1, fit_on: DataFrame | None = None) -> DataFrame:
    """SCL1 / SCL2: fit on ``fit_on`` (default: ``df`` itself) and apply to ``df``."""
    return apply_standard(df, fit_standard(fit_on if fit_on is not None else df, cols, ddof), cols)


def levels_of(df: DataFrame, col: str, max_levels: int = 1000) -> list:
    return distinct_levels(df, [col], max_levels)[col]


def one_hot_wide(df: DataFrame, cols: Sequence[str], levels: dict | None = None, drop: bool = True) -> DataFrame:
    """ENC1: ``get_dummies``: one 0/1 column per level of each string column (all levels kept).

    Levels of all columns are found in one distinct pass; the dummies are one projection.
    """
    levels = dict(levels or {})
    levels.update(distinct_levels(df, [c for c in cols if not levels.get(c)], 1000))
    dummies = [(F.col(c) == F.lit(lv)).cast("int").alias(f"{c}_{lv}") for c in cols for lv in levels[c]]
    keep = [F.col(x) for x in df.columns if not (drop and x in cols)]
    return df.select(*keep, *dummies)


def one_hot_array(label: Column | str, k: int) -> Column:
    """ENC2: class id -> one-hot array of length k (``to_categorical``)."""
    lab = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == lab).cast("double"))
