"""Diagnostics: QQ-plot points (REG15) and profile-likelihood intervals for GLMs (REG12)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.functions import dist
from statfold.operators.linear import design
from statfold.operators.position import with_position
from statfold.session import cut_lineage


def qq_points(df: DataFrame, col: str, a: float = 0.0) -> DataFrame:
    """REG15: sample order statistics vs normal quantiles ``Phi^-1((i - a)/(n + 1 - 2a))``
    and the standardised line ``mean + sd * q`` (statsmodels ``line='s'``)."""
    x = df.select(F.col(col).cast("double").alias("sample")).where(F.col("sample").isNotNull())
    ranked = with_position(x, ["sample"], "i", ties=True)
    stats = ranked.agg(F.count(F.lit(1)).alias("_n"), F.avg("sample").alias("_m"), F.stddev_samp("sample").alias("_s"))
    j = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
    p = (F.col("i") - a) / (F.col("_n") + 1 - 2 * a)
    out = j.withColumn("theoretical", dist.norm_quantile_col(p))
    return out.select("i", "sample", "theoretical", (F.col("_m") + F.col("_s") * F.col("theoretical")).alias("line"))


def _fit(frame, features, y, family, offset=None):
    vec = VectorAssembler(inputCols=list(features), outputCol="_features").transform(frame) if features else \
        frame.withColumn("_features", F.array().cast("array<double>"))
    if not features:
        from pyspark.ml.functions import array_to_vector
        vec = vec.withColumn("_features", array_to_vector("_features"))
    glr = GeneralizedLinearRegression(family=family, featuresCol="_features", labelCol=y, weightCol="_w", maxIter=100, tol=1e-10)
    if offset is not None:
        glr = glr.setOffsetCol(offset)
    return glr.fit(vec)


def profile_intervals(df: DataFrame, y: str, terms: Sequence[str], family: str = "binomial",
                      conf: float = 0.95, max_iter: int = 8, tol: float = 1e-4) -> DataFrame:
    """REG12: ``confint(glm)``: for each slope, the values where the signed root deviance
    ``sign(b - b_hat) * sqrt(dev(b) - dev_min)`` reaches +-z. Each evaluation is one MLlib fit
    with that coefficient fixed through ``offsetCol``; secant steps start from the Wald bounds.

    The many fits read the rows once, as they are written first. Binomial rows with equal terms become one row with
    their share of ones and their number as weight: the likelihood is linear in the label, so that only a constant is
    taken from every deviance, and their differences stay."""
    d = design(df, y, terms)
    if family == "binomial":
        frame = d.frame.groupBy(*d.columns).agg(F.avg(d.y).alias(d.y), F.count(F.lit(1)).cast("double").alias("_w"))
    else:
        frame = d.frame.withColumn("_w", F.lit(1.0))
    frame = cut_lineage(frame)
    full = _fit(frame, d.columns, d.y, family)
    dev0 = full.summary.deviance
    se = list(full.summary.coefficientStandardErrors)
    z = dist.norm_ppf(1 - (1 - conf) / 2)
    rows = []
    for j, col in enumerate(d.columns):
        b_hat = float(full.coefficients[j])
        others = [c for c in d.columns if c != col]

        def root(b):
            m = _fit(frame.withColumn("_off", F.lit(b) * F.col(col)), others, d.y, family, "_off")
            return math.copysign(math.sqrt(max(m.summary.deviance - dev0, 0.0)), b - b_hat)

        bounds = []
        for sign in (-1, 1):
            b1, b2 = b_hat + sign * z * se[j], b_hat + sign * 0.5 * z * se[j]
            f1, f2 = root(b1) - sign * z, root(b2) - sign * z
            for _ in range(max_iter):
                if abs(f1) < tol or f1 == f2:
                    break
                b1, b2, f2 = b1 - f1 * (b1 - b2) / (f1 - f2), b1, f1
                f1 = root(b1) - sign * z
            bounds.append(b1)
        rows.append((d.labels[j], b_hat, bounds[0], bounds[1]))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, profile_lo double, profile_hi double")
