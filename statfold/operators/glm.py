"""Generalised linear models and logistic regression on MLlib (REG10-11, ML2, ML14).

A gaussian model with identity link is least squares and comes from the one-pass moments instead.

MLlib fits by distributed IRLS / L-BFGS; only the coefficient table and
model-level numbers come back, as small DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statfold.functions import dist
from statfold.operators import evaluate, gram, linear
from statfold.operators.linear import Design, OlsResult, design
from statfold.session import cut_lineage


class LeastSquares:
    """A fitted gaussian model with identity link: what callers read of MLlib's model, from the one-pass moments."""

    def __init__(self, d: Design, res: OlsResult):
        self.intercept = res.intercept
        self.coefficients = [res.beta[c] for c in d.columns]
        self._columns = d.columns

    def predict(self) -> Column:
        """The prediction over the design's columns."""
        dot = F.lit(0.0)
        for c, b in zip(self._columns, self.coefficients):
            dot = dot + F.lit(float(b)) * F.col(c)
        return dot + F.lit(float(self.intercept))


def _least_squares(d: Design):
    """The gaussian fit from one pass over the rows, or None where the columns depend on each other."""
    m = gram.moments(d.frame, d.columns + [d.y])
    # dependent columns and perfect fits are left to MLlib's own way
    if m.n <= len(d.columns) + 1 or not np.isfinite(m.comoment).all() or linear._kept_columns(m, d.columns) != d.columns:
        return None
    iy = m.index([d.y])[0]
    res = linear.ols_from_moments(m, d.columns, d.y)
    row, tss = res.model.iloc[0], float(m.comoment[iy, iy])
    if not row["rss"] > 0:
        return None
    return res, int(m.n), float(row["rss"]), tss, int(row["df_resid"])


def glm(df: DataFrame, y: str, terms: Sequence[str], family: str = "gaussian", link: str | None = None,
        conf: float = 0.95):
    """REG10 / REG11: ``glm(y ~ terms, family)``; family is explicit (quirk Q1: no family = gaussian).

    Returns (coefficient table, model row, fitted model, design). The table
    has estimate, se, t/z, p and Wald intervals (``confint.default``).
    """
    d = design(df, y, terms)
    z = dist.norm_ppf(1 - (1 - conf) / 2)
    names = ["Intercept"] + d.labels
    found = _least_squares(d) if family == "gaussian" and link in (None, "identity") else None
    if found:
        res, n, deviance, null_deviance, df_resid = found
        coef = res.coef.rename(columns={"coef": "estimate", "t": "statistic"})[["term", "estimate", "se", "statistic", "p_value"]]
        coef["term"] = names
        aic = n * (math.log(deviance / n * 2 * math.pi) + 1) + 2 + 2 * (len(d.columns) + 1)
        return _told(df, coef, z, family, n, deviance, null_deviance, df_resid, n - 1, deviance / df_resid, aic,
                     LeastSquares(d, res), d)
    # IRLS and the summary statistics each pass over the rows: keep the narrow assembled design
    # (label + features) in executor storage for the fit instead of re-deriving it every pass
    vec = (VectorAssembler(inputCols=d.columns, outputCol="_features").transform(d.frame)
           .select(d.y, "_features").persist(StorageLevel.MEMORY_AND_DISK))
    params = dict(family=family, featuresCol="_features", labelCol=d.y, maxIter=100, tol=1e-10)
    if link:
        params["link"] = link
    try:
        model = GeneralizedLinearRegression(**params).fit(vec)
        s = model.summary
        se = list(s.coefficientStandardErrors)
        tv = list(s.tValues)
        pv = list(s.pValues)
        n = int(s.numInstances)
        aic, deviance, null_deviance = float(s.aic), float(s.deviance), float(s.nullDeviance)
        df_resid, df_null = int(s.residualDegreeOfFreedom), int(s.residualDegreeOfFreedomNull)
        dispersion = float(s.dispersion)
    finally:
        vec.unpersist()
    est = [model.intercept] + list(model.coefficients)
    # MLlib lists the intercept last
    se, tv, pv = [se[-1]] + se[:-1], [tv[-1]] + tv[:-1], [pv[-1]] + pv[:-1]
    coef = pd.DataFrame({"term": names, "estimate": est, "se": se, "statistic": tv, "p_value": pv})
    return _told(df, coef, z, family, n, deviance, null_deviance, df_resid, df_null, dispersion, aic, model, d)


def _told(df, coef, z, family, n, deviance, null_deviance, df_resid, df_null, dispersion, aic, model, d):
    coef["wald_lo"] = coef["estimate"] - z * coef["se"]
    coef["wald_hi"] = coef["estimate"] + z * coef["se"]
    k = len(coef) + (1 if family == "gaussian" else 0)
    model_row = pd.DataFrame([{
        "family": family, "n": n, "deviance": deviance, "null_deviance": null_deviance,
        "df_resid": df_resid, "df_null": df_null,
        "dispersion": dispersion, "aic": aic, "bic": aic - 2 * k + k * math.log(n)}])
    spark = df.sparkSession
    return spark.createDataFrame(coef), spark.createDataFrame(model_row), model, d


def glm_predictions(model, d) -> DataFrame:
    if isinstance(model, LeastSquares):
        return d.frame.select(F.col(d.y).alias("y"), model.predict().alias("p"))
    vec = VectorAssembler(inputCols=d.columns, outputCol="_features").transform(d.frame)
    return model.transform(vec).select(F.col(d.y).alias("y"), F.col("prediction").alias("p"))


def compare_models(df: DataFrame, y: str, term_lists: dict, family: str = "gaussian", cut: float = 0.5) -> DataFrame:
    """ML14: one row per model: AIC, exact AUC of the fitted values, false negatives at ``cut``.

    The columns that the models share are written once; each model then reads only those it needs.
    """
    used = [t[2:-1] if t.startswith("C(") else t for terms in term_lists.values() for t in terms]
    df = cut_lineage(df.select(*dict.fromkeys([y, *used])))
    rows = []
    for name, terms in term_lists.items():
        _, mrow, model, d = glm(df, y, terms, family)
        pred = glm_predictions(model, d)
        a = evaluate.auc(pred, "y", "p").first()["auc"]
        fn = pred.where((F.col("y") == 1) & (F.col("p") <= cut)).count()
        m = mrow.first()
        rows.append((name, len(terms), float(m["aic"]), float(m["bic"]), float(a), int(fn)))
    return df.sparkSession.createDataFrame(rows, "model string, terms int, aic double, bic double, auc double, "
                                                 "false_negatives long").orderBy("model")


def logistic(train: DataFrame, features: Sequence[str], label: str, C: float = 1.0, cut: float = 0.5):
    """ML2: sklearn ``LogisticRegression(C)``: L2 penalty ``1/(2C) ||w||^2`` on the summed loss
    = MLlib ``regParam = 1/(C n)`` without standardisation. Returns (model, n)."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(train)
    n = vec.count()
    lr = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, maxIter=200, tol=1e-10, threshold=cut)
    return lr.fit(vec), n


def logistic_scores(model, df: DataFrame, features: Sequence[str], label: str, cut: float = 0.5) -> DataFrame:
    """predict / predict_proba with an explicit cut-off (ML3)."""
    vec = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)
    out = model.transform(vec)
    p1 = vector_to_array("probability")[1]
    return out.select(F.col(label).alias("y"), p1.alias("p"), evaluate.cutoff(p1, cut).alias("pred"))
