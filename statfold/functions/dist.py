"""Distribution functions for p-values and critical values.

Pure Python / numpy (no scipy), usable on the driver for a one-row result
and inside Arrow-batched pandas UDFs for many small test rows. Incomplete
beta by Lentz's continued fraction, incomplete gamma by series / continued
fraction, normal via :mod:`statistics.NormalDist`.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()
_EPS = 1e-15
_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return _N.cdf(x)


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln_front)
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gammainc(s: float, x: float) -> float:
    """Regularised lower incomplete gamma P(s, x)."""
    if x <= 0:
        return 0.0
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        for _ in range(100000):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b = x + 1 - s
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return 1.0 - math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2, 0.5, x)
    return tail if t > 0 else 1.0 - tail


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), df))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the cdf (monotone, robust)."""
    if p == 0.5:
        return 0.0
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1.0 - t_sf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    if x <= 0:
        return 1.0
    return 1.0 - gammainc(df / 2, x / 2)


def _vec(fn):
    return np.vectorize(lambda *a: float("nan") if any(v is None or (isinstance(v, float) and math.isnan(v))
                                                        for v in a) else fn(*a), otypes=[float])


_KINDS = {
    "t": _vec(t_two_sided),
    "f": _vec(f_sf),
    "chi2": _vec(chi2_sf),
    "norm": _vec(lambda z: 2.0 * (1.0 - norm_cdf(abs(z)))),
}


def p_value(kind: str, stat: Column, df1: Column | None = None, df2: Column | None = None) -> Column:
    """Arrow-batched p-value column for test statistics (``t``, ``f``, ``chi2``, ``norm``)."""
    fn = _KINDS[kind]
    if kind == "norm":
        @F.pandas_udf("double")
        def _p1(s: pd.Series) -> pd.Series:
            return pd.Series(fn(s.astype(float).to_numpy()))
        return _p1(stat)
    if kind in ("t", "chi2"):
        @F.pandas_udf("double")
        def _p2(s: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(fn(s.astype(float).to_numpy(), d.astype(float).to_numpy()))
        return _p2(stat, df1)

    @F.pandas_udf("double")
    def _p3(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(s.astype(float).to_numpy(), a.astype(float).to_numpy(), b.astype(float).to_numpy()))
    return _p3(stat, df1, df2)


def t_quantile(p: float, df: Column) -> Column:
    """Arrow-batched Student-t quantile for a degrees-of-freedom column."""
    fn = np.vectorize(lambda d: t_ppf(p, d) if d and d > 0 else float("nan"), otypes=[float])

    @F.pandas_udf("double")
    def _q(d: pd.Series) -> pd.Series:
        return pd.Series(fn(d.astype(float).to_numpy()))
    return _q(df)


def norm_quantile_col(p: Column) -> Column:
    """Arrow-batched standard normal quantile of a probability column."""
    @F.pandas_udf("double")
    def _q(s: pd.Series) -> pd.Series:
        return s.astype(float).map(lambda v: _N.inv_cdf(v) if 0 < v < 1 else float("nan"))
    return _q(p)
