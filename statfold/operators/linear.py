"""Linear models from the one-pass moments (REG1-7, REG9, REG13-14, TST5-6).

The data is read once by :mod:`statfold.operators.gram`; the p x p solve
and the reporting happen on the driver on model-sized numbers and come
back as small DataFrames (one row per term, one row per model).
Predictions and residuals are Column expressions with the coefficients as
literals, so scoring stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statfold.functions import dist
from statfold.operators import gram
from statfold.operators.position import _cols, _partitions, _ranged, with_previous
from statfold.operators.profile import distinct_levels


# ---------------------------------------------------------------- design

@dataclass
class Design:
    frame: DataFrame            # y and the expanded numeric columns, complete rows only
    y: str
    columns: list[str]          # safe internal names of the design columns
    labels: list[str]           # display names (statsmodels style)
    terms: dict[str, list[str]] = field(default_factory=dict)  # term -> its columns


def design(df: DataFrame, y: str, terms: Sequence[str], levels: dict | None = None) -> Design:
    """REG2: numeric terms as they are, ``C(x)`` as treatment dummies (first level is the base)."""
    levels = dict(levels or {})
    wanted = [t[2:-1] for t in terms if t.startswith("C(") and t.endswith(")") and not levels.get(t[2:-1])]
    levels.update(distinct_levels(df, wanted, 200))
    exprs: list[Column] = [F.col(y).cast("double").alias("_y")]
    needed = [F.col(y).isNotNull()]
    cols, labels, groups = [], [], {}
    for t in terms:
        if t.startswith("C(") and t.endswith(")"):
            v = t[2:-1]
            lv = levels[v]
            groups[t] = []
            needed.append(F.col(v).isNotNull())
            for level in lv[1:]:
                name = f"_x{len(cols)}"
                exprs.append((F.col(v) == F.lit(level)).cast("double").alias(name))
                cols.append(name)
                labels.append(f"{t}[T.{level}]")
                groups[t].append(name)
        else:
            name = f"_x{len(cols)}"
            exprs.append(F.col(t).cast("double").alias(name))
            needed.append(F.col(t).isNotNull())
            cols.append(name)
            labels.append(t)
            groups[t] = [name]
    keep = needed[0]
    for c in needed[1:]:
        keep = keep & c
    return Design(df.where(keep).select(*exprs), "_y", cols, labels, groups)


# ---------------------------------------------------------------- solve

def _kept_columns(m: gram.Moments, xs: Sequence[str], tol: float = 1e-10) -> list[str]:
    """Drop aliased columns (constant or linear in earlier ones), as R reports NA."""
    kept: list[str] = []
    for c in xs:
        cjj = m.sub([c]).comoment[0, 0]
        if cjj <= tol * max(1.0, abs(m.mean[m.index([c])[0]]) ** 2):
            continue
        if kept:
            sub = m.sub(kept + [c]).comoment
            a, b = sub[:-1, :-1], sub[:-1, -1]
            resid = cjj - b @ np.linalg.solve(a, b)
            if resid <= tol * cjj:
                continue
        kept.append(c)
    return kept


def _fit(m: gram.Moments, xs: Sequence[str], y: str, ridge: float = 0.0):
    xs = list(xs)
    if not xs:
        return np.zeros(0), m.sub([y]).comoment[0, 0], m.mean[m.index([y])[0]]
    cxx = m.sub(xs).comoment
    iy = m.index([y])[0]
    ix = m.index(xs)
    cxy = m.comoment[ix, iy]
    d = np.sqrt(np.clip(np.diag(cxx), 1e-300, None))
    scaled = cxx / np.outer(d, d) + ridge * np.diag(1.0 / (d * d))
    beta = np.linalg.solve(scaled, cxy / d) / d
    rss = m.comoment[iy, iy] - 2 * beta @ cxy + beta @ cxx @ beta
    intercept = m.mean[iy] - m.mean[ix] @ beta
    return beta, max(float(rss), 0.0), float(intercept)


def sse_on(m: gram.Moments, xs: Sequence[str], y: str, beta: np.ndarray, intercept: float) -> float:
    """Sum of squared errors of a fitted model on the rows summarised by ``m``."""
    iy = m.index([y])[0]
    ix = m.index(list(xs))
    cxx, cxy = m.comoment[np.ix_(ix, ix)], m.comoment[ix, iy]
    bias = m.mean[iy] - intercept - (m.mean[ix] @ beta if len(ix) else 0.0)
    return float(m.comoment[iy, iy] - 2 * beta @ cxy + beta @ cxx @ beta + m.n * bias * bias)


@dataclass
class OlsResult:
    coef: pd.DataFrame
    model: pd.DataFrame
    intercept: float
    beta: dict

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.coef), spark.createDataFrame(self.model)


def ols_from_moments(m: gram.Moments, xs: Sequence[str], y: str, labels: dict | None = None,
                     conf: float = 0.95) -> OlsResult:
    """REG1 / REG3 / TST6: coefficients, se, t, p, CI and model-level statistics."""
    labels = labels or {c: c for c in xs}
    kept = _kept_columns(m, xs)
    beta, rss, b0 = _fit(m, kept, y)
    n, p = m.n, len(kept)
    df_resid = n - p - 1
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    ix = m.index(kept)
    cinv = np.linalg.inv(m.comoment[np.ix_(ix, ix)]) if p else np.zeros((0, 0))
    se = np.sqrt(np.diag(cinv) * sigma2) if p else np.zeros(0)
    se0 = math.sqrt(sigma2 * (1.0 / n + (m.mean[ix] @ cinv @ m.mean[ix] if p else 0.0)))
    q = dist.t_ppf(1 - (1 - conf) / 2, df_resid) if df_resid > 0 else float("nan")
    rows = [("Intercept", b0, se0)] + [(labels[c], float(b), float(s)) for c, b, s in zip(kept, beta, se)]
    rows += [(labels[c], float("nan"), float("nan")) for c in xs if c not in kept]
    coef = pd.DataFrame(rows, columns=["term", "coef", "se"])
    coef["t"] = coef["coef"] / coef["se"]
    coef["p_value"] = [dist.t_two_sided(t, df_resid) if not math.isnan(t) else float("nan") for t in coef["t"]]
    coef["ci_lo"] = coef["coef"] - q * coef["se"]
    coef["ci_hi"] = coef["coef"] + q * coef["se"]
    iy = m.index([y])[0]
    tss = m.comoment[iy, iy]
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / df_resid if df_resid > 0 else float("nan")
    fstat = ((tss - rss) / p) / sigma2 if p and df_resid > 0 else float("nan")
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 else float("inf")
    model = pd.DataFrame([{
        "n": int(n), "df_model": int(p), "df_resid": int(df_resid), "rss": rss, "r2": r2, "adj_r2": adj,
        "f_stat": fstat, "f_p_value": dist.f_sf(fstat, p, df_resid) if not math.isnan(fstat) else float("nan"),
        "loglik": llf, "aic": -2 * llf + 2 * (p + 1), "bic": -2 * llf + (p + 1) * math.log(n),
        "sigma": math.sqrt(sigma2) if sigma2 == sigma2 else float("nan")}])
    return OlsResult(coef, model, b0, {c: float(b) for c, b in zip(kept, beta)})


def ols(df: DataFrame, y: str, terms: Sequence[str], conf: float = 0.95) -> tuple[DataFrame, DataFrame, Design, OlsResult]:
    """REG1: ``ols('y ~ a + C(g)')`` / ``lm``; returns (coef table, model row, design, result)."""
    d = design(df, y, terms)
    m = gram.moments(d.frame, d.columns + [d.y])
    res = ols_from_moments(m, d.columns, d.y, dict(zip(d.columns, d.labels)), conf)
    c, mo = res.frames(df.sparkSession)
    return c, mo, d, res


def prediction(beta: dict, intercept: float) -> Column:
    """Linear predictor as a Column expression (coefficients are literals)."""
    expr = F.lit(float(intercept))
    for c, b in beta.items():
        expr = expr + F.lit(float(b)) * F.col(c)
    return expr


def residuals(d: Design, res: OlsResult, out: str = "resid") -> DataFrame:
    """The design frame with ``y - prediction`` (the model's ``resid``)."""
    return d.frame.withColumn(out, F.col(d.y) - prediction(res.beta, res.intercept))


def residual_diagnostics(d: Design, res: OlsResult, order_by: str | None = None) -> DataFrame:
    """Residual skew, kurtosis, Jarque-Bera, omnibus and Durbin-Watson (``summary()`` footer).

    Durbin-Watson needs the row order: residuals are range-partitioned on it and
    each sorted partition is walked once (seams stitched from one row per
    partition), never a single-partition window.
    """
    from statfold.operators.stats import omnibus
    e = residuals(d, res, "_e")
    mo = e.agg(F.count(F.lit(1)).alias("n"), F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurt"),
               F.sum(F.col("_e") * F.col("_e")).alias("ss")).first()
    n, skew, kurt = int(mo["n"]), float(mo["skew"]), float(mo["kurt"])
    jb = n / 6 * (skew ** 2 + kurt ** 2 / 4)
    k2, k2p = omnibus(skew, kurt, n)
    dw = float("nan")
    if order_by is not None:
        dw = durbin_watson(e, "_e", order_by)
    return d.frame.sparkSession.createDataFrame(
        [(n, skew, kurt + 3, jb, dist.chi2_sf(jb, 2), k2, k2p, dw)],
        "n long, skew double, kurtosis double, jarque_bera double, jb_p_value double, omnibus double, "
        "omnibus_p_value double, durbin_watson double")


def _dw_parts(resid: str):
    """mapInPandas body: squared successive differences along one sorted range partition,
    with the partition's sum of squares and its first and last residual."""
    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        num = den = 0.0
        first = last = None
        for pdf in batches:
            e = pdf[resid].to_numpy(dtype=float)
            if not len(e):
                continue
            if first is None:
                first = e[0]
            chain = e if last is None else np.concatenate([[last], e])
            num += float(np.sum(np.diff(chain) ** 2))
            den += float(np.sum(e * e))
            last = e[-1]
        if first is not None:
            yield pd.DataFrame({"_pid": [pid], "_num": [num], "_den": [den], "_first": [first], "_last": [last]})
    return run


def durbin_watson(df: DataFrame, resid: str, order_by) -> float:
    """WIN5: ``sum((e_t - e_{t-1})^2) / sum(e_t^2)`` along an explicit (total) order.

    One range shuffle: each sorted partition returns its own sums and its
    first and last residual; the differences across partition seams are
    added from that one-row-per-partition table.
    """
    keys = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    ranged = _ranged(df.select(*keys, resid), _cols(keys), _partitions(df, None), False)
    parts = ranged.select(resid).mapInPandas(
        _dw_parts(resid), "_pid int, _num double, _den double, _first double, _last double")
    prev = F.lag("_last").over(Window.orderBy("_pid"))
    seam = F.coalesce(F.pow(F.col("_first") - prev, 2), F.lit(0.0))
    row = parts.select((F.col("_num") + seam).alias("_num"), "_den").agg(
        F.sum("_num").alias("num"), F.sum("_den").alias("den")).first()
    return float(row["num"]) / float(row["den"])


def lagged_differences(df: DataFrame, value: str, order_by: Sequence[str], out: str = "diff") -> DataFrame:
    """WIN5 as a table: ``value - lag(value)`` along ``order_by`` (null for the first row)."""
    prev = with_previous(df, list(order_by), value, "_prev")
    return prev.withColumn(out, F.col(value) - F.col("_prev")).drop("_prev")


# ---------------------------------------------------------------- ANOVA type II

def anova_type2(m: gram.Moments, d: Design, res: OlsResult) -> pd.DataFrame:
    """TST5: for each term, RSS(model without the term) - RSS(full)."""
    kept = [c for c in d.columns if c in res.beta]
    _, rss_full, _ = _fit(m, kept, d.y)
    df_resid = m.n - len(kept) - 1
    rows = []
    for term, cols in d.terms.items():
        cols = [c for c in cols if c in kept]
        if not cols:
            continue
        rest = [c for c in kept if c not in cols]
        _, rss_rest, _ = _fit(m, rest, d.y)
        ss = rss_rest - rss_full
        fval = (ss / len(cols)) / (rss_full / df_resid)
        rows.append((term, ss, float(len(cols)), fval, dist.f_sf(fval, len(cols), df_resid)))
    rows.append(("Residual", rss_full, float(df_resid), float("nan"), float("nan")))
    return pd.DataFrame(rows, columns=["term", "sum_sq", "df", "F", "p_value"])


# ---------------------------------------------------------------- cross-validation, ridge, lasso

def fold_moments(frame: DataFrame, cols: Sequence[str], fold_col: str) -> dict:
    return gram.moments_by(frame, cols, fold_col)


def cv_linear(folds: dict, xs: Sequence[str], y: str, ridge: float = 0.0) -> pd.DataFrame:
    """REG5: per-fold test MSE / RMSE / R2 of a model fitted on the other folds.

    ``folds`` maps fold id -> moments; the training moments are the total
    minus the fold (exact), so every fold costs one small solve.
    """
    total = gram.combine(list(folds.values()))
    rows = []
    iy = total.index([y])[0]
    for k, mk in sorted(folds.items()):
        train = total - mk
        beta, _, b0 = _fit(train, xs, y, ridge)
        sse = sse_on(mk, xs, y, beta, b0)
        sst = mk.comoment[iy, iy]
        rows.append((k, int(mk.n), sse / mk.n, math.sqrt(sse / mk.n), 1 - sse / sst if sst > 0 else float("nan")))
    return pd.DataFrame(rows, columns=["fold", "n", "mse", "rmse", "r2"])


def lasso_from_moments(m: gram.Moments, xs: Sequence[str], y: str, alpha: float, tol: float = 1e-10,
                       max_iter: int = 100000, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coordinate descent for ``1/(2n) ||y - b0 - Xb||^2 + alpha ||b||_1`` on the Gram."""
    ix, iy = m.index(list(xs)), m.index([y])[0]
    c = m.comoment[np.ix_(ix, ix)] / m.n
    cy = m.comoment[ix, iy] / m.n
    b = np.zeros(len(ix)) if start is None else start.copy()
    for _ in range(max_iter):
        delta = 0.0
        for j in range(len(ix)):
            if c[j, j] <= 0:
                continue
            rho = cy[j] - c[j] @ b + c[j, j] * b[j]
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / c[j, j]
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta < tol:
            break
    b0 = m.mean[iy] - m.mean[ix] @ b
    return b, float(b0)


def lasso_cv(folds: dict, xs: Sequence[str], y: str, n_alphas: int = 100, eps: float = 1e-3) -> tuple[pd.DataFrame, dict]:
    """REG6: ``LassoCV``: alpha grid from alpha_max down to eps*alpha_max, mean fold MSE, refit."""
    total = gram.combine(list(folds.values()))
    ix, iy = total.index(list(xs)), total.index([y])[0]
    amax = float(np.max(np.abs(total.comoment[ix, iy])) / total.n)
    alphas = np.logspace(math.log10(amax * eps), math.log10(amax), n_alphas)[::-1]
    trains = {k: total - mk for k, mk in folds.items()}
    warm = {k: None for k in folds}
    rows = []
    for a in alphas:
        mses = []
        for k, mk in folds.items():
            b, b0 = lasso_from_moments(trains[k], xs, y, a, start=warm[k])
            warm[k] = b
            mses.append(sse_on(mk, xs, y, b, b0) / mk.n)
        rows.append((float(a), float(np.mean(mses))))
    path = pd.DataFrame(rows, columns=["alpha", "mean_mse"])
    best = float(path.loc[path["mean_mse"].idxmin(), "alpha"])
    b, b0 = lasso_from_moments(total, xs, y, best)
    return path, {"alpha": best, "intercept": b0, **{x: float(v) for x, v in zip(xs, b)}}


def ridge_from_moments(m: gram.Moments, xs: Sequence[str], y: str, alpha: float) -> tuple[np.ndarray, float]:
    """REG7: ``(Xc'Xc + alpha I)^-1 Xc'yc`` (intercept not penalised)."""
    ix, iy = m.index(list(xs)), m.index([y])[0]
    b = np.linalg.solve(m.comoment[np.ix_(ix, ix)] + alpha * np.eye(len(ix)), m.comoment[ix, iy])
    return b, float(m.mean[iy] - m.mean[ix] @ b)


def ridge_loo(frame: DataFrame, m: gram.Moments, xs: Sequence[str], y: str,
              alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> pd.DataFrame:
    """REG7: ``RidgeCV`` leave-one-out MSE per alpha in one distributed pass.

    LOO residual = e_i / (1 - h_ii) with h_ii = 1/n + xc_i' A xc_i,
    A = (Xc'Xc + alpha I)^-1 (p x p literals in the expression).
    """
    ix, iy = m.index(list(xs)), m.index([y])[0]
    aggs = []
    for k, a in enumerate(alphas):
        inv = np.linalg.inv(m.comoment[np.ix_(ix, ix)] + a * np.eye(len(ix)))
        b, b0 = ridge_from_moments(m, xs, y, a)
        xc = [F.col(x) - float(m.mean[i]) for x, i in zip(xs, ix)]
        h = F.lit(1.0 / m.n)
        for i in range(len(xs)):
            for j in range(len(xs)):
                h = h + F.lit(float(inv[i, j])) * xc[i] * xc[j]
        e = F.col(y) - prediction(dict(zip(xs, b)), b0)
        aggs.append(F.avg(F.pow(e / (1 - h), 2)).alias(f"_a{k}"))
    row = frame.agg(*aggs).first()
    return pd.DataFrame([(float(a), float(row[f"_a{k}"])) for k, a in enumerate(alphas)], columns=["alpha", "loo_mse"])


# ---------------------------------------------------------------- subsets

def _subset_rss(m: gram.Moments, xs: Sequence[str], y: str, mask: int) -> float:
    cols = [x for i, x in enumerate(xs) if mask >> i & 1]
    return _fit(m, _kept_columns(m, cols), y)[1]


def _reverse_sweep(mats: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Take variable ``k[i]`` out of the swept matrix ``mats[i]``, for all at once."""
    at = np.arange(len(mats))
    col = mats[at, :, k]
    d = col[at, k]
    out = mats - col[:, :, None] * col[:, None, :] / d[:, None, None]
    line = -col / d[:, None]
    line[at, k] = -1 / d
    out[at, k, :] = line
    out[at, :, k] = line
    return out


def search_subsets(cross: np.ndarray, nvmax: int, batch: int = 512) -> tuple[dict[int, tuple[float, int]], int]:
    """Best (residual sum, mask) of every size up to ``nvmax`` by branch and bound, and the subsets looked at.

    ``cross`` is the (p + 1)-square matrix of centred cross-products, the response last. The search starts at all
    variables and takes variables out. A subset's residual sum bounds those of all it contains, so a branch ends
    where no size that it can still reach has a worse best. The variables of a branch are tried in the order of
    what their loss costs: the largest sub-branches then lie below the dearest losses and end at once. Branches
    wait as swept matrices and are advanced ``batch`` at a time; the one with the least residual sum goes first.
    """
    p = len(cross) - 1
    scale = np.sqrt(np.where(np.diag(cross) > 0, np.diag(cross), 1))
    mat = cross / np.outer(scale, scale)
    tss = scale[p] ** 2
    spread = np.linalg.eigvalsh(mat[:p, :p]) if p else np.ones(1)
    if spread.min(initial=1.0) < 1e-10:   # dependent variables: the same bound holds for the penalised sum
        mat = mat.copy()
        mat[np.arange(p), np.arange(p)] += 1e-8
    for k in range(p):
        d, col = mat[k, k], mat[:, k].copy()
        mat = mat - np.outer(col, col) / d
        mat[k, :] = mat[:, k] = col / d
        mat[k, k] = -1 / d
    everything = (1 << p) - 1
    best: dict[int, tuple[float, int]] = {p: (float(mat[p, p]), everything)}
    looked = 1
    # a first bound of every size by taking out the cheapest variable again and again
    one, mask = mat[None], everything
    for size in range(p - 1, 0, -1):
        left = np.array([j for j in range(p) if mask >> j & 1])
        cost = one[0, p, p] - one[0, left, p] ** 2 / one[0, left, left]
        j = int(left[cost.argmin()])
        one, mask = _reverse_sweep(one, np.array([j])), mask & ~(1 << j)
        best[size] = (float(one[0, p, p]), mask)
    waiting = [(mat, list(range(p)), everything, p)]   # matrix, variables that may go, subset, its size
    while waiting:
        waiting.sort(key=lambda w: -w[0][p, p])
        nodes = waiting[-batch:]
        del waiting[-batch:]
        grown = []
        for k, (own, free, mask, size) in enumerate(nodes):
            if not _can_improve(best, own[p, p], size - len(free), size - 1, nvmax):
                continue
            loss = own[p, p] - own[free, p] ** 2 / own[free, free]
            order = np.argsort(-loss, kind="stable").tolist()
            for i, place in enumerate(order):
                rss, less, rest = float(loss[place]), mask & ~(1 << free[place]), order[i + 1:]
                looked += 1
                if size > 1 and (rss, less) < best[size - 1]:
                    best[size - 1] = (rss, less)
                if rest and _can_improve(best, rss, size - 1 - len(rest), size - 2, nvmax):
                    grown.append((k, free[place], [free[r] for r in rest], less, size - 1))
        if grown:
            mats = _reverse_sweep(np.stack([nodes[g[0]][0] for g in grown]), np.array([g[1] for g in grown]))
            waiting += [(mats[i], *g[2:]) for i, g in enumerate(grown)]
    return {size: (rss * tss, mask) for size, (rss, mask) in best.items() if size <= nvmax}, looked


def _can_improve(best: dict, rss: float, least: int, most: int, nvmax: int) -> bool:
    return any(best[size][0] > rss for size in range(max(1, least), min(most, nvmax) + 1))


def best_subsets(m: gram.Moments, xs: Sequence[str], y: str, method: str = "exhaustive",
                 nvmax: int | None = None) -> pd.DataFrame:
    """REG14: best model per size with R2, adj R2, BIC (offset form) and Cp.

    The data are read once for the Gram matrix; every search works on those p x p numbers on the driver.
    ``exhaustive`` finds what trying all subsets would, by branch and bound (:func:`search_subsets`);
    forward, backward and sequential-replacement search are greedy.
    """
    xs = list(xs)
    p = len(xs)
    nvmax = nvmax or p
    n = m.n
    iy = m.index([y])[0]
    tss = m.comoment[iy, iy]
    full_rss = _subset_rss(m, xs, y, (1 << p) - 1)
    s2 = full_rss / (n - p - 1)
    best: dict[int, tuple[float, int]] = {}
    if method == "exhaustive":
        idx = m.index([*xs, y])
        found, _ = search_subsets(m.comoment[np.ix_(idx, idx)], nvmax)
        best = {size: (_subset_rss(m, xs, y, mask), mask) for size, (_, mask) in found.items()}
    else:
        chosen: list[int] = [] if method in ("forward", "seqrep") else list(range(p))
        if method in ("forward", "seqrep"):
            while len(chosen) < nvmax:
                cand = [(_subset_rss(m, xs, y, _mask(chosen + [j])), j) for j in range(p) if j not in chosen]
                chosen.append(min(cand)[1])
                if method == "seqrep":
                    chosen = _replace_pass(m, xs, y, chosen)
                best[len(chosen)] = (_subset_rss(m, xs, y, _mask(chosen)), _mask(chosen))
        elif method == "backward":
            best[p] = (full_rss, _mask(chosen))
            while len(chosen) > 1:
                cand = [(_subset_rss(m, xs, y, _mask([c for c in chosen if c != j])), j) for j in chosen]
                chosen.remove(min(cand)[1])
                best[len(chosen)] = (_subset_rss(m, xs, y, _mask(chosen)), _mask(chosen))
        else:
            raise ValueError("method must be exhaustive, forward, backward or seqrep")
    rows = []
    for size in sorted(k for k in best if k <= nvmax):
        rss, mask = best[size]
        r2 = 1 - rss / tss
        rows.append((size, ",".join(x for i, x in enumerate(xs) if mask >> i & 1), rss, r2,
                     1 - (1 - r2) * (n - 1) / (n - size - 1), n * math.log(1 - r2) + size * math.log(n),
                     rss / s2 - n + 2 * (size + 1)))
    return pd.DataFrame(rows, columns=["size", "variables", "rss", "r2", "adj_r2", "bic", "cp"])


def _mask(idx: Sequence[int]) -> int:
    out = 0
    for i in idx:
        out |= 1 << i
    return out


def _replace_pass(m, xs, y, chosen):
    improved = True
    while improved:
        improved = False
        base = _subset_rss(m, xs, y, _mask(chosen))
        for pos in range(len(chosen)):
            for j in range(len(xs)):
                if j in chosen:
                    continue
                trial = chosen[:pos] + [j] + chosen[pos + 1:]
                r = _subset_rss(m, xs, y, _mask(trial))
                if r < base - 1e-12:
                    chosen, base, improved = trial, r, True
    return chosen


def mse(df: DataFrame, y: str, pred: str) -> DataFrame:
    """REG9: mean squared error and its root."""
    a = df.agg(F.avg(F.pow(F.col(y) - F.col(pred), 2)).alias("mse"))
    return a.withColumn("rmse", F.sqrt("mse"))
