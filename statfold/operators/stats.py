"""Statistical tests and summaries: one distributed aggregate, a tiny finish.

Test statistics and degrees of freedom are plain DataFrame columns; p-values
and critical values are attached with Arrow-batched UDFs from
:mod:`statfold.functions.dist` on the already-aggregated rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statfold.functions import dist
from statfold.operators.position import exact_quantiles, with_position
from statfold.session import broadcast_if_small


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def box_stats(df: DataFrame, value: str, groups: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """AGG10: Q1, median, Q3 (type 7), whiskers (last points within k*IQR), flier count."""
    groups = list(groups)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], groups, ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    x = F.col(value)
    joined = df.select(*groups, value).where(x.isNotNull())
    joined = (joined.join(broadcast_if_small(q), groups) if groups else
              _one(joined).join(F.broadcast(_one(q)), "_one").drop("_one"))
    return joined.groupBy(*groups, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"), F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count(F.when((x < lo_f) | (x > hi_f), 1)).alias("n_fliers"))


def z_interval(df: DataFrame, col: str, sigma: float, conf: float = 0.95, mu: float = 0.0) -> DataFrame:
    """TST1: one-sample z interval and test with known sigma."""
    z = dist.norm_ppf(1 - (1 - conf) / 2)
    a = df.agg(F.count(F.col(col)).alias("n"), F.avg(col).alias("mean"))
    se = F.lit(float(sigma)) / F.sqrt(F.col("n"))
    return a.select(F.lit(conf).alias("conf"), "n", "mean", (F.col("mean") - z * se).alias("lower"),
                    (F.col("mean") + z * se).alias("upper"), ((F.col("mean") - mu) / se).alias("z"))


def t_statistic(df: DataFrame, col: str, mu: float = 0.0, groups: Sequence[str] = ()) -> DataFrame:
    """TST2 (statistic part): n, mean, sd, se, t, df for H0: mean = mu."""
    a = df.groupBy(*groups).agg(F.count(F.col(col)).alias("n"), F.avg(col).alias("mean"),
                                F.stddev_samp(col).alias("sd"))
    return (a.withColumn("se", F.col("sd") / F.sqrt("n"))
            .withColumn("t", (F.col("mean") - mu) / F.col("se"))
            .withColumn("df", (F.col("n") - 1).cast("long")))


def t_interval(df: DataFrame, col: str, conf: float = 0.95, mu: float = 0.0,
               groups: Sequence[str] = ()) -> DataFrame:
    """TST2: R ``t.test(x, conf.level)`` - interval, t, df, two-sided p."""
    s = t_statistic(df, col, mu, groups)
    q = dist.t_quantile(1 - (1 - conf) / 2, F.col("df"))
    return (s.withColumn("_q", q).withColumn("conf", F.lit(conf))
            .withColumn("lower", F.col("mean") - F.col("_q") * F.col("se"))
            .withColumn("upper", F.col("mean") + F.col("_q") * F.col("se"))
            .withColumn("p_value", dist.p_value("t", F.col("t"), F.col("df"))).drop("_q"))


def chi_square(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """TST3: chi-square test of independence on the (a, b) contingency table.

    Uses ``sum(O^2/E) - N`` over observed cells, so empty cells never have
    to be materialised. For a 2x2 table with ``correction`` the R Yates
    rule applies: ``sum((|O-E| - min(0.5, min|O-E|))^2 / E)`` over all four
    cells (the four-cell spine is built from the two level pairs).
    """
    data = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = data.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    shape = cells.agg(F.sum("o").alias("n"), F.count_distinct(a).alias("nr"), F.count_distinct(b).alias("nc"),
                      F.array(F.min(a), F.max(a)).alias("_la"), F.array(F.min(b), F.max(b)).alias("_lb"))
    # The level spine is only built for a 2x2 table: with two levels, min and max are the levels.
    spine = (shape.where((F.col("nr") == 2) & (F.col("nc") == 2))
             .select(F.explode("_la").alias(a), "_lb").select(a, F.explode("_lb").alias(b)))
    full = (spine.join(cells, [a, b], "left").fillna(0, ["o"]).join(rows, a).join(cols, b)
            if correction else None)
    plain = _one(cells.join(rows, a).join(cols, b)).join(F.broadcast(_one(shape.drop("_la", "_lb"))), "_one")
    stat = plain.groupBy("n", "nr", "nc").agg(
        (F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c") / F.col("n"))) - F.first("n")).alias("statistic"))
    out = stat.select(F.col("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("long").alias("df"),
                      F.col("n"), F.lit(False).alias("yates"))
    if correction:
        e = F.col("r") * F.col("c") / F.col("n")
        f = _one(full).join(F.broadcast(_one(shape.select("n"))), "_one").withColumn("_e", e)
        f = f.withColumn("_d", F.abs(F.col("o") - F.col("_e")))
        y = f.agg(F.min("_d").alias("_m"), F.first("n").alias("n"))
        f2 = _one(f).join(F.broadcast(_one(y.select("_m"))), "_one")
        yates = f2.groupBy("n").agg(F.sum(F.pow(F.col("_d") - F.least(F.lit(0.5), F.col("_m")), 2) / F.col("_e"))
                                    .alias("statistic"))
        yates = yates.select("statistic", F.lit(1).cast("long").alias("df"), "n", F.lit(True).alias("yates"))
        out = _one(out).join(_one(yates.select(F.col("statistic").alias("_ys"))), "_one", "left").select(
            F.coalesce("_ys", "statistic").alias("statistic"), "df", "n",
            F.col("_ys").isNotNull().alias("yates"))
    return out


def chi_square_p(df: DataFrame, a: str, b: str, correction: bool = True, alpha: float = 0.05) -> DataFrame:
    """TST3 with p-value and a ``reject_at_alpha`` flag (never prose, see quirk Q3)."""
    out = chi_square(df, a, b, correction)
    out = out.withColumn("p_value", dist.p_value("chi2", F.col("statistic"), F.col("df")))
    return out.withColumn("reject", F.col("p_value") < alpha)


def anova_oneway(df: DataFrame, ys: Sequence[str], gs: Sequence[str]) -> DataFrame:
    """TST4: one-way ANOVA for every (response, factor) pair in one pass.

    The table is unpivoted to (y, g, level, value); one ``groupBy`` gives
    n, mean and variance per level; the finish computes SSB, SSW, F.
    Output rows per (y, g): term ``C(g)`` and ``Residual`` with sum_sq, df, F.
    """
    pairs = [F.struct(F.lit(y).alias("y"), F.lit(g).alias("g"), F.col(g).cast("string").alias("level"),
                      F.col(y).cast("double").alias("value")) for y in ys for g in gs]
    long = df.select(F.explode(F.array(*pairs)).alias("u")).select("u.*")
    long = long.where(F.col("value").isNotNull() & F.col("level").isNotNull())
    lv = long.groupBy("y", "g", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"),
                                             F.var_samp("value").alias("v"))
    tot = lv.groupBy("y", "g").agg(F.sum("n").alias("ntot"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
                                  F.count(F.lit(1)).alias("k"))
    j = lv.join(tot, ["y", "g"])
    ss = j.groupBy("y", "g", "ntot", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"))
    ss = (ss.withColumn("dfb", (F.col("k") - 1).cast("long")).withColumn("dfw", (F.col("ntot") - F.col("k")).cast("long"))
          .withColumn("F", (F.col("ssb") / F.col("dfb")) / (F.col("ssw") / F.col("dfw"))))
    return ss.select("y", "g", F.explode(F.array(
        F.struct(F.concat(F.lit("C("), F.col("g"), F.lit(")")).alias("term"), F.col("ssb").alias("sum_sq"),
                 F.col("dfb").alias("df"), F.col("F").alias("F")),
        F.struct(F.lit("Residual").alias("term"), F.col("ssw").alias("sum_sq"), F.col("dfw").alias("df"),
                 F.lit(None).cast("double").alias("F")))).alias("r")).select("y", "g", "r.*")


def anova_with_p(df: DataFrame, ys: Sequence[str], gs: Sequence[str]) -> DataFrame:
    """TST4 with ``PR(>F)``."""
    a = anova_oneway(df, ys, gs)
    dfw = F.max(F.when(F.col("term") == "Residual", F.col("df"))).over(Window.partitionBy("y", "g"))
    return a.withColumn("_dfw", dfw).withColumn(
        "p_value", F.when(F.col("F").isNotNull(), dist.p_value("f", F.col("F"), F.col("df"), F.col("_dfw")))).drop("_dfw")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """TST7: Pearson correlation (pairwise complete)."""
    return df.agg(F.corr(x, y).alias("r"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "corr") -> DataFrame:
    """TST8 / TST9: long-form correlation or covariance matrix, one aggregate for all pairs."""
    cols = list(cols)
    fn = {"corr": F.corr, "cov": F.covar_samp}[method]
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if method == "corr" and a == b:
                continue
            aggs.append(fn(a, b).alias(f"{a}__{b}"))
    one = df.agg(*aggs) if aggs else df.agg(F.lit(1).alias("_"))
    items = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if method == "corr" and a == b:
                val = F.lit(1.0)
            else:
                lo, hi = (a, b) if i <= j else (b, a)
                val = F.col(f"{lo}__{hi}")
            items.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), val.alias("value")))
    return one.select(F.explode(F.array(*items)).alias("u")).select("u.*")


def correlation_test(df: DataFrame, x: str, y: str, conf: float = 0.95) -> DataFrame:
    """TST10: R ``cor.test``: r, n, df, t, Fisher-z interval (p-value in :func:`correlation_test_p`)."""
    z = dist.norm_ppf(1 - (1 - conf) / 2)
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = data.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    fz = F.atanh(F.col("r"))
    se = F.lit(1.0) / F.sqrt(F.col("n") - 3)
    return a.select("r", "n", (F.col("n") - 2).cast("long").alias("df"),
                    (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"),
                    F.tanh(fz - z * se).alias("lower"), F.tanh(fz + z * se).alias("upper"))


def correlation_test_p(df: DataFrame, x: str, y: str, conf: float = 0.95) -> DataFrame:
    out = correlation_test(df, x, y, conf)
    return out.withColumn("p_value", dist.p_value("t", F.col("t"), F.col("df")))


def moments(df: DataFrame, col: str, groups: Sequence[str] = ()) -> DataFrame:
    """TST12: n, mean, population skewness, excess kurtosis, Jarque-Bera."""
    a = df.where(F.col(col).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"),
        F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow(F.col("skew"), 2) + F.pow(F.col("kurtosis"), 2) / 4)
    return a.withColumn("jarque_bera", jb)


def omnibus(skew: float, kurt_excess: float, n: int) -> tuple[float, float]:
    """D'Agostino-Pearson K^2 from population skewness / excess kurtosis (driver finish)."""
    b2 = skew
    y = b2 * math.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = y if y != 0 else 1.0e-300
    zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    b2k = kurt_excess + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    xk = (b2k - e) / math.sqrt(var)
    sqrtbeta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a_ = 6.0 + 8.0 / sqrtbeta1 * (2.0 / sqrtbeta1 + math.sqrt(1 + 4.0 / (sqrtbeta1 ** 2)))
    term1 = 1 - 2 / (9.0 * a_)
    denom = 1 + xk * math.sqrt(2 / (a_ - 4.0))
    term2 = math.copysign(1, denom) * ((1 - 2.0 / a_) / abs(denom)) ** (1 / 3.0) if denom != 0 else float("nan")
    zk = (term1 - term2) / math.sqrt(2 / (9.0 * a_))
    k2 = zs * zs + zk * zk
    return k2, dist.chi2_sf(k2, 2)


# Royston (1992/1995) polynomial coefficients for the
# Shapiro-Wilk weights and the normalising transform of W.
_SW_AN = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_AN1 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_SMALL_GAMMA = (-2.273, 0.459)
_SW_SMALL_MU = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SW_SMALL_SIGMA = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_LARGE_MU = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_LARGE_SIGMA = (-0.4803, -0.082676, 0.0030302)


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(df: DataFrame, col: str) -> DataFrame:
    """TST11: Shapiro-Wilk W and p (Royston), computed with distributed sums.

    Ranks come from :func:`with_position`; normal scores
    ``m_i = Phi^-1((i - 3/8)/(n + 1/4))`` are an Arrow UDF; the only driver
    work is a handful of scalars. Two passes over the ranked rows: count and
    mean, then one aggregate with sum m^2, the sum of squares, sum m*x and
    the values at the end ranks, from which the weighted sum follows.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    ranked = with_position(x, ["x"], "i", ties=True)
    stats = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")).first()
    n = int(stats["n"])
    if n < 3:
        raise ValueError("Shapiro-Wilk needs at least 3 values")
    m = dist.norm_quantile_col((F.col("i") - 0.375) / (n + 0.25))
    scored = ranked.withColumn("m", m)
    i, xc, mc = F.col("i"), F.col("x"), F.col("m")
    ends = {1: "1", 2: "2", n - 1: "n1", n: "n"}
    # one pass: sum m^2, sum of squares, sum m*x and the scores / values at the four end ranks
    sums = scored.agg(F.sum(mc * mc).alias("mm"), F.sum(F.pow(xc - float(stats["mean"]), 2)).alias("ss"),
                      F.sum(mc * xc).alias("mx"),
                      *[F.max(F.when(i == k, xc)).alias(f"x{nm}") for k, nm in ends.items()],
                      *[F.max(F.when(i == k, mc)).alias(f"m{nm}") for k, nm in ends.items()]).first()
    mm, ss, mx = float(sums["mm"]), float(sums["ss"]), float(sums["mx"])
    xv = {nm: float(sums[f"x{nm}"]) for nm in ends.values()}
    mv = {nm: float(sums[f"m{nm}"]) for nm in ends.values()}
    m_n = dist.norm_ppf((n - 0.375) / (n + 0.25))
    m_n1 = dist.norm_ppf((n - 1 - 0.375) / (n + 0.25))
    u = 1.0 / math.sqrt(n)
    a_n = m_n / math.sqrt(mm) + _poly(_SW_AN, u)
    if n == 3:
        # coefficients (-sqrt(1/2), 0, sqrt(1/2))
        num = math.sqrt(0.5) * (xv["n"] - xv["1"])
    else:
        if n > 5:
            a_n1 = m_n1 / math.sqrt(mm) + _poly(_SW_AN1, u)
            phi = (mm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
            fixed = ["1", "2", "n1", "n"]
            num = a_n * (xv["n"] - xv["1"]) + a_n1 * (xv["n1"] - xv["2"])
        else:
            phi = (mm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2)
            fixed = ["1", "n"]
            num = a_n * (xv["n"] - xv["1"])
        # middle ranks take m_i / sqrt(phi): their sum is sum(m x) less the end ranks' terms
        num += (mx - sum(mv[k] * xv[k] for k in fixed)) / math.sqrt(phi)
    w = min(1.0, float(num) ** 2 / ss)
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        gamma = _poly(_SW_SMALL_GAMMA, n)
        mu, sigma = _poly(_SW_SMALL_MU, n), math.exp(_poly(_SW_SMALL_SIGMA, n))
        z = (-math.log(gamma - math.log1p(-w)) - mu) / sigma
        p = 1 - dist.norm_cdf(z)
    else:
        ln = math.log(n)
        mu, sigma = _poly(_SW_LARGE_MU, ln), math.exp(_poly(_SW_LARGE_SIGMA, ln))
        z = (math.log1p(-w) - mu) / sigma
        p = 1 - dist.norm_cdf(z)
    spark = df.sparkSession
    return spark.createDataFrame([(n, w, p)], "n long, W double, p_value double")
