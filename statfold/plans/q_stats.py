"""Statistical test queries (TST*). Statistic and df are oracle-checked; p-values are rows-only."""

from __future__ import annotations

from statfold.functions import dist
from statfold.operators import stats
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register

Z95 = dist.norm_ppf(0.975)
SIGMA_QTY = 14.4


@register("tst1_z_interval", f"""
SELECT CAST(0.95 AS DOUBLE) AS conf, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean,
       round(avg(l_quantity) - {Z95!r}::DOUBLE * {SIGMA_QTY} / sqrt(count(l_quantity)), 4) AS lower,
       round(avg(l_quantity) + {Z95!r}::DOUBLE * {SIGMA_QTY} / sqrt(count(l_quantity)), 4) AS upper,
       round((avg(l_quantity) - 25.0) / ({SIGMA_QTY} / sqrt(count(l_quantity))), 4) AS z
FROM lineitem
""")
def tst1_z_interval(spark, sf):
    return round_doubles(stats.z_interval(Tables(spark, sf).lineitem, "l_quantity", SIGMA_QTY, 0.95, 25.0))


@register("tst2_t_statistic", """
SELECT l_returnflag, count(l_discount) AS n, round(avg(l_discount), 4) AS mean, round(stddev_samp(l_discount), 4) AS sd,
       round(stddev_samp(l_discount) / sqrt(count(l_discount)), 6) AS se,
       round((avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(l_discount))), 4) AS t,
       count(l_discount) - 1 AS df
FROM lineitem GROUP BY 1
""")
def tst2_t_statistic(spark, sf):
    out = stats.t_statistic(Tables(spark, sf).lineitem, "l_discount", 0.05, ["l_returnflag"])
    out = round_doubles(out.drop("se"), 4).join(
        round_doubles(out.select("l_returnflag", "se"), 6), "l_returnflag")
    return out


@register("tst2_t_interval")
def tst2_t_interval(spark, sf):
    return stats.t_interval(Tables(spark, sf).lineitem, "l_discount", 0.99, 0.05, ["l_returnflag"])


@register("tst3_chi_square_yates", """
WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
     la AS (SELECT DISTINCT a FROM c), lb AS (SELECT DISTINCT b FROM c),
     f AS (SELECT la.a, lb.b, coalesce(c.o, 0) AS o FROM la CROSS JOIN lb LEFT JOIN c ON c.a = la.a AND c.b = lb.b),
     r AS (SELECT a, sum(o) AS r FROM f GROUP BY a), k AS (SELECT b, sum(o) AS k FROM f GROUP BY b),
     n AS (SELECT sum(o) AS n FROM f),
     e AS (SELECT f.o, r.r * k.k / n.n AS e FROM f JOIN r USING (a) JOIN k USING (b), n)
SELECT round(sum(power(abs(o - e) - least(0.5, (SELECT min(abs(o - e)) FROM e)), 2) / e), 4) AS statistic,
       CAST(1 AS BIGINT) AS df, CAST((SELECT n FROM n) AS BIGINT) AS n, true AS yates FROM e
""")
def tst3_chi_square_yates(spark, sf):
    return round_doubles(stats.chi_square(Tables(spark, sf).labels, "quality", "toxic", True))


@register("tst3_chi_square_rxc", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
     r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), k AS (SELECT b, sum(o) AS k FROM c GROUP BY b),
     n AS (SELECT sum(o) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM c)
SELECT round(sum(o * o / (r * k / n)) - max(n), 4) AS statistic, CAST((max(nr) - 1) * (max(nc) - 1) AS BIGINT) AS df,
       CAST(max(n) AS BIGINT) AS n, false AS yates
FROM c JOIN r USING (a) JOIN k USING (b), n
""")
def tst3_chi_square_rxc(spark, sf):
    return round_doubles(stats.chi_square(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority", True))


@register("tst3_chi_square_p")
def tst3_chi_square_p(spark, sf):
    return stats.chi_square_p(Tables(spark, sf).labels, "quality", "toxic", True)


_YS = ["l_extendedprice", "l_discount", "l_tax"]
_GS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _anova_sql(y: str, g: str) -> str:
    return f"""
SELECT '{y}' AS y, '{g}' AS g, t.term, round(t.sum_sq, 2) AS sum_sq, t.df, round(t.F, 4) AS F FROM (
  SELECT unnest([{{'term': 'C({g})', 'sum_sq': ssb, 'df': k - 1, 'F': (ssb / (k - 1)) / (ssw / (nn - k))}},
                 {{'term': 'Residual', 'sum_sq': ssw, 'df': nn - k, 'F': NULL::DOUBLE}}]) AS t
  FROM (SELECT sum(n * power(m - gm, 2)) AS ssb, sum(coalesce((n - 1) * v, 0)) AS ssw, max(nn) AS nn, max(k) AS k
        FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS gm, sum(n) OVER () AS nn, count(*) OVER () AS k
              FROM (SELECT CAST({g} AS VARCHAR) AS level, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v
                    FROM lineitem WHERE {y} IS NOT NULL AND {g} IS NOT NULL GROUP BY 1))))"""


@register("tst4_anova_sweep", "\nUNION ALL\n".join(_anova_sql(y, g) for y in _YS for g in _GS))
def tst4_anova_sweep(spark, sf):
    from pyspark.sql import functions as F
    out = stats.anova_oneway(Tables(spark, sf).lineitem, _YS, _GS)
    return out.select("y", "g", "term", F.round("sum_sq", 2).alias("sum_sq"), "df", F.round("F", 4).alias("F"))


@register("tst4_anova_p")
def tst4_anova_p(spark, sf):
    return stats.anova_with_p(Tables(spark, sf).lineitem, _YS, _GS)


@register("tst7_correlation", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem")
def tst7_correlation(spark, sf):
    return round_doubles(stats.correlation(Tables(spark, sf).lineitem, "l_extendedprice", "l_quantity"), 6)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


_SMALL = ["l_quantity", "l_discount", "l_tax"]


def _matrix_sql(fn: str, digits: int, cols=_NUM) -> str:
    parts = []
    for a in cols:
        for b in cols:
            if fn == "corr" and a == b:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, 1.0::DOUBLE AS value")
            else:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round({fn}({a}, {b}), {digits}) AS value FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("tst8_correlation_matrix", _matrix_sql("corr", 6))
def tst8_correlation_matrix(spark, sf):
    return round_doubles(stats.correlation_matrix(Tables(spark, sf).lineitem, _NUM, "corr"), 6)


@register("tst9_covariance_matrix", _matrix_sql("covar_samp", 8, _SMALL))
def tst9_covariance_matrix(spark, sf):
    return round_doubles(stats.correlation_matrix(Tables(spark, sf).lineitem, _SMALL, "cov"), 8)


@register("tst10_correlation_test", f"""
SELECT round(r, 6) AS r, n, n - 2 AS df, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t,
       round(tanh(atanh(r) - {Z95!r}::DOUBLE / sqrt(n - 3)), 6) AS lower, round(tanh(atanh(r) + {Z95!r}::DOUBLE / sqrt(n - 3)), 6) AS upper
FROM (SELECT corr(o_totalprice, o_custkey) AS r, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL)
""")
def tst10_correlation_test(spark, sf):
    out = stats.correlation_test(Tables(spark, sf).orders, "o_totalprice", "o_custkey")
    from pyspark.sql import functions as F
    return out.select(F.round("r", 6).alias("r"), "n", "df", F.round("t", 4).alias("t"),
                      F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@register("tst10_correlation_test_p")
def tst10_correlation_test_p(spark, sf):
    return stats.correlation_test_p(Tables(spark, sf).orders, "o_totalprice", "o_custkey")


@register("tst11_shapiro_wilk")
def tst11_shapiro_wilk(spark, sf):
    return stats.shapiro_wilk(Tables(spark, sf).customer, "c_acctbal")


@register("tst12_moments", """
SELECT l_returnflag, n, round(mean, 4) AS mean, round(m3 / power(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis,
       round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera
FROM (SELECT l_returnflag, count(*) AS n, avg(mu) AS mean, avg(power(l_quantity - mu, 2)) AS m2,
             avg(power(l_quantity - mu, 3)) AS m3, avg(power(l_quantity - mu, 4)) AS m4
      FROM (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS mu FROM lineitem
            WHERE l_quantity IS NOT NULL) GROUP BY 1)
""")
def tst12_moments(spark, sf):
    out = stats.moments(Tables(spark, sf).lineitem, "l_quantity", ["l_returnflag"])
    from pyspark.sql import functions as F
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("skew", 6).alias("skew"),
                      F.round("kurtosis", 6).alias("kurtosis"), F.round("jarque_bera", 4).alias("jarque_bera"))
