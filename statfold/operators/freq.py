"""Frequency tables, shares, crosstabs, dense period series, histograms.

All of these are one ``groupBy`` (partial aggregation on the map side, one
shuffle on the group key). Totals over all groups come from a one-row
aggregate joined back on a constant key with a broadcast: one row is a
proven size bound, and no global window gathers the groups into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statfold.operators.heavy import most_frequent


def with_total(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """Append the column total of ``value`` to every row (one-row broadcast)."""
    total = df.agg(F.sum(value).alias(out)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def value_counts(df: DataFrame, col: str, dropna: bool = True, out: str = "n") -> DataFrame:
    """AGG1: frequency of each value; nulls excluded unless ``dropna=False``."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def relative_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """AGG2: count and share of each value (denominator = counted rows)."""
    counts = with_total(value_counts(df, col, dropna), "n", "_total")
    return counts.withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def group_share(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """AGG3: ``count`` + ``n/sum(n)`` + percent label; a null group is kept."""
    shares = relative_counts(df, col, dropna=False)
    return shares.withColumn(
        "label", F.format_string(f"%.{digits}f%%", F.col("share") * 100))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG4 / AGG13: size of each (a, b) group, null keys dropped."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence | None = None,
             fill: int | None = None, max_levels: int = 1000) -> DataFrame:
    """AGG5: wide crosstab. Missing cells are null (pandas) or ``fill`` (R: 0).

    Column levels should be passed; otherwise they are read with a
    ``distinct`` that is refused above ``max_levels``.
    """
    if levels is None:
        found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"{col} has more than {max_levels} levels; pass levels explicitly")
        levels = sorted(r[0] for r in found)
    wide = (df.where(F.col(row).isNotNull()).groupBy(row)
            .pivot(col, list(levels)).agg(F.count(F.lit(1))))
    if fill is not None:
        wide = wide.fillna(fill, subset=[str(v) for v in levels])
    return wide


def class_weights(df: DataFrame, label: str, inverse: bool = False) -> DataFrame:
    """AGG6: rows per class and their share (the reference uses the share)."""
    out = relative_counts(df, label).withColumnRenamed("share", "weight")
    if inverse:
        out = out.withColumn("weight", F.lit(1.0) / F.col("weight"))
    return out


def period_counts(df: DataFrame, ts: str, unit: str = "month", out: str = "period") -> DataFrame:
    """AGG7: rows per calendar period (sparse: only periods with rows)."""
    key = F.to_date(F.date_trunc(unit, F.col(ts)))
    return df.where(F.col(ts).isNotNull()).groupBy(key.alias(out)).agg(F.count(F.lit(1)).alias("n"))


def dense_periods(counts: DataFrame, key: str, unit: str = "month", value: str = "n") -> DataFrame:
    """JOI3 / AGG8: add empty periods between the first and last with 0.

    The spine comes from a one-row min/max aggregate exploded into the
    calendar range, so it grows with the time span, not the data.
    """
    bounds = counts.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    spine = bounds.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias(key))
    return (spine.join(counts, key, "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long")))


def running_total(series: DataFrame, order: str, value: str, out: str = "running") -> DataFrame:
    """WIN1 / WIN2: cumulative sum over an already-aggregated series.

    A series of periods or components is small, so the ordered window is
    fine here; long tables use :func:`statfold.operators.position.running_sum`.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn(out, F.sum(value).over(w))


def monthly_running(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """The minimum slice: dense period counts with a running total."""
    counts = period_counts(df, ts, unit, "period")
    dense = dense_periods(counts, "period", unit)
    return running_total(dense, "period", "n", "running").withColumn("running", F.col("running").cast("long"))


def period_end_label(df: DataFrame, key: str, out: str = "period_end") -> DataFrame:
    """AGG8 label: month-end date as pandas ``resample('M')`` prints it."""
    return df.withColumn(out, F.last_day(key))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """TOP1: the n most frequent values; ties broken by value ascending."""
    return most_frequent(df, col, n)


def histogram(df: DataFrame, col: str, bins: int = 10, edges: str = "minmax",
              groups: Sequence[str] = ()) -> DataFrame:
    """AGG11 / AGG12: equal-width histogram, optionally per group with shared edges.

    ``edges='minmax'`` (matplotlib): width = range / bins, last bin closed.
    ``edges='centered'`` (ggplot): width = range / (bins - 1), bins centred
    on the minimum, right-closed.
    """
    groups = list(groups)
    data = df.where(F.col(col).isNotNull())
    bounds = data.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).withColumn("_one", F.lit(1))
    x = F.col(col)
    if edges == "minmax":
        width = (F.col("_hi") - F.col("_lo")) / bins
        raw = F.floor((x - F.col("_lo")) / width)
        idx = F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
        left = F.col("_lo") + F.col("bin") * F.col("_w")
    elif edges == "centered":
        width = (F.col("_hi") - F.col("_lo")) / (bins - 1)
        shifted = (x - F.col("_lo") + width / 2) / width
        idx = F.when(width == 0, F.lit(0)).otherwise(F.ceil(shifted) - 1)
        left = F.col("_lo") - F.col("_w") / 2 + F.col("bin") * F.col("_w")
    else:
        raise ValueError("edges must be 'minmax' or 'centered'")
    binned = (data.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")
              .withColumn("_w", width).withColumn("bin", idx.cast("int")))
    counts = binned.groupBy(*groups, "bin", "_w", "_lo").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*groups, "bin", left.alias("left"), (left + F.col("_w")).alias("right"), "n")


def equal_width_bins(df: DataFrame, col: str, bins: int, out: str = "bin") -> DataFrame:
    """CLN7: R ``cut(x, bins)`` bin index 1..bins (range widened 0.1% at the ends)."""
    bounds = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).withColumn("_one", F.lit(1))
    span = F.col("_hi") - F.col("_lo")
    lo = F.col("_lo") - span / 1000
    hi = F.col("_hi") + span / 1000
    w = (hi - lo) / bins
    idx = F.when(F.col(col).isNull(), None).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(col) - lo) / w))))
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")
            .withColumn(out, idx.cast("int")).drop("_one", "_lo", "_hi"))


def word_frequencies(df: DataFrame, text: str, stop_words: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """AGG14: lower-cased word counts of a text column, stop words removed."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}']+")).alias("word"))
    words = words.where(F.length("word") > 0)
    if stop_words:
        stop = words.sparkSession.createDataFrame([(w,) for w in stop_words], "word string")
        words = words.join(F.broadcast(stop), "word", "left_anti")
    if n is not None:
        return most_frequent(words, "word", n)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fill_missing_levels(counts: DataFrame, key, levels: DataFrame, value: str = "n",
                        keep_unlisted: bool = False) -> DataFrame:
    """JOI2: join a level spine to counts; absent levels get 0.

    ``key`` is a column name or a list (e.g. ``["split", "label"]``). With
    ``keep_unlisted`` counted keys missing from the spine are kept too (the
    reference adds the missing dictionary keys to the observed counts).
    """
    keys = [key] if isinstance(key, str) else list(key)
    joined = levels.join(counts, keys, "full" if keep_unlisted else "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long"))


def lookup_labels(df: DataFrame, key: str, mapping: dict, out: str) -> DataFrame:
    """JOI1: class id -> name through a literal map (no join needed)."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(key)))
