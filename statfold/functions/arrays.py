"""Array helpers (ARR1-3, MTH1, ARG1, TOP3, SCL3) as higher-order functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_int_array(s) -> Column:
    """ARR1: ``'1 2  3'`` -> [1, 2, 3]; unparsable tokens become null."""
    body = F.regexp_replace(_c(s), r"^\s+|\s+$", "")
    return F.when(body == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(body, r"\s+"), lambda t: t.try_cast("int")))


def reshape(a, rows: int, cols: int) -> Column:
    """ARR2: flat row-major array -> array of ``rows`` arrays of ``cols``."""
    arr = _c(a)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(arr, r * cols + 1, cols))


def flatten(a) -> Column:
    return F.flatten(_c(a))


def to_float32(a) -> Column:
    """ARR3."""
    return _c(a).cast("array<float>")


def with_softmax(df, col: str, out: str):
    """MTH1: numerically safe softmax (subtract the maximum) of an array column.

    The maximum and the sum are separate columns: an expression used inside a
    lambda would be re-evaluated for every element.
    """
    arr = F.col(col).cast("array<double>")
    df = df.withColumn("_sm_max", F.array_max(arr))
    df = df.withColumn("_sm_e", F.transform(arr, lambda x: F.exp(x - F.col("_sm_max"))))
    df = df.withColumn("_sm_s", F.aggregate("_sm_e", F.lit(0.0), lambda acc, x: acc + x))
    return df.withColumn(out, F.transform("_sm_e", lambda x: x / F.col("_sm_s"))).drop("_sm_max", "_sm_e", "_sm_s")


def argmax(a) -> Column:
    """ARG1: 0-based index of the first maximum (numpy ``argmax``)."""
    arr = _c(a)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def last_n(a, n: int) -> Column:
    """TOP3: the last n elements (all of a shorter array; [] for an empty one)."""
    arr = _c(a)
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))


def with_minmax(df, col: str, out: str, eps: float = 1e-8):
    """SCL3: ``(x - min) / (max - min + eps)`` within each array (bounds as columns, see softmax)."""
    arr = F.col(col).cast("array<double>")
    df = df.withColumn("_mm_lo", F.array_min(arr)).withColumn("_mm_hi", F.array_max(arr))
    return df.withColumn(out, F.transform(arr, lambda x: (x - F.col("_mm_lo")) / (F.col("_mm_hi") - F.col("_mm_lo") + F.lit(eps)))
                         ).drop("_mm_lo", "_mm_hi")


def whitespace_words(text) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty tokens."""
    body = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))
