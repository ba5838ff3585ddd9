"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def cut_pieces(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters, the last one shorter; an empty text is one empty piece.

    ``substring`` reads from the text's start, so cutting a long text at once would take square time. It is cut
    into large pieces first, those into smaller ones, and so on.
    """
    def pieces_of(whole: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(n))
        return F.transform(starts, lambda s: F.substring(whole, s, n))

    def nested(whole: Column, n: int) -> Column:
        if n <= size:
            return pieces_of(whole, size)
        return F.flatten(F.transform(pieces_of(whole, n), lambda p: nested(p, n // 16)))
    long_, longer = nested(text, size * 16), nested(text, size * 16 ** 3)
    return (F.when(F.length(text) <= 16 * size, pieces_of(text, size))
            .when(F.length(text) <= size * 16 ** 3, long_).otherwise(longer))


def field(df: DataFrame, name: str, alias: str) -> T.StructField:
    return T.StructField(alias, df.schema[name].dataType, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name not in ``df`` (input tables may carry any extra columns)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def union_find_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index for each of ``n`` vertices joined by the pairs ``a``-``b`` (vectorised)."""
    lab = np.arange(n, dtype=np.int64) if labels is None else labels
    while a.size:
        la, lb = lab[a], lab[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(lab, high, low)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab
