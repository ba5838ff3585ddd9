"""Values at given ranks by counting buckets, without sorting or moving the rows.

A first pass counts rows in value buckets (``OCTAVE`` a factor of two, for either sign: at most ``2 * 2,100 * OCTAVE``
and in practice some hundred), with each bucket's least and greatest value. The bucket that holds a wanted rank is then
an interval of values. An interval with one value answers at once, whatever share of all rows it holds; those that
together hold at most ``FETCH`` rows are fetched; larger ones are counted again in ``SPLIT`` equal parts of themselves
and so on. Each pass is one scan with map-side counts; only counts and at most ``FETCH`` values reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCTAVE = 32
SPLIT = 4096
FETCH = 50_000          # values fetched at once
MAX_CELLS = 500_000     # buckets of all groups that may come to the driver
_LOW, _HIGH = -(1 << 40), 1 << 40
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def bucket(x: Column) -> Column:
    """A whole number that never falls while ``x`` rises; nulls below all, NaN above all (Spark's order)."""
    d = x.cast("double")
    size = F.abs(d)
    step = F.floor(F.log2(size) * OCTAVE).cast("long") + F.lit(1200 * OCTAVE)
    step = F.when(size == F.lit(float("inf")), F.lit(3000 * OCTAVE)).otherwise(step)
    return (F.when(d.isNull(), F.lit(_LOW)).when(F.isnan(d), F.lit(_HIGH)).when(d == 0, F.lit(0))
            .otherwise(F.when(d > 0, step).otherwise(-step)).cast("long"))


class Cell:
    """Rows of a group with values from ``low`` to ``high``: ``count`` of them after ``before`` smaller ones."""

    __slots__ = ("group", "low", "high", "count", "before")

    def __init__(self, group, low, high, count, before):
        self.group, self.low, self.high, self.count, self.before = group, low, high, count, before

    def one_value(self) -> bool:
        return self.low is None or self.low == self.high or (self.low != self.low and self.high != self.high)


def _lay(cells: list[tuple], group, before: int) -> list[Cell]:
    out = []
    for _, low, high, count in cells:
        out.append(Cell(group, low, high, count, before))
        before += count
    return out


def _grouped(table, width: int) -> dict:
    """{group: [(bucket, low, high, count)]} in order of the buckets, from rows (*group, bucket, count, low, high)."""
    cols = [c.to_pylist() for c in table.columns]
    out: dict = {}
    for row in zip(*cols):
        out.setdefault(row[:width], []).append((row[width], row[width + 2], row[width + 3], row[width + 1]))
    for cells in out.values():
        cells.sort(key=lambda c: c[0])
    return out


def _inside(data: DataFrame, cells: list[Cell], groups: list[str]) -> DataFrame:
    """Rows of ``data`` inside the cells, with the cell's number ``_c``; others are left out or all null."""
    spark = data.sparkSession
    kind = data.schema["_x"].dataType
    schema = T.StructType([T.StructField("_c", T.IntegerType()),
                           *[T.StructField(f"_h{i}", data.schema[f"_g{i}"].dataType) for i in range(len(groups))],
                           T.StructField("_lo", kind), T.StructField("_hi", kind)])
    small = F.broadcast(spark.createDataFrame([(k, *c.group, c.low, c.high) for k, c in enumerate(cells)], schema))
    on = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    for i in range(len(groups)):
        on = on & F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}"))
    if not groups and len(cells) <= 16:   # a few intervals are a plain filter
        which = F.lit(None).cast("int")
        for k, c in enumerate(cells):
            which = F.when(F.col("_x").between(F.lit(c.low).cast(kind), F.lit(c.high).cast(kind)), F.lit(k)).otherwise(which)
        lo, hi = (F.element_at(F.array(*[F.lit(getattr(c, e)).cast(kind) for c in cells]), F.col("_c") + 1) for e in ("low", "high"))
        # rows outside keep a null ``_c`` and value: a filter here would be pushed down and work out ``_x`` for every limit
        data = data.withColumn("_c", which)
        return data.select("_c", F.when(F.col("_c").isNotNull(), F.col("_x")).alias("_x"), lo.alias("_lo"), hi.alias("_hi"))
    return data.join(small, on)


def values_at(df: DataFrame, value: str, wanted: Callable[[int], Sequence[int]], groups: Sequence[str] = (),
              bounded: bool = True) -> dict | None:
    """{group: (rows, {rank: (value, rows before it, rows equal to it)})}; ``wanted(rows)`` gives a group's ranks.

    Ranks count from 1 in Spark's ascending order (nulls first, NaN last). ``bounded``: the number of groups is known
    to be small; else None is returned if the buckets are too many for the driver.
    """
    groups = list(groups)
    data = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(value).alias("_x"))
    keys = [f"_g{i}" for i in range(len(groups))]
    counted = data.groupBy(*keys, bucket(F.col("_x")).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    table = (counted if bounded or not groups else counted.limit(MAX_CELLS + 1)).toArrow()
    if table.num_rows > MAX_CELLS:
        return None
    found, open_ = {}, []   # open_: (cell, rank) still to be settled

    def settle(cells: list[Cell], ranks: Sequence[int], at: dict) -> None:
        k = 0
        for rank in sorted(set(ranks)):
            while cells[k].before + cells[k].count < rank:
                k += 1
            c = cells[k]
            if c.one_value():
                at[rank] = (c.low, c.before, c.count)
            else:
                open_.append((c, rank))
    for group, cells in _grouped(table, len(keys)).items():
        rows = sum(c[3] for c in cells)
        found[group] = (rows, {})
        settle(_lay(cells, group, 0), [r for r in wanted(rows) if 1 <= r <= rows], found[group][1])
    while open_:
        todo: dict[int, tuple[Cell, list[int]]] = {}
        for c, rank in open_:
            todo.setdefault(id(c), (c, []))[1].append(rank)
        open_ = []
        cells = [c for c, _ in todo.values()]
        inside = _inside(data, cells, groups)
        if sum(c.count for c in cells) <= FETCH:
            values = inside.groupBy("_c", "_x").agg(F.count(F.lit(1)).alias("n")).toArrow()
            parts = _grouped(values.select(["_c", "_x", "n", "_x", "_x"]), 1)
        else:
            # both ends of a cell fall in different parts, so every pass narrows it
            span = F.col("_hi").cast("double") - F.col("_lo").cast("double")
            share = F.when(F.col("_x") == F.col("_hi"), F.lit(SPLIT)).when(span > 0, F.least(
                F.floor((F.col("_x") - F.col("_lo")).cast("double") / span * SPLIT), F.lit(SPLIT - 1))).otherwise(F.lit(0))
            parts = _grouped(inside.groupBy("_c", share.cast("long").alias("_s")).agg(
                F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")).toArrow(), 1)
        for k, (c, ranks) in enumerate(todo.values()):
            settle(_lay(parts[(k,)], c.group, c.before), ranks, found[c.group][1])
    return found


def _below(key: str, value, equal: bool = False) -> Column:
    """The key lies before ``value`` (``equal``: or at it); it is named once, as it may be costly to work out."""
    if value is None:
        return F.col(key).isNull() if equal else F.lit(False)
    if value != value:
        return F.lit(True) if equal else F.coalesce(~F.isnan(F.col(key)), F.lit(True))
    return F.coalesce(F.col(key) <= F.lit(value) if equal else F.col(key) < F.lit(value), F.lit(True))


class Cut:
    """Which rows are among the first ``bound``. ``among``: if the cut goes through rows equal in all keys, the condition
    for them and the rows before them; ``first`` is then false for them."""

    __slots__ = ("bound", "first", "among", "before")

    def __init__(self, bound, first, among=None, before=0):
        self.bound, self.first, self.among, self.before = bound, first, among, before


def cuts(df: DataFrame, order_by: Sequence[str], bounds: Callable[[int], Sequence[int]]) -> list[Cut] | None:
    """For each bound the cut after that many first rows of ``df`` under ``order_by``; None if a key is not numeric.

    ``bounds`` gets the number of rows. The row at the cut is found key by key, so rows are only filtered, not moved.
    """
    order_by = list(order_by)
    if not all(isinstance(df.schema[k].dataType, NUMERIC) for k in order_by):
        return None
    asked: list[int] = []

    def ranks(n: int) -> list[int]:
        asked[:] = [min(max(int(b), 0), n) for b in bounds(n)]
        return asked
    got = values_at(df, order_by[0], ranks)
    if not got:
        return [Cut(0, F.lit(False)) for _ in bounds(0)]
    (rows, at), out, key = got[()], [], order_by[0]
    through = {repr(at[b][0]): at[b] for b in asked if 0 < b < rows and b != at[b][1] + at[b][2]}
    plain = [v for v, _, _ in through.values() if v is not None and v == v]
    tied = df
    if len(order_by) > 1 and len(plain) == len(through) > 1 and sum(n for _, _, n in through.values()) <= FETCH:
        # the few rows at all cuts are fetched in one scan
        tied = df.sparkSession.createDataFrame(df.where(F.col(key).isin(plain)).select(*order_by).toArrow())
    for bound in asked:
        if bound == 0 or bound == rows:
            out.append(Cut(bound, F.lit(bound == rows)))
            continue
        value, before, equal = at[bound]
        if bound == before + equal:
            out.append(Cut(bound, _below(key, value, True)))
            continue
        same = F.col(key).eqNullSafe(F.lit(value))
        if len(order_by) == 1:
            out.append(Cut(bound, _below(key, value), same, before))
            continue
        rest = cuts(tied.where(same), order_by[1:], lambda _, left=bound - before: [left])[0]
        first = _below(key, value) | (same & rest.first)
        out.append(Cut(bound, first) if rest.among is None else Cut(bound, first, rest.among & same, before + rest.before))
    return out


def first_rows(df: DataFrame, order_by: Sequence[str], bounds: Callable[[int], Sequence[int]]) -> list[Column] | None:
    """For each bound the condition that holds for exactly that many first rows of ``df`` under ``order_by``.

    None if a key is not numeric, or if rows equal in all keys lie on either side of a cut.
    """
    found = cuts(df, order_by, bounds)
    if found is None or any(c.among is not None for c in found):
        return None
    return [c.first for c in found]


def blocks(df: DataFrame, order_by: Sequence[str], bounds: Callable[[int], Sequence[int]], out: str) -> DataFrame | None:
    """Add the number of the block (from 0) that a row falls into when ``df`` is cut after each of the rising bounds.

    Rows equal in all keys through which a cut goes are numbered on their own, in arbitrary order; all others are only
    compared with the rows at the cuts. None if a key is not numeric.
    """
    from statfold.operators.position import with_group_rank
    found = cuts(df, order_by, bounds)
    if found is None:
        return None
    block = F.lit(len(found))
    for i in reversed(range(len(found))):
        block = F.when(found[i].first, F.lit(i)).otherwise(block)
    torn = {c.before: c for c in found if c.among is not None}   # by the rows before: cuts through the same rows once
    placed = df.withColumn(out, block.cast("int"))
    if not torn:
        return placed
    which = F.lit(None).cast("long")
    for before, c in torn.items():
        which = F.when(c.among, F.lit(before)).otherwise(which)
    ranked = with_group_rank(df.withColumn("_before", which).where(F.col("_before").isNotNull()), ["_before"],
                             list(order_by), "_place", max_groups=len(torn))
    place = F.col("_before") + F.col("_place")
    block = F.lit(len(found))
    for i in reversed(range(len(found))):
        block = F.when(place <= F.lit(found[i].bound), F.lit(i)).otherwise(block)
    return placed.where(which.isNull()).unionByName(ranked.withColumn(out, block.cast("int")).drop("_before", "_place"))


def interpolated(at: dict, h: float) -> float:
    """The value at a fractional rank, linear between its neighbours."""
    low, high = (float(at[r][0]) for r in (math.floor(h), math.ceil(h)))
    return low + (h - math.floor(h)) * (high - low)
