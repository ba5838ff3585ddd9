"""Global row positions and order statistics without a single-partition window.

``row_number() over (order by k)`` with no partition key moves every row to
one task. Here rows are range-partitioned on the key, numbered inside each
partition, and shifted by the sizes of the partitions before them. The
per-partition size table has one row per partition, so broadcasting it is
bounded by the partition count, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.session import BROADCAST_MAX_ROWS, broadcast_if_small, cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _partitions(df: DataFrame, partitions: int | None) -> int:
    """Range partitions: explicit, else ``spark.statfold.rangePartitions``, else the larger of the
    shuffle-partition setting and twice the task slots, so the sort pieces shrink as the cluster grows."""
    if partitions:
        return partitions
    spark = df.sparkSession
    configured = spark.conf.get("spark.statfold.rangePartitions", None)
    if configured:
        return int(configured)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, 2 * spark.sparkContext.defaultParallelism)


def _ranged(df: DataFrame, keys: list[Column], partitions: int, ties: bool) -> DataFrame:
    """Range partitions sorted inside; with ``ties`` a row tiebreak joins the key, so that
    one value held by a third of all rows is split over many partitions instead of one."""
    if ties:
        df = df.withColumn("_tb", F.monotonically_increasing_id())
        keys = [*keys, F.col("_tb")]
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def with_position(df: DataFrame, order_by, col: str = "pos", partitions: int | None = None,
                  ties: bool = False) -> DataFrame:
    """Add a 1-based global position under ``order_by``.

    ``order_by`` should be a total order (add an id as the last key). With
    ``ties=True`` rows with equal keys are treated as interchangeable (order
    statistics, ranks of sorted values): they are numbered in an arbitrary
    order and may be spread over several range partitions. The numbered rows
    are written once to the shared folder, so the numbering never changes on
    recomputation.
    """
    ranged = _ranged(df, _cols(order_by), _partitions(df, partitions), ties)
    if ties:
        ranged = ranged.drop("_tb")  # only needed to place and sort the rows
    tagged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = (tagged.join(F.broadcast(offsets), "_pid")
           .withColumn(col, (F.col("_off") + F.col("_loc") + 1).cast("long"))
           .drop("_mid", "_pid", "_loc", "_off"))
    return out


def with_group_rank(df: DataFrame, groups: Sequence[str], order_by, col: str = "rank",
                    size_col: str | None = None, partitions: int | None = None,
                    max_groups: int | None = None) -> DataFrame:
    """1-based position inside each group (``row_number`` semantics), skew-safe.

    A group holding a third of all rows is spread over many range partitions
    instead of landing in one window task. ``max_groups`` is a known bound on
    the number of groups (e.g. classes); under it the group starts are
    broadcast without counting them first.
    """
    groups = list(groups)
    pos = with_position(df, [*_cols(groups), *_cols(order_by)], "_gpos", partitions)
    if not groups:
        out = pos.withColumnRenamed("_gpos", col)
        if size_col:
            total = out.agg(F.count(F.lit(1)).alias(size_col), F.lit(0).alias("_k"))
            out = out.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")
        return out
    starts = pos.groupBy(*groups).agg(F.min("_gpos").alias("_start"), F.count(F.lit(1)).alias("_gn"))
    small = (F.broadcast(starts) if max_groups is not None and max_groups <= BROADCAST_MAX_ROWS
             else broadcast_if_small(starts))
    out = pos.join(small, groups, "inner").withColumn(col, F.col("_gpos") - F.col("_start") + 1)
    if size_col:
        out = out.withColumnRenamed("_gn", size_col)
    else:
        out = out.drop("_gn")
    return out.drop("_gpos", "_start")


def order_statistics(df: DataFrame, value: str, positions, groups: Sequence[str] = (),
                     names: Sequence[str] | None = None, partitions: int | None = None,
                     max_groups: int | None = None) -> DataFrame:
    """Values at fractional 1-based positions, interpolated linearly.

    ``positions`` are Column expressions of ``_n`` (the non-null group size);
    position ``h`` reads ``x[floor(h)] + (h - floor(h)) * (x[ceil(h)] - x[floor(h)])``.
    The positions are found by counting value buckets (:mod:`statfold.operators.select`): a few
    scans with map-side counts, nothing sorted or written. Where the groups are too many for
    that, rows get global positions instead (:func:`sorted_statistics`). ``max_groups`` is a
    known bound on the number of groups (e.g. the number of unpivoted columns).
    """
    from statfold.operators.select import NUMERIC, interpolated, values_at

    groups = list(groups)
    names = list(names or [f"p{i}" for i in range(len(positions))])
    data = df.select(*groups, value).where(F.col(value).isNotNull())
    if not isinstance(data.schema[value].dataType, NUMERIC):
        return sorted_statistics(df, value, positions, groups, names, partitions, max_groups)
    spark, read = df.sparkSession, {}

    def places(n: int) -> list[float]:
        if n not in read:
            row = spark.range(1).select(F.lit(n).cast("long").alias("_n")).select(
                *[h.cast("double").alias(f"h{i}") for i, h in enumerate(positions)]).first()
            read[n] = [float(x) for x in row]
        return read[n]
    found = values_at(data, value, lambda n: [r for h in places(n) for r in (math.floor(h), math.ceil(h))], groups,
                      bounded=not groups or (max_groups is not None and max_groups <= 1000))
    if found is None:
        return sorted_statistics(df, value, positions, groups, names, partitions, max_groups)
    schema = T.StructType([*[df.schema[g] for g in groups], *[T.StructField(n, T.DoubleType()) for n in names]])
    rows = [(*group, *[interpolated(at, h) for h in places(n)]) for group, (n, at) in found.items()]
    return spark.createDataFrame(rows, schema)


def sorted_statistics(df: DataFrame, value: str, positions, groups: Sequence[str] = (),
                      names: Sequence[str] | None = None, partitions: int | None = None,
                      max_groups: int | None = None) -> DataFrame:
    """:func:`order_statistics` from global positions, for any number of groups.

    Rows get global positions under (groups, value); each group's first
    position and size come from a small aggregate, so the needed order
    statistics are a handful of global positions, fetched with a broadcast
    semi-join. No group is gathered into one task and no full-size join runs.
    ``max_groups`` is a known bound on the number of groups; under it the needed
    positions are broadcast without counting them first.
    """
    groups = list(groups)
    names = list(names or [f"p{i}" for i in range(len(positions))])
    data = df.select(*groups, value).where(F.col(value).isNotNull())
    pos = with_position(data, [*_cols(groups), F.col(value)], "_gpos", partitions, ties=True)
    sizes = pos.groupBy(*groups).agg(F.min("_gpos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select(*groups, "_start", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), h.cast("double").alias("h")) for i, h in enumerate(positions)])).alias("w"))
    wanted = wanted.select(*groups, "w.qi", "w.h",
                           (F.col("_start") + F.floor("w.h").cast("long") - 1).alias("lo"),
                           (F.col("_start") + F.ceil("w.h").cast("long") - 1).alias("hi"),
                           (F.col("w.h") - F.floor("w.h")).alias("frac"))
    # at most 2 x groups x positions rows: broadcast while that is small, else a shuffle semi-join
    need = wanted.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_gpos")).distinct()
    if not groups or (max_groups is not None and 2 * max_groups * len(positions) <= BROADCAST_MAX_ROWS):
        need = F.broadcast(need)
    else:
        need = broadcast_if_small(need)
    picked = pos.join(need, "_gpos", "left_semi").select("_gpos", value)
    lo = picked.select(F.col("_gpos").alias("lo"), F.col(value).alias("_xlo"))
    hi = picked.select(F.col("_gpos").alias("hi"), F.col(value).alias("_xhi"))
    q = (wanted.join(lo, "lo").join(hi, "hi")
         .withColumn("_q", F.col("_xlo") + F.col("frac") * (F.col("_xhi") - F.col("_xlo"))))
    return q.groupBy(*groups).agg(*[
        F.max(F.when(F.col("qi") == i, F.col("_q"))).alias(nm) for i, nm in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                    names: Sequence[str] | None = None, partitions: int | None = None,
                    max_groups: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / R type 7 / ``quantile_cont``)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    positions = [F.lit(float(p)) * (F.col("_n") - 1) + 1 for p in probs]
    return order_statistics(df, value, positions, groups, names, partitions, max_groups)


def _local_sums(values: list[str], names: list[str]):
    """mapInPandas body: running sums along one sorted range partition (state kept across batches)."""
    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = [0] * len(values)
        for pdf in batches:
            pdf["_pid"] = pid
            for i, (v, nm) in enumerate(zip(values, names)):
                local = pdf[v].fillna(0).cumsum() + carry[i]
                if len(local):
                    carry[i] = local.iloc[-1]
                pdf[nm] = local
            yield pdf
    return run


def running_sum(df: DataFrame, order_by, value, out, partitions: int | None = None) -> DataFrame:
    """Cumulative sums of ``value`` (a column or a list) along ``order_by``, for tables of any length.

    Range partitions are sorted and each carries its local running sums,
    computed in one pass over the sorted rows (``mapInPandas`` keeps the
    range partitioning, so no second shuffle is needed); the totals of the
    earlier partitions (one row per partition) are added back through a
    broadcast. ``order_by`` must be a total order (as after a ``groupBy`` on
    the key).
    """
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    keys = _cols(order_by)
    ranged = _ranged(df, keys, _partitions(df, partitions), False)
    locs = [f"_loc{i}" for i in range(len(values))]
    sum_types = [T.LongType() if isinstance(ranged.schema[v].dataType, T.IntegralType) else T.DoubleType()
                 for v in values]
    schema = T.StructType(ranged.schema.fields + [T.StructField("_pid", T.IntegerType())]
                          + [T.StructField(nm, t) for nm, t in zip(locs, sum_types)])
    tagged = cut_lineage(ranged.mapInPandas(_local_sums(values, locs), schema))
    totals = tagged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_off{i}")
                                      for i in range(len(values))])
    res = tagged.join(F.broadcast(offsets), "_pid")
    for i, o in enumerate(outs):
        res = res.withColumn(o, F.col(f"_off{i}") + F.col(f"_loc{i}"))
    return res.drop("_pid", *locs, *[f"_off{i}" for i in range(len(values))])


def _previous_values(value: str, out: str):
    """mapInPandas body: the previous row's ``value`` along one sorted range partition."""
    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry, seen = None, 0
        for pdf in batches:
            prev = pdf[value].shift(1)
            if len(pdf):
                prev.iloc[0] = carry
                carry = pdf[value].iloc[-1]
            pdf[out] = prev
            pdf["_pid"] = pid
            pdf["_loc"] = range(seen, seen + len(pdf))
            seen += len(pdf)
            yield pdf
    return run


def with_previous(df: DataFrame, order_by, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``lag(value)`` along ``order_by`` (a total order) for tables of any length.

    Rows are range-partitioned and sorted once; a pass along each sorted
    partition carries the previous value (narrow, no second shuffle) and the
    rows are written once. The first row of every partition then takes the
    last value of the partition before it, from a table with one row per
    partition (broadcast).
    """
    ranged = _ranged(df, _cols(order_by), _partitions(df, partitions), False)
    schema = T.StructType(ranged.schema.fields + [T.StructField(out, ranged.schema[value].dataType),
                                                  T.StructField("_pid", T.IntegerType()),
                                                  T.StructField("_loc", T.LongType())])
    tagged = cut_lineage(ranged.mapInPandas(_previous_values(value, out), schema))
    lasts = tagged.groupBy("_pid").agg(F.max_by(value, "_loc").alias("_last"))
    before = Window.orderBy("_pid")
    seams = lasts.select("_pid", F.lit(0).cast("long").alias("_loc"), F.lag("_last").over(before).alias("_seam"))
    res = tagged.join(F.broadcast(seams), ["_pid", "_loc"], "left")
    return res.withColumn(out, F.coalesce(F.col(out), F.col("_seam"))).drop("_pid", "_loc", "_seam")
