"""Exact k-nearest neighbours (ML9, JOI4) and SMOTE (BAL2).

Brute-force kNN is O(|Q| x |R|) distances. Here both sides are laid into the Voronoi cells of a bounded number of
pivots, and the triangle inequality keeps most pairs from ever meeting:

* a query first meets its own cell (with as many near cells as hold ``k`` rows); the k-th distance found there is a
  radius that the true neighbours cannot exceed;
* it is then sent to another cell only if the cell can hold a row within that radius: by the cell's nearest and
  farthest row from its pivot, and by the plane half way between the two pivots;
* inside a cell rows are sorted by their distance to the pivot, and a query is compared with the rows whose
  distance differs from its own by at most the radius.

A cell larger than ``block_rows`` is cut into blocks. Rows travel as rows: a task reads a stream sorted by block, the
reference rows first and then the queries sent to it, and holds one block and a few hundred queries at a time. A block
to which more than ``SHARE_ROWS`` queries are sent is copied, so that several tasks share them. A reference of no more
than ``block_rows`` rows is one block without cells. Candidates are merged with ``row_number() <= k`` per query, of which Spark keeps at most ``k`` per
partition before the shuffle.

Ties in distance are broken by the smaller reference id; vote ties by the smaller label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.functions.hashing import hash_u32, hash_uniform
from statfold.operators.position import with_group_rank
from statfold.session import BROADCAST_MAX_ROWS, broadcast_if_small, cut_lineage

MAX_PIVOTS = 1024     # pivots come from a sample of at most 16 rows each; they steer the work, not the result
QUERY_ROWS = 256      # queries compared at once
PAIRS = 16_384        # pairs whose differences are held at once
SHARE_ROWS = 65_536   # queries of a block that one task takes
_SUBS = 1 << 28       # block number = cell * _SUBS + part of the cell
_COPIES = 1 << 20
_SLACK = 1e-6         # relative to the largest norm: more than the rounding of a pivot distance


def _rows(df: DataFrame, id_col: str, vec: str, label: str | None, kind: int) -> DataFrame:
    y = F.col(label).cast("long") if label else F.lit(None).cast("long")
    return df.where(F.col(vec).isNotNull()).select(
        F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(y, F.lit(-1).cast("long")).alias("y"), F.col(vec).cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not len(column) or flat.size % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("all vectors must have the same length")
    return flat.reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product (rounded: only for bounds)."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """``count`` pivots: evenly spaced rows of the sample, moved to the means of their cells a few times."""
    found = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        near = _squares(sample, found).argmin(axis=1)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        found = np.where((size > 0)[:, None], total / np.maximum(size, 1)[:, None], found)
    return found


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot ``cell``, the distance ``d`` to it and the vector's ``norm``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("d", T.DoubleType()), T.StructField("norm", T.DoubleType())])
    arrow, vec = to_arrow_schema(schema), rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                m = _matrix(part.column(vec))
                squares = _squares(m, pivots)
                cell = squares.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(cell.astype(np.int32)),
                    pa.array(np.sqrt(squares[np.arange(len(cell)), cell])), pa.array(np.sqrt((m * m).sum(axis=1)))],
                    schema=arrow)
    return rows.mapInArrow(run, schema)


def near_rows(q: dict, r: dict, k: int, exclude_self: bool, slack: float) -> tuple[np.ndarray, ...]:
    """The k nearest block rows of each query within its ``radius``: (query, row, squared distance), and pairs looked at.

    ``r`` is sorted by pivot distance ``d``; ``q`` has ``d`` (to the same pivot) and ``radius``. Distances that
    decide are exact sums of squared differences; the matrix product only rules pairs out.
    """
    low = np.searchsorted(r["d"], q["d"] - q["radius"] - slack, side="left")
    high = np.searchsorted(r["d"], q["d"] + q["radius"] + slack, side="right")
    parts, looked = [], 0
    for at in range(0, len(q["d"]), QUERY_ROWS):
        own = slice(at, at + QUERY_ROWS)
        a, b = low[own], high[own]
        if not (b > a).any():
            continue
        first, last = int(a[b > a].min()), int(b.max())
        v, place = q["v"][own], np.arange(first, last)
        rough = _squares(v, r["v"][first:last])
        looked += rough.size
        out = (place < a[:, None]) | (place >= b[:, None])
        if exclude_self:
            out |= q["id"][own, None] == r["id"][first:last]
        rough[out] = np.inf
        most = q["radius"][own] ** 2
        if rough.shape[1] > k:
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        spare = slack * slack + 2 * slack * np.sqrt(np.where(np.isfinite(most), most, 0)) + 1e-9 * (rough.max(
            initial=0, where=np.isfinite(rough)))
        i, j = np.nonzero(np.isfinite(rough) & (rough <= (most + spare)[:, None]))
        # many rows at one distance leave many pairs: their differences are never all held at once
        exact = np.concatenate([((v[i[s:s + PAIRS]] - r["v"][first + j[s:s + PAIRS]]) ** 2).sum(axis=1)
                                for s in range(0, max(len(i), 1), PAIRS)])
        order = np.lexsort((r["id"][first + j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        parts.append((at + i[keep], first + j[keep], exact[keep]))
    if not parts:
        return np.empty(0, int), np.empty(0, int), np.empty(0), looked
    return *(np.concatenate(x) for x in zip(*parts)), looked


_MEET = ["block", "kind", "d", "id", "y", "v", "radius"]


def _meetings(k: int, exclude_self: bool, slack: float, schema: pa.Schema, looked_at=None):
    """Of a stream sorted by (block, kind, d): the nearest rows of every query sent to the block."""
    def take(batch: pa.RecordBatch) -> dict:
        names = dict(zip(_MEET, batch.columns))
        got = {c: names[c].to_numpy(zero_copy_only=False) for c in ("d", "id", "y", "radius")}
        return got | {"v": _matrix(names["v"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, kind = (batch.column(c).to_numpy() for c in (0, 1))
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if not kind[lo]:
                    if here != number[lo]:
                        here, held, block = number[lo], [], None
                    held.append(take(batch.slice(lo, hi - lo)))
                    continue
                if here != number[lo]:
                    continue  # an empty block
                if block is None:
                    block = {c: np.concatenate([x[c] for x in held]) for c in ("d", "id", "y", "v")}
                    held = []
                q = take(batch.slice(lo, hi - lo))
                i, j, exact, looked = near_rows(q, block, k, exclude_self, slack)
                if looked_at is not None:
                    looked_at.add(looked)
                yield pa.RecordBatch.from_arrays([pa.array(q["id"][i]), pa.array(exact), pa.array(block["id"][j]),
                                                  pa.array(block["y"][j])], schema=schema)
    return run


def _shared(blocks: DataFrame, queries: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with more than ``share`` queries copied, their queries dealt over the copies (``copy``)."""
    busy = queries.groupBy("block").count().where(F.col("count") > share).select(
        F.col("block").alias("_b"), F.ceil(F.col("count") / share).cast("int").alias("_n"))
    busy = broadcast_if_small(cut_lineage(busy))
    n = F.coalesce("_n", F.lit(1))
    dealt = queries.join(busy, F.col("block") == F.col("_b"), "left").withColumn("copy", F.pmod(F.xxhash64("id", "v"), n).cast("int"))
    copied = blocks.join(busy, F.col("block") == F.col("_b"), "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), n - 1)))
    return copied, dealt


def _meet(blocks: DataFrame, queries: DataFrame, k: int, exclude_self: bool, slack: float, looked_at) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType.fromDDL("qid long, d2 double, rid long, ry long")
    names = [*_MEET, "copy"]
    stream = blocks.withColumn("radius", F.lit(0.0)).select(*names).unionByName(queries.select(*names))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    arranged = stream.repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind", "d").select(
        (F.col("block") * _COPIES + F.col("copy")).alias("block"), *_MEET[1:])
    return arranged.mapInArrow(_meetings(k, exclude_self, slack, to_arrow_schema(schema), looked_at), schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("d2", "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _reach(pivots: np.ndarray, cells: dict, home: dict, slack: float, fields: list, schema: pa.Schema):
    """mapInArrow body: each query's blocks outside its home cells that may hold a row within its radius."""
    names = sorted(cells)
    middle = pivots[names]
    near = np.array([cells[c][1] for c in names])
    far = np.array([cells[c][2] for c in names])
    between = np.sqrt(_squares(pivots, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cell, d, radius = (part.column(fields.index(c)).to_numpy(zero_copy_only=False)
                                   for c in ("cell", "d", "radius"))
                away = np.sqrt(_squares(_matrix(part.column(fields.index("v"))), middle))
                # least distance to a row of the cell: ring around its pivot, plane between the pivots
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (away ** 2 - (d ** 2)[:, None]) / (2 * between[cell])
                plane = np.where(between[cell] > 0, plane, 0)
                least = np.maximum(np.maximum(away - far, near - away), plane)
                sent = least <= (radius + slack)[:, None]
                rows, to, place = [], [], []
                for i in np.flatnonzero(sent.any(axis=1)).tolist():
                    for j in np.flatnonzero(sent[i]).tolist():
                        if names[j] not in home[cell[i]]:
                            count = cells[names[j]][0]
                            rows += [i] * count
                            to += [names[j] * _SUBS + s for s in range(count)]
                            place += [away[i, j]] * count
                if rows:
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(to, pa.int64()), own.column(fields.index("kind")), pa.array(place, pa.float64()),
                        *[own.column(fields.index(c)) for c in _MEET[3:]]], schema=schema)
    return run


def nearest(queries: DataFrame, reference: DataFrame, id_col: str, vec: str, label: str | None, k: int,
            block_rows: int = 4096, exclude_self: bool = False, looked_at=None) -> DataFrame:
    """Top-k neighbours: (qid, rank, rid, ry, dist) with rank 1..k, exact.

    Rows with a null vector take no part; a missing label is -1. ``looked_at`` is an optional accumulator to which
    the number of pairs compared is added.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = queries.sparkSession
    ref, ask = _rows(reference, id_col, vec, label, 0), _rows(queries, id_col, vec, None, 1)
    drawn = ref.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(16 * MAX_PIVOTS)
    sample = drawn.select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "qid long, rank int, rid long, ry long, dist double")
    sample = _matrix(sample)
    if len(sample) <= block_rows:   # the whole reference: one block, of which every task gets a copy
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        flat = [F.lit(0).cast("long").alias("block"), "kind", F.lit(0.0).alias("d"), "id", "y", "v"]
        everywhere = ref.select(*flat, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("copy"))
        dealt = ask.select(*flat, F.lit(float("inf")).alias("radius"), F.pmod(F.xxhash64("id", "v"), F.lit(tasks)).cast("int").alias("copy"))
        slack = _SLACK * max(float(np.sqrt((sample ** 2).sum(axis=1)).max()), 1e-300)
        top = _first(_meet(everywhere, dealt, k, exclude_self, slack, looked_at), k)
        return top.select("qid", "rank", "rid", "ry", F.sqrt("d2").alias("dist"))
    # a sample smaller than its bound is the whole side
    total = len(sample) if len(sample) < 16 * MAX_PIVOTS else ref.count()
    pivots = choose_pivots(sample, max(1, min(MAX_PIVOTS, int(total ** 0.5 / 2), len(sample))))
    placed = cut_lineage(_placed(ref.unionByName(ask), pivots))
    stats = placed.groupBy("kind", "cell").agg(F.count(F.lit(1)), F.min("d"), F.max("d"), F.max("norm")).collect()
    slack = _SLACK * max(max(r[5] for r in stats), float(np.sqrt((pivots ** 2).sum(axis=1)).max()), 1e-300)
    cells = {r[1]: (-(-r[2] // block_rows), r[3], r[4]) for r in stats if not r[0]}
    counts = {r[1]: r[2] for r in stats if not r[0]}
    # a query's home: its own cell and the nearest ones until they hold k rows besides itself
    home, names = {}, sorted(cells)
    order = np.argsort(_squares(pivots, pivots[names]), axis=1, kind="stable")
    for c in range(len(pivots)):
        held, home[c] = 0, set()
        for j in order[c].tolist():
            home[c].add(names[j])
            held += counts[names[j]]
            if held > k:
                break
    subs = F.create_map(*[F.lit(x) for c in names for x in (c, cells[c][0])])
    blocks = placed.where("kind = 0").withColumn(
        "block", F.col("cell") * F.lit(_SUBS).cast("long") + F.pmod(F.xxhash64("id", "v"), subs[F.col("cell")]))
    asked = placed.where("kind = 1")
    visits = F.create_map(*[x for c in home for x in (F.lit(c), F.array(*map(F.lit, sorted(home[c]))))])
    last = subs[F.col("to")].cast("long") - 1
    first = (asked.withColumn("to", F.explode(visits[F.col("cell")]))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
             .withColumn("block", F.col("to") * F.lit(_SUBS).cast("long") + F.col("part")))
    # the radius is open, so the pivot distance of a near cell's visitor is not looked at
    first = first.withColumn("radius", F.lit(float("inf")))
    crowded = sum(r[2] for r in stats if r[0]) > SHARE_ROWS   # else no block can have so many queries
    alone = F.lit(0).alias("copy")
    share = lambda b, q: _shared(b, q, SHARE_ROWS) if crowded else (b.select("*", alone), q.select("*", alone))
    found = cut_lineage(_first(_meet(*share(blocks, first), k, exclude_self, slack, looked_at), k))
    reach = found.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.sqrt("d2").alias("radius"))
    wider = asked.join(reach, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    fields = ["cell", "radius", "kind", "d", "id", "y", "v"]
    schema = T.StructType([T.StructField("block", T.LongType()), *[
        wider.schema[c] if c != "kind" else placed.schema["kind"] for c in _MEET[1:]]])
    second = wider.select(*fields).mapInArrow(_reach(pivots, cells, home, slack, fields, to_arrow_schema(schema)), schema)
    second = cut_lineage(second) if crowded else second
    more = _meet(*share(blocks, second), k, exclude_self, slack, looked_at)
    top = _first(found.drop("rank").unionByName(more), k)
    return top.select("qid", "rank", "rid", "ry", F.sqrt("d2").alias("dist"))


def vote_curve(neigh: DataFrame, truth: DataFrame, id_col: str, label: str, classes: Sequence[int],
               kmax: int = 39) -> DataFrame:
    """ML9: majority vote among the first k neighbours for every k = 1..kmax (ties -> smallest label)."""
    lists = neigh.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ry"))).alias("_n"))
    lists = lists.select("qid", F.transform("_n", lambda s: s["ry"]).alias("_ys"))
    cls = F.array(*[F.lit(int(c)) for c in sorted(classes)])
    preds = lists.withColumn("_cls", cls).select("qid", F.transform(
        F.sequence(F.lit(1), F.lit(kmax)),
        lambda kk: F.struct(kk.alias("k"), F.element_at("_cls", F.array_position(
            F.transform("_cls", lambda c: F.size(F.filter(F.slice("_ys", 1, kk), lambda y: y == c))),
            F.array_max(F.transform("_cls", lambda c: F.size(F.filter(F.slice("_ys", 1, kk), lambda y: y == c)))))
            .cast("int")).alias("pred"))).alias("_p"))
    flat = preds.select("qid", F.explode("_p").alias("p")).select("qid", "p.k", "p.pred")
    return flat.join(truth.select(F.col(id_col).alias("qid"), F.col(label).alias("label")), "qid")


def error_curve(votes: DataFrame) -> DataFrame:
    """ML9: error rate per k."""
    return votes.groupBy("k").agg(F.avg((F.col("pred") != F.col("label")).cast("double")).alias("error_rate"),
                                  F.count(F.lit(1)).alias("n"))


def smote(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, seed: int = 42,
          minority=None, block_rows: int = 4096) -> DataFrame:
    """BAL2: SMOTE until the classes are equal: ``x + u * (nn - x)`` with a random base row,
    one of its k nearest minority neighbours and a uniform gap, all hash-drawn.

    Output: original rows with ``synthetic = false`` plus synthetic rows (ids are negative draw numbers).
    """
    counts = {r[0]: int(r[1]) for r in df.groupBy(label).count().collect()}
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], str(c)))
    n_min, n_max = counts[minority], max(counts.values())
    need = n_max - n_min
    base = df.select(id_col, vec, label).withColumn("synthetic", F.lit(False))
    if need <= 0 or n_min < 2:
        return base
    mino = df.where(F.col(label) == F.lit(minority)).select(id_col, F.col(vec).cast("array<double>").alias(vec))
    nn = nearest(mino, mino.withColumn("_lab", F.lit(0)), id_col, vec, "_lab", min(k, n_min - 1), block_rows, True)
    nn_lists = nn.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "rid"))).alias("_nn")).select(
        F.col("qid").alias(id_col), F.transform("_nn", lambda s: s["rid"]).alias("_nn"))
    ranked = with_group_rank(mino.join(nn_lists, id_col), [], [id_col], "_r")
    d = df.sparkSession.range(need).select(
        F.col("id").alias("_draw"), (hash_u32(seed, F.col("id")) % n_min + 1).alias("_r"),
        hash_u32(seed + 1, F.col("id")).alias("_pick"), hash_uniform(seed + 2, F.col("id")).alias("_u"))
    partner = mino.select(F.col(id_col).alias("_nid"), F.col(vec).alias("_nv"))
    # both lookups hold the n_min minority rows (counted above): broadcast under that proven bound,
    # else shuffle joins where AQE splits rows drawn very often
    if n_min <= BROADCAST_MAX_ROWS:
        ranked, partner = F.broadcast(ranked), F.broadcast(partner)
    picked = d.join(ranked, "_r").withColumn("_nid", F.element_at("_nn", (F.col("_pick") % F.size("_nn") + 1).cast("int")))
    syn = picked.join(partner, "_nid").select(
        (-(F.col("_draw") + 1)).cast("long").alias(id_col),
        F.zip_with(vec, "_nv", lambda a, b: a + F.col("_u") * (b - a)).alias(vec),
        F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(True).alias("synthetic"))
    base = base.withColumn(vec, F.col(vec).cast("array<double>")).withColumn(id_col, F.col(id_col).cast("long"))
    return base.unionByName(syn)
