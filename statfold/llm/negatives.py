"""Hard negatives by walking candidate lists that a cluster of anchors shares.

Anchors are clustered by direction. For a cluster with mean direction c and largest angle t between c and a member,
no member of length 1 scores more with a candidate v than ``|v| cos(max(0, angle(c, v) - t))``. Candidates are
sorted by that bound once a cluster, and every member walks the same list until the bound times its own length is
below the worst score it still has to keep: then nothing further can enter its result, which is thereby exact.

Candidates lie in cells (nearest of a bounded number of centres) that are cut into blocks. Each cluster meets its
own cell first; the scores found there are the bars with which it meets the blocks of the other cells, and a cell
whose largest bound is below every member's bar is not sent at all. A block and the clusters it meets are a sorted
stream of one task, which holds one block and one cluster at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field
from statfold.session import cut_lineage

MAX_CENTRES = 128       # centres, from a sample of at most SAMPLE anchors; they steer the work, not the result
SAMPLE = 4_096
CLUSTER_ROWS = 256      # anchors that share a list
BLOCK_ROWS = 4_096      # candidates of a list
STEP = 512              # candidates walked between two looks at the bound
LIMIT = 1 << 26         # components beyond +-LIMIT count as that, so that every score is a long
FAR = 1 << 62
_SLACK = 1e-6           # of |a||v|: more than the rounding of an angle

_LONGS = T.ArrayType(T.LongType())
_STREAM = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("sub", T.IntegerType()),
                        T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()),
                        *(T.StructField(c, _LONGS) for c in ("rids", "ids", "ys")),
                        T.StructField("vecs", T.ArrayType(T.IntegerType())),
                        *(T.StructField(c, _LONGS) for c in ("low", "high", "bar"))])
_FOUND = "aid long, arid long, band int, score long, id long, rid long"


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return norm, x / np.where(norm > 0, norm, 1)[:, None]


def _angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``sample`` by spherical k-means from evenly spaced rows."""
    _, units = _unit(sample)
    found = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(rounds):
        near = (units @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, near, units)
        norm, moved = _unit(total)
        found = np.where((norm > 0)[:, None], moved, found)
    return found


def walk(cluster: dict, block: dict, keep: int, same: bool) -> dict:
    """For every member and band the ``keep`` best rows of the block, as index arrays and scores.

    ``cluster`` and ``block`` hold ``v`` (rows x dims), ``y``, ``rid``, and for the block ``id`` and ``null``; the
    cluster has bands ``low``, ``high`` and ``bar`` (members x bands). Rows of the same label (another row) count,
    or those of other labels. Also tells how many scores were taken.
    """
    a, v = cluster["v"], block["v"]
    exact = np.abs(a).max(initial=0) * np.abs(v).max(initial=0) * max(a.shape[1], 1) < 1 << 52
    kind = np.float64 if exact else np.int64
    size, units = _unit(a)
    centre = _unit(units.sum(axis=0, keepdims=True))[1][0]
    spread = _angles(units[size > 0], centre).max(initial=0.0)
    length, directions = _unit(v)
    bound = length * (np.cos(np.maximum(_angles(directions, centre) - spread, 0)) + _SLACK)
    order = np.argsort(-bound, kind="stable")   # the shared list
    bound = np.append(bound[order], -np.inf)
    y, rid, listed = block["y"][order], block["rid"][order], v[order].astype(kind)
    low, high, bar = (cluster[c].astype(kind) for c in ("low", "high", "bar"))
    bar = np.maximum(bar, low)
    m, n, bands = len(a), len(v), low.shape[1]
    none = kind(-FAR)
    scores = np.full((m, n), none, kind)
    best = np.full((m, bands, keep), none, kind)
    open_ = np.where(low <= high, bar, FAR).min(axis=1, initial=FAR)
    at, taken = 0, 0
    live = np.flatnonzero(size * bound[0] >= open_) if n else np.empty(0, int)
    while live.size:
        to = min(at + STEP, n)
        got = a[live].astype(kind) @ listed[at:to].T
        fit = cluster["y"][live, None] == y[at:to]
        fit = fit & (cluster["rid"][live, None] != rid[at:to]) if same else ~fit
        got = np.where(fit, got, none)
        scores[live, at:to] = got
        taken += got.size
        for b in range(bands):
            inside = np.where((got >= bar[live, b, None]) & (got <= high[live, b, None]), got, none)
            rows = np.flatnonzero(inside.max(axis=1) > none)
            if rows.size:
                who = live[rows]
                top = np.concatenate([best[who, b], inside[rows]], axis=1)
                best[who, b] = np.partition(top, top.shape[1] - keep, axis=1)[:, -keep:]
                bar[who, b] = np.maximum(bar[who, b], best[who, b].min(axis=1))
        at = to
        # certified: no later row can reach what the member still looks for
        open_ = np.where(low <= high, bar, FAR).min(axis=1, initial=FAR)
        live = live[size[live] * bound[at] >= open_[live]] if at < n else live[:0]
    parts = []
    for b in range(bands):
        i, j = np.nonzero((scores >= bar[:, b, None]) & (scores <= high[:, b, None]) & (scores > none))
        s = scores[i, j].astype(np.int64)
        place = order[j]
        rank = np.lexsort((block["rid"][place], block["id"][place], block["null"][place], -s, i))
        i, place, s = i[rank], place[rank], s[rank]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
        parts.append((i[first], np.full(int(first.sum()), b), place[first], s[first]))
    i, band, place, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, int),) * 4
    return {"member": i, "band": band, "place": place, "score": s, "taken": taken}


def _numpy(column: pa.Array, k: int, kind=np.int64) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _row(batch: pa.RecordBatch, k: int) -> dict:
    n = batch.column(3)[k].as_py()
    ids = batch.column(5)[k].values
    out = {"rid": _numpy(batch.column(4), k), "null": ids.is_null().to_numpy(zero_copy_only=False),
           "id": ids.fill_null(0).to_numpy(zero_copy_only=False), "y": _numpy(batch.column(6), k),
           "v": _numpy(batch.column(7), k, np.float64).reshape(n, -1)}
    if batch.column(2)[k].as_py():
        out |= {name: _numpy(batch.column(8 + c), k).reshape(n, -1) for c, name in enumerate(("low", "high", "bar"))}
    return out


def _meetings(keep: int, same: bool, schema: pa.Schema):
    """Of a stream sorted by (cell, sub, kind): the walks of each block's clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                place = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if not batch.column(2)[k].as_py():
                    here, block = place, _row(batch, k)
                    continue
                if place != here:
                    continue  # a cluster without a block has nothing to find
                cluster = _row(batch, k)
                f = walk(cluster, block, keep, same)
                i, j = f["member"], f["place"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(cluster["id"][i]), pa.array(cluster["rid"][i]), pa.array(f["band"].astype(np.int32)),
                    pa.array(f["score"].astype(np.int64)), pa.array(block["id"][j], mask=block["null"][j]),
                    pa.array(block["rid"][j])], schema=schema)
    return run


def _arrays(rows: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: ids, labels, flat vectors and flat ``extra`` arrays of its rows."""
    own = rows.groupBy(*keys).agg(F.collect_list(F.struct("rid", "id", "y", "vec", *extra)).alias("_r"))
    one = lambda c: F.transform("_r", lambda x: x[c])
    return own.select(*keys, F.size("_r").alias("n"), one("rid").alias("rids"), one("id").alias("ids"),
                      one("y").alias("ys"), F.flatten(one("vec")).alias("vecs"),
                      *[F.flatten(one(c)).alias(c) for c in extra])


def _meet(clusters: DataFrame, blocks: DataFrame, keep: int, same: bool) -> DataFrame:
    """Best rows (aid, arid, band, score, id, rid) of every cluster in the blocks (cell, sub) it is sent to."""
    from pyspark.sql.pandas.types import to_arrow_schema
    names = [f.name for f in _STREAM]
    empty = [F.lit(None).cast(_LONGS).alias(c) for c in ("low", "high", "bar")]
    stream = (blocks.withColumn("kind", F.lit(0)).select(*names[:8], *empty)
              .unionByName(clusters.withColumn("kind", F.lit(1)).select(*names)))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    arranged = stream.repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "kind")
    schema = T.StructType.fromDDL(_FOUND)
    return arranged.mapInArrow(_meetings(keep, same, to_arrow_schema(schema)), schema)


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("arid", "band").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


class Index:
    """Candidates in cells and blocks, anchors in clusters; ``search`` finds best rows within bands of scores."""

    def __init__(self, rows: DataFrame):
        """``rows``: rid, id, y, vec (one length), anchor."""
        self.spark = rows.sparkSession
        rows = cut_lineage(rows)
        sample = (rows.filter("anchor").select("vec", F.xxhash64("rid").alias("h")).orderBy("h").limit(SAMPLE).collect())
        self.any = bool(sample)
        if not self.any:
            return
        vectors = np.array([r["vec"] for r in sample], np.float64)
        count = max(1, min(MAX_CENTRES, len(sample) // 32))
        self.centres = centres(vectors, count)
        placed = cut_lineage(self._placed(rows))
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)), F.count_if("anchor"), F.max("angle"), F.max("norm")).collect()
        self.cells = {r[0]: (max(1, -(-r[1] // BLOCK_ROWS)), max(1, -(-r[2] // CLUSTER_ROWS)), r[3], r[4]) for r in cells}
        pick = lambda k: F.create_map(*[F.lit(x) for c, s in self.cells.items() for x in (c, s[k])])[F.col("cell")]
        self.blocks = cut_lineage(_arrays(placed.withColumn("sub", F.pmod(F.xxhash64("rid"), pick(0)).cast("int")),
                                          ["cell", "sub"]))
        self.anchors = placed.filter("anchor").withColumn("part", F.pmod(F.xxhash64("rid"), pick(1)).cast("int"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()),
                               T.StructField("angle", T.DoubleType()), T.StructField("norm", T.DoubleType())])
        arrow, middle, vec = to_arrow_schema(schema), self.centres, rows.columns.index("vec")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                norm, units = _unit(batch.column(vec).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1))
                cosine = units @ middle.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle),
                                                  pa.array(norm)], schema=arrow)
        return rows.mapInArrow(run, schema)

    def _sent(self, clusters: DataFrame, own: bool) -> DataFrame:
        """Clusters by the blocks they are sent to: those of their own cell, or of others that can hold a result."""
        home = F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda s: F.struct(F.col("cell"), s.alias("sub")))
        if own:
            subs = F.create_map(*[F.lit(x) for c, s in self.cells.items() for x in (c, s[0])])
            sent = clusters.withColumn("most", subs[F.col("cell")]).withColumn("to", F.explode(home))
            return sent.select("to.cell", "to.sub", *[c for c in clusters.columns if c not in ("cell", "part")])
        from pyspark.sql.pandas.types import to_arrow_schema
        names = [f.name for f in _STREAM if f.name not in ("cell", "sub", "kind")]
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("most", T.IntegerType()),
                               *[_STREAM[c] for c in names]])
        arrow, middle, cells = to_arrow_schema(schema), self.centres, self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    v = _numpy(batch.column("vecs"), k, np.float64).reshape(batch.column("n")[k].as_py(), -1)
                    low, high, bar = (_numpy(batch.column(c), k).reshape(len(v), -1) for c in ("low", "high", "bar"))
                    size, units = _unit(v)
                    centre = _unit(units.sum(axis=0, keepdims=True))[1][0]
                    spread = _angles(units[size > 0], centre).max(initial=0.0)
                    open_ = np.where(low <= high, np.maximum(low, bar), FAR).min(axis=1, initial=FAR)
                    for cell, (subs, _, angle, norm) in cells.items():
                        apart = float(_angles(middle[cell:cell + 1], centre)[0]) - spread - angle
                        most = size * norm * (np.cos(max(apart, 0)) + _SLACK)
                        if cell != batch.column("cell")[k].as_py() and (most >= open_).any():
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([cell], pa.int32()), pa.array([subs], pa.int32()),
                                 *[batch.column(c).slice(k, 1) for c in names]], schema=arrow)
        sent = clusters.select("cell", *names).mapInArrow(run, schema)
        return sent.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))

    def search(self, bands: DataFrame, keep: int, same: bool) -> DataFrame:
        """(aid, arid, band, score, id, rid, rank): for each anchor's bands ``low`` and ``high`` the best rows.

        ``bands``: rid, low, high (arrays of one length).
        """
        asked = self.anchors.join(bands, "rid")
        wide = _arrays(asked.withColumn("bar", F.col("low")), ["cell", "part"], ("low", "high", "bar"))
        near = cut_lineage(_first(_meet(self._sent(wide, True), self.blocks, keep, same), keep))
        bars = near.filter(F.col("rank") == keep).groupBy("arid").agg(
            F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("worst"))
        raised = asked.join(bars, asked.rid == bars.arid, "left").withColumn(
            "bar", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("worst")[i], x))))
        wide = _arrays(raised, ["cell", "part"], ("low", "high", "bar"))
        far = _meet(self._sent(wide, False), self.blocks, keep, same)
        return cut_lineage(_first(near.drop("rank").unionByName(far), keep))


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "id", vec_col: str = "vec", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by integer inner products.

    ``vec_col`` is an array of whole numbers. An anchor's positives are the first ``positives`` other rows of its
    label, by falling score, ties by smaller id (null ids last, then any order). For each of them the first
    ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score are returned.
    Rows with a null label, a null vector or a null component take no part. Vectors of different lengths are filled
    with zeros; components beyond +-2^26 count as 2^26. Repeated rows are separate rows: each is an anchor and a
    candidate. An empty table, or one without anchors, gives no rows; extra columns, whatever their names, are
    ignored; the table holds no texts.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("y"),
                       F.col(vec_col).cast("array<long>").alias("vec"), anchor.alias("anchor"))
    data = data.filter("y is not null and vec is not null and not exists(vec, x -> x is null)")
    data = cut_lineage(data.withColumn("rid", F.monotonically_increasing_id()).withColumn(
        "anchor", F.coalesce("anchor", F.lit(False)) & F.col("id").isNotNull()))
    dims = data.agg(F.max(F.size("vec"))).first()[0] or 0
    cut = F.transform("vec", lambda x: F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    fill = F.array_repeat(F.lit(0), F.lit(max(dims, 1)) - F.size("vec"))
    index = Index(data.withColumn("vec", F.concat(cut, fill)))
    out = T.StructType([field(rows, id_col, "anchor_id"), field(rows, id_col, "positive_id"),
                        T.StructField("rank", T.IntegerType()), field(rows, id_col, "negative_id"),
                        T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
    if not index.any:
        return spark.createDataFrame([], out)
    anything = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("low", -FAR + 1), ("high", FAR))]
    near = index.search(index.anchors.select("rid", *anything), positives, True)
    # score s is allowed for a positive of score p if low * p <= 100 * s <= high * p
    least = F.ceil(F.col("score").cast("decimal(38,0)") * low / F.lit(100)).cast("long")
    most = F.floor(F.col("score").cast("decimal(38,0)") * high / F.lit(100)).cast("long")
    listed = near.groupBy("arid").agg(F.array_sort(F.collect_list(F.struct(
        "rank", least.alias("low"), most.alias("high")))).alias("_b"))
    bands = listed.select(F.col("arid").alias("rid"), F.col("_b.low").alias("low"), F.col("_b.high").alias("high"))
    width = F.lit(positives) - F.size("low")   # anchors with fewer positives: the other bands are empty
    bands = bands.select("rid", F.concat("low", F.array_repeat(F.lit(1).cast("long"), width)).alias("low"),
                         F.concat("high", F.array_repeat(F.lit(0).cast("long"), width)).alias("high"))
    far = index.search(bands, negatives, False)
    picked = near.select("arid", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    joined = far.join(picked, ["arid", "band"])
    return joined.select(F.col("aid").cast(out[0].dataType).alias("anchor_id"),
                         F.col("positive_id").cast(out[0].dataType).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                         F.col("id").cast(out[0].dataType).alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))


def scaled(rows: DataFrame, vec_col: str, factor: int = 256) -> Column:
    """The vector as whole numbers floor(factor * x); null if it holds a null or non-finite component."""
    real = F.col(vec_col).cast("array<double>")
    odd = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    bound = float(LIMIT)
    whole = F.transform(real, lambda x: F.floor(F.least(F.greatest(x * factor, F.lit(-bound)), F.lit(bound))).cast("long"))
    return F.when(~odd, whole)
