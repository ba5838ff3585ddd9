"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets a row of Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle
inequality two fingerprints within ``max_bits`` differ by at most that much in every coordinate, so a pair
with a larger difference in any coordinate is discarded; the survivors are verified on the fingerprints.
So that no pair of far fingerprints is formed at all, pairs are looked for among fingerprints that agree in
some choice of bit blocks: 64 bits in ``b`` blocks and at most ``max_bits`` differing bits leave at least
``b - max_bits`` blocks equal. ``b`` grows with the counted number of fingerprints, so the groups stay small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, pieces, union_find_labels
from statfold.session import broadcast_if_small, cut_lineage

SHINGLE, MAX_BITS, SEED = 4, 4, 42
PIVOTS = 64
GROUP_ROWS = 16_384   # larger groups are compared in pairs of blocks
MEAN_GROUP = 64       # expected fingerprints in a group
_PAIRS = 1 << 20


def _fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1:] - 1).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k:k + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp, key): the 64-bit fingerprint as a signed long, and a key that tells texts of one id apart."""
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("fp", T.LongType()),
                           T.StructField("key", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            fps = [_fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(fps, pa.int64()),
                                              batch.column(2)], schema=arrow)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_key(F.col(text_col))
                       .alias("key")).mapInArrow(run, schema)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(count)], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference, one byte each."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs], axis=1).astype(np.int8)


def _close(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int):
    """Of the pairs a-b those within ``most`` bits: coordinates first, then the fingerprints."""
    for lo in range(0, table.shape[1], 16):
        if not a.size:
            break
        keep = np.abs(table[a, lo:lo + 16] - table[b, lo:lo + 16]).max(axis=1) <= most
        a, b = a[keep], b[keep]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= most
    return a[near], b[near]


def _linked(most: int, schema: pa.Schema):
    """Spanning links of each group of a sorted stream of (group, fp) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        rest_g, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            n = len(f)
            table, labels = pivot_table(f, refs), np.arange(n, dtype=np.int64)
            last = np.searchsorted(g, g, side="right")  # each row meets the later rows of its group
            todo, step = np.arange(n), 1
            todo = todo[todo + step < last]
            held, held_n = [], 0
            while todo.size or held_n:
                if todo.size:
                    held.append((todo, todo + step))
                    held_n += todo.size
                    step += 1
                    todo = todo[todo + step < last[todo]]
                if held_n >= _PAIRS or not todo.size:
                    a, b = (np.concatenate(x) for x in zip(*held))
                    apart = labels[a] != labels[b]  # what is joined already needs no comparison
                    a, b = a[apart], b[apart]
                    labels = union_find_labels(n, *_close(f, table, a, b, most), labels=labels)
                    held, held_n = [], 0
            own = np.flatnonzero(labels != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(f[own].view(np.int64)),
                                               pa.array(f[labels[own]].view(np.int64))], schema=schema)

        for batch in batches:
            g = np.concatenate([rest_g, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(g, g[-1], side="left")) if len(g) else 0
            if cut:
                yield links(g[:cut], f[:cut])
            rest_g, rest_f = g[cut:], f[cut:]
        if len(rest_g):
            yield links(rest_g, rest_f)
    return run


def block_masks(count: int, most: int) -> list[int]:
    """Bit masks of which at least one is equal for any two fingerprints within ``most`` bits."""
    blocks = most + 1
    while blocks < 10:
        bits = 64 * (blocks - most) // blocks
        if count <= MEAN_GROUP << bits:
            break
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(parts, blocks - most)]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) of the graph in which distinct fingerprints ``fp`` within ``max_bits`` are joined."""
    spark = fps.sparkSession
    masks = block_masks(fps.count(), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).cast("long").alias("m"))
                                for k, m in enumerate(signed)])).alias("x")
    rows = fps.select("fp", table).select("fp", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("g"))
    large = rows.groupBy("g").count().filter(F.col("count") > GROUP_ROWS)
    large = cut_lineage(large)
    if large.limit(1).count():
        parts = F.ceil(F.col("count") * 2 / GROUP_ROWS).cast("int")
        big = (rows.join(broadcast_if_small(large), "g")
               .withColumn("n", parts).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("n")).cast("int"))
               .select("fp", "g", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
               .select("fp", F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g")))
        rows = rows.join(broadcast_if_small(large.select("g")), "g", "left_anti").select("fp", "g").unionByName(big)
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = rows.select("g", "fp").repartition(n, "g").sortWithinPartitions("g", "fp")
    return spread.mapInArrow(_linked(max_bits, to_arrow_schema(schema)), schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the smallest vertex reachable along ``edges`` (u, v), by alternating stars."""
    now = cut_lineage(edges.filter("u <> v"))
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = cut_lineage(small)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == mark:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        mark = tuple(after)


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, least): the component of each different fingerprint and its smallest id."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits))
    return cut_lineage(distinct.join(roots, distinct.fp == roots.vertex, "left")
                       .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of
    at most ``max_bits`` differing bits (itself included). Null and blank texts have fingerprint zero and
    are linked like any other; a null id is never the smallest unless its whole component has none.
    Repeated rows give repeated results; extra columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    placed = _rooted(prints, max_bits)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return (prints.join(by_fp, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """The input's rows and columns with one document of each component: the one with the smallest id.

    A null id comes after all others; rows equal in id and text are one document and stay or go together.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    rows = prints.join(_rooted(prints, max_bits).select("fp", "root"), "fp")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "key")
    least = rows.groupBy("root").agg(F.min(order).alias("least"))
    gone = rows.join(least, "root").filter(order != F.col("least")).select(
        F.col("id").alias("_gone"), F.col("key").alias("_key")).distinct()
    gone = broadcast_if_small(cut_lineage(gone))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (_text_key(docs[text_col]) == gone["_key"]),
                     "left_anti")
