"""Packing of documents into fixed windows by lexical retrieval.

Documents are routed by content first. Of about ``SAMPLE`` documents, drawn by hash, up to ``LEADERS``
different ones are leaders, chained so that similar ones follow each other. Each document is encoded once
and gets the places of its three nearest leaders (BM25 weights, cosine); the token ids are range-partitioned
and sorted by those, then by row number, so a group of any size spreads over partitions. The sample only
decides who meets whom: retrieval sees every document of a shard, none of another.

Each task streams its rows in shards of at most ``shard_docs`` documents. A shard has its own BM25
inverted index over the token ids of its documents. A window starts with the longest unused document as
seed; the index returns the unused documents by falling score, and they are added until the window is
full. The last one is cut there and its rest stays in the pool. Documents longer than a window fill
windows of their own first. What is in a shard's last, partly filled window moves on to the next shard,
so only one window of a partition is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, pieces
from statfold.llm.tokens import encoder
from statfold.session import cut_lineage

WINDOW = 4096
SHARD_DOCS = 2048
SHARD_BYTES = 8 << 20
PART_TOKENS = 4 << 20   # of a partition of routed documents
SAMPLE, LEADERS = 1024, 256
SAMPLE_CHARS = 16_384   # of a sampled document that its leader profile is made of
K1, B = 1.2, 0.75


class Leaders:
    """Profiles of sampled documents; ``routes`` names a document's place among them."""

    def __init__(self, samples: list[np.ndarray], most: int = LEADERS):
        found = [np.unique(x, return_counts=True) for x in samples]
        size = 1 + max((int(t[-1]) for t, _ in found), default=0)
        df = np.bincount(np.concatenate([t for t, _ in found]) if found else np.empty(0, np.int64), minlength=size)
        self.idf = np.log1p((len(samples) - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, float(np.mean([len(x) for x in samples])) if samples else 1.0)
        found = found[:most]
        vocab = np.unique(np.concatenate([t for t, _ in found])) if found else np.empty(0, np.int64)
        self.row = np.full(size, -1, np.int32)
        self.row[vocab] = np.arange(len(vocab))
        profile = np.zeros((len(found), len(vocab)), np.float32)
        for k, (t, c) in enumerate(found):
            profile[k, self.row[t]] = self._weights(t, c, int(c.sum()))
        profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
        near = profile @ profile.T
        chain, left = [], np.ones(len(found), bool)
        while left.any():  # the most similar leader that is left comes next
            chain.append(int(np.argmax(np.where(left, near[chain[-1]], -1))) if chain else 0)
            left[chain[-1]] = False
        self.profile = np.ascontiguousarray(profile[chain].T)  # a term's weights lie together
        self.row_idf = self.idf[vocab]

    def _weights(self, terms: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        return self.idf[terms] * (counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))).astype(np.float32)

    def routes(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of documents with ``sizes`` ids each: places of the three nearest leaders, nearest first, as one number."""
        vocab = max(1, len(self.profile))
        row = np.append(self.row, -1)[np.minimum(ids, len(self.row))].astype(np.int64)
        key = np.sort((np.repeat(np.arange(len(sizes)) * vocab, sizes) + row)[row >= 0])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        doc, row = np.divmod(key[at], vocab)
        tf = np.diff(np.append(at, len(key))).astype(np.float32)
        norm = (K1 * (1 - B + B * sizes / self.mean)).astype(np.float32)
        weight = self.row_idf[row] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        near = np.zeros((len(sizes), self.profile.shape[1]), np.float32)
        ends = np.searchsorted(doc, np.arange(len(sizes) + 1))
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if b > a:
                near[k] = weight[a:b] @ self.profile[row[a:b]]
        out, every = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        for _ in range(min(3, near.shape[1])):
            k = near.argmax(axis=1)
            out = out << 16 | k
            near[every, k] = -1
        return out


class Pool:
    """Documents of one shard: ids, how far each is used, and the inverted index of what was left at first."""

    def __init__(self, docs: list[tuple[int, np.ndarray, int]]):
        self.docs = docs  # (row number, ids, first unused token)
        self.start = np.array([s for _, _, s in docs], np.int64)
        self.left = np.array([len(x) - s for _, x, s in docs], np.int64)
        n = len(docs)
        # one sort of (term, document): its runs are the postings, term by term
        owner = np.repeat(np.arange(n), self.left)
        key = np.concatenate([x[s:] for _, x, s in docs]).astype(np.int64) if n else np.empty(0, np.int64)
        key = np.sort(key * max(1, n) + owner)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        flat, self.post_doc = np.divmod(key[at], max(1, n))
        tf = np.diff(np.append(at, len(key))).astype(np.float64)
        self.first = np.append(np.flatnonzero(np.diff(flat, prepend=-1)), len(flat))
        self.vocab = flat[self.first[:-1]]
        df = np.diff(self.first)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * self.left / max(1.0, float(self.left.mean()) if n else 1.0))
        self.post_w = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.post_doc])

    def scores(self, k: int) -> np.ndarray:
        _, ids, start = self.docs[k]
        at = np.searchsorted(self.vocab, np.unique(ids[start:]))
        runs = [slice(a, b) for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist())]
        if not runs:
            return np.zeros(len(self.docs))
        return np.bincount(np.concatenate([self.post_doc[r] for r in runs]),
                           np.concatenate([self.post_w[r] for r in runs]), minlength=len(self.docs))


def _fill(pool: Pool, window: int, emit, last: bool) -> list[tuple[int, np.ndarray, int]]:
    """Fill windows from the pool; returns what was left over for the next shard (nothing if ``last``)."""
    left, start = pool.left, pool.start
    for k in np.flatnonzero(left >= window):  # whole windows of one document
        while left[k] >= window:
            emit([(int(k), int(start[k]), window)])
            start[k] += window
            left[k] -= window
    while True:
        if not last and int(left.sum()) < window:
            return [(r, x, int(s)) for (r, x, _), s, n in zip(pool.docs, start, left) if n]
        seed = int(np.argmax(left))
        if not left[seed]:
            return []
        placed, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        start[seed] += left[seed]
        left[seed] = 0
        if room:
            score = np.where(left > 0, pool.scores(seed), -1.0)
            # enough best neighbours to fill the window: scores first, then order of the rows
            order = np.argsort(-score, kind="stable")
            for k in order:
                if not room or not left[k]:
                    break
                n = min(room, int(left[k]))
                placed.append((int(k), int(start[k]), n))
                start[k] += n
                left[k] -= n
                room -= n
        emit(placed)


def _router(tokenizer: str, end_id: int, shared, schema: pa.Schema):
    """Token ids of (id, text, row), as 2 or 4 bytes each, and the route by which documents meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, leaders = encoder(tokenizer), shared.value
        for batch in pieces(batches, 1, 2 << 20):
            flat, sizes = enc.batch(batch.column(1).cast(pa.string()))
            flat = np.insert(flat, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            each = np.split(flat, np.cumsum(sizes)[:-1])
            wide = [bool(x.max() > 0xFFFF) for x in each]
            packed = [x.tobytes() if w else x.astype(np.uint16).tobytes() for x, w in zip(each, wide)]
            size, route = pa.array(sizes), pa.array(leaders.routes(flat, sizes))
            cols = [batch.column(0), pa.array(packed, pa.binary()), pa.array(wide), size, route,
                    batch.column(2)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def _leaders(rows: DataFrame, tokenizer: str) -> Leaders:
    """Leaders of a table of (id, text): about ``SAMPLE`` rows chosen by hash, equal texts once."""
    step = max(1, rows.count() // SAMPLE)
    place = F.xxhash64(*rows.columns)
    chosen = rows.select(place.alias("place"), F.substring("_text", 1, SAMPLE_CHARS).alias("start")).filter(
        F.pmod("place", F.lit(step)) == 0)
    texts = {x.start for x in chosen.orderBy("place", "start").limit(4 * SAMPLE).collect()}
    enc = encoder(tokenizer)
    # ordered by a hash, so the first of them are no special ones
    return Leaders([np.frombuffer(enc.packed(x), np.uint32) for x in
                    sorted(texts, key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x)) if x.strip()])


def _packer(window: int, shard_docs: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        keys: dict[int, object] = {}
        carried: list[tuple[int, np.ndarray, int]] = []
        rows: list[tuple[int, np.ndarray, int]] = []
        size = row = seq = 0

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carried, rows, size, seq
            if not carried and not rows:  # a partition without rows, or nothing left over
                return
            pool = Pool(carried + rows)
            out: list[tuple] = []

            def emit(placed) -> None:
                nonlocal seq
                at = 0
                for k, s, n in placed:
                    r, x, _ = pool.docs[k]
                    cut = x[s:s + n]
                    out.append((keys[r], s, n, zlib.crc32(cut.tobytes()), len(x), part + seq, at,
                                cut.astype(np.int64) if with_ids else None))
                    at += n
                seq += 1

            carried = _fill(pool, window, emit, last)
            rows, size = [], 0
            for gone in keys.keys() - {r for r, _, _ in carried}:
                del keys[gone]
            if out:
                cols = list(zip(*out))[:len(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in pieces(batches, 1, 2 << 20):
            for key, data, wide in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                ids = np.frombuffer(data, np.uint32 if wide else np.uint16).astype(np.uint32)
                keys[row] = key
                rows.append((row, ids, 0))
                row += 1
                size += ids.nbytes
                if len(rows) >= shard_docs or size >= SHARD_BYTES:
                    yield from shard(False)
        yield from shard(True)
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = 2, shard_docs: int = SHARD_DOCS, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``window`` tokens.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``)
    the ids. A document is its token ids and ``end_id``; null and empty texts are that one token. Each
    sequence but the last of a partition of about ``PART_TOKENS`` routed tokens is full. Null ids, repeated
    rows and extra columns are ordinary; an empty table gives no pieces. Sequence ids count up in each partition.
    """
    kinds = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
             ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    if with_ids:
        kinds.append(("ids", T.ArrayType(T.LongType())))
    schema = T.StructType([field(docs, id_col, id_col), *[T.StructField(a, b) for a, b in kinds]])
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    routed = T.StructType([field(docs, id_col, "_id"), T.StructField("ids", T.BinaryType()),
                           T.StructField("wide", T.BooleanType()), T.StructField("size", T.LongType()),
                           T.StructField("route", T.LongType()), T.StructField("row", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(_leaders(rows, tokenizer))
    done = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id())
                       .mapInArrow(_router(tokenizer, end_id, shared, to_arrow_schema(routed)), routed))
    parts = max(1, -(-(done.agg(F.sum("size")).first()[0] or 0) // PART_TOKENS))
    return (done.repartitionByRange(parts, "route", "row").sortWithinPartitions("route", "row")
            .select("_id", "ids", "wide").mapInArrow(_packer(window, shard_docs, with_ids, to_arrow_schema(schema)), schema))
