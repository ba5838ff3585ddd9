"""Language identification by nearest centroid.

A text is the TF-IDF vector of its byte n-grams (letters only, lower case, hashed to ``DIMS`` places),
normalised to length one. Each language is described by a few centroids (spherical k-means of all its texts);
a text gets the language of the centroid with the largest cosine, and is rejected if that is no nearer than
n-grams drawn by chance would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, has_letter, pieces
from statfold.session import scratch_path

DIMS = 4096
CENTROIDS = 3
ROUNDS = 12             # passes of k-means at most
UNIT = 1 << 24          # vectors are added up as multiples of 1 / UNIT
MAX_LANGS = 500         # more label values than this are refused
REJECT_DEVIATIONS = 4   # a text must be nearer than chance by this many standard deviations
UNDECIDED = "und"

_KEEP = np.full(256, 32, np.uint8)
for _c in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
    _KEEP[_c] = _c


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the hashed 2- and 3-grams of the text's letters, words padded by one blank."""
    raw = _KEEP[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # runs of anything but letters are one blank
    raw = raw[keep]
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    tri = ((a * np.uint32(65_599) + b) * np.uint32(65_599) + c) * np.uint32(2_654_435_761)
    two = (raw[:-1] * np.uint32(257) + raw[1:]) * np.uint32(2_246_822_519)
    ok = b != 32  # a blank in the middle says nothing
    counts = np.bincount(np.concatenate([tri[ok] >> np.uint32(20), two >> np.uint32(20)]), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


@dataclass
class Model:
    langs: list[str]       # language of each centroid
    centroids: np.ndarray  # a row each, length one
    idf: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid with the largest cosine, that cosine, whether it is no better than chance) of each text.

        The same weights on places drawn at random would have a cosine with the centroid whose mean is the
        centroid's mean times the weights' sum, and whose deviation is the centroid's (weights of length one).
        """
        best, top, far = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean, spread = self.centroids.mean(axis=1), self.centroids.std(axis=1)
        for i, text in enumerate(texts if self.langs else []):
            at, n = ngram_counts(text)
            w = (1 + np.log(n)) * self.idf[at]
            size = np.sqrt((w * w).sum())
            if size > 0:
                w = w / size
                cosine = self.centroids[:, at] @ w
                best[i] = j = int(cosine.argmax())
                top[i] = cosine[j]
                far[i] = cosine[j] < mean[j] * w.sum() + REJECT_DEVIATIONS * spread[j]
        return best, top, far


def _parts_of(train: DataFrame, lang_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (lang, part, at, n): the n-gram counts of every labelled text with a letter, written once.

    ``part`` (0 to ``k - 1``) is drawn from the text. ``at`` holds the places as 16-bit and ``n`` the counts as 32-bit
    numbers.
    """
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(k)).cast("int").alias("part"),
        F.col(text_col).alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 4 << 20):
            got = [ngram_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.string()), batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _ in got], pa.binary()),
                pa.array([n.astype(np.uint32).tobytes() for _, n in got], pa.binary())], names=["lang", "part", "at", "n"])
    path = scratch_path(train.sparkSession, "ngrams")
    counted = rows.mapInArrow(counts, "lang string, part int, at binary, n binary").filter(F.length("at") > 0)
    counted.write.option("compression", "zstd").parquet(path)
    return train.sparkSession.read.parquet(path)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, counts, first entry of each row) of a batch of ``_parts_of``, rows one after another."""
    at, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("at", np.uint16), ("n", np.uint32)))
    sizes = pc.binary_length(batch.column("at")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return at.astype(np.int64), n, np.cumsum(sizes) - sizes


def _summed(rows: DataFrame, body) -> dict[int, tuple[int, np.ndarray]]:
    """{key: (rows, sum of vectors)}: ``body`` gives (key, rows, vector of whole numbers) for each batch.

    Tasks add up their own rows, then Spark the tasks' sums key by key. Whole numbers add up alike in any order.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in pieces(batches, 2, 4 << 20):
            for key, count, vector in body(batch):
                held = own.setdefault(int(key), [0, np.zeros(DIMS, np.int64)])
                held[0] += int(count)
                held[1] += vector
        for key, (count, vector) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([count], pa.int64()),
                                              pa.array([vector.tobytes()], pa.binary())], names=["key", "n", "v"])

    def total(table: pa.Table) -> pa.Table:
        vector = np.zeros(DIMS, np.int64)
        for v in table.column("v"):
            vector += np.frombuffer(v.as_py(), np.int64)
        return pa.table({"key": table.column("key").slice(0, 1), "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()),
                         "v": pa.array([vector.tobytes()], pa.binary())})
    schema = "key int, n long, v binary"
    got = rows.mapInArrow(local, schema).groupBy("key").applyInArrow(total, schema).collect()
    return {r.key: (r.n, np.frombuffer(bytes(r.v), np.int64)) for r in got}


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", k: int = CENTROIDS,
        rounds: int = ROUNDS) -> Model:
    """Weights and centroids from every row with a language and a letter; no row is left out or counted twice.

    A place's weight comes from its share of each language's texts, averaged over the languages, so that a language
    with most of the rows does not set it alone. Spherical k-means runs within each language: the first centres are the
    means of ``k`` parts drawn by the text, then each round is one pass in which Spark adds up the rows nearest to each
    centre, until nothing changes. Only a vector a centre reaches the driver. Vectors are added as multiples of
    ``1 / UNIT``, so the result does not depend on how the rows are split.
    """
    spark = train.sparkSession
    rows = _parts_of(train, lang_col, text_col, k)
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS))
    number = spark.sparkContext.broadcast({lang: i for i, lang in enumerate(langs)})

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([number.value[x] for x in batch.column("lang").to_pylist()], np.int64)

    def added(key: np.ndarray, at: np.ndarray, weights: np.ndarray | None, starts: np.ndarray):
        """(key, rows, summed vector) of each key of the rows."""
        names, own, count = np.unique(key, return_inverse=True, return_counts=True)
        row = np.repeat(own, np.diff(np.append(starts, len(at))))
        total = np.bincount(row * DIMS + at, weights=weights, minlength=len(names) * DIMS).reshape(-1, DIMS)
        return zip(names, count, total.astype(np.int64))

    def texts_with(batch: pa.RecordBatch):
        at, _, starts = _flat(batch)
        return added(numbered(batch), at, None, starts)
    seen = _summed(rows, texts_with)
    total = sum(n for n, _ in seen.values())
    share = np.mean([v / n for n, v in (seen[i] for i in range(len(langs)))], axis=0)
    idf = np.log((1 + total) / (1 + total * share)) + 1

    def weighted(batch: pa.RecordBatch):
        at, n, starts = _flat(batch)
        w = (1 + np.log(n)) * idf[at]
        size = np.sqrt(np.add.reduceat(w * w, starts))
        return at, w / np.repeat(size, np.diff(np.append(starts, len(at)))), starts

    def first_parts(batch: pa.RecordBatch):
        at, w, starts = weighted(batch)
        part = batch.column("part").to_numpy(zero_copy_only=False)
        return added(numbered(batch) * k + part, at, np.rint(w * UNIT), starts)
    sums = _summed(rows, first_parts)
    owner = np.array([key // k for key in sorted(sums)], np.int64)   # language of each centre
    centres = _unit(np.stack([sums[key][1] for key in sorted(sums)]).astype(np.float64))
    begin = np.searchsorted(owner, np.arange(len(langs)))
    many = np.bincount(owner, minlength=len(langs))
    before: dict = {}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def nearest(batch: pa.RecordBatch):
            at, w, starts = weighted(batch)
            lang, sizes = numbered(batch), np.diff(np.append(starts, len(at)))
            best, near = np.full(len(lang), -np.inf), np.zeros(len(lang), np.int64)
            for j in range(k):
                to = np.minimum(begin[lang] + j, len(owner) - 1)
                cosine = np.add.reduceat(shared.value[np.repeat(to, sizes), at] * w, starts)
                closer = (j < many[lang]) & (cosine > best)
                best[closer], near[closer] = cosine[closer], to[closer]
            return added(near, at, np.rint(w * UNIT), starts)
        sums = _summed(rows, nearest)
        moved = any(key not in before or not np.array_equal(before[key][1], sums[key][1]) for key in sums)
        if not moved and len(before) == len(sums):
            break
        centres = centres.copy()   # a centre that lost all its rows stays
        for key, (_, v) in sums.items():
            centres[key] = _unit(v.astype(np.float64))
        before = sums
    return Model([langs[i] for i in owner], centres, idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, rejected), one per input row.

    ``lang_pred`` is the nearest centroid's language and ``score`` its cosine, cut to 0..1; texts that are
    null or have no letter get ``und`` and 0, as does everything under a model without languages. Ties go
    to the alphabetically first language. ``rejected`` marks ``und`` and texts that are no nearer than chance.
    Only the text is looked at; extra columns are ignored.
    """
    schema = T.StructType([field(docs, id_col, id_col), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGS * CENTROIDS rows of DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, 1, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            told = np.array([bool(m.langs) and has_letter(t) for t in texts], bool)
            best, score, far = m.nearest(texts)
            pred = [m.langs[j] if ok else UNDECIDED for j, ok in zip(best, told)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), pa.array(pred, pa.string()),
                 pa.array(np.where(told, np.clip(score, 0, 1), 0.0)), pa.array(~told | far)], schema=arrow)
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of documents that the model of op3 may not learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_unknown(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those that ``identify`` rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, at, 4 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            far = m.nearest(texts)[2] if m.langs else np.zeros(len(texts), bool)
            keep = pa.array([has_letter(t) and not x for t, x in zip(texts, far)], pa.bool_())
            left = batch.filter(keep)
            if left.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(left.columns, arrow)], schema=arrow)
    return docs.mapInArrow(run, docs.schema)
