"""Benchmark decontamination: BM25 over the test items with block-max pruning, then an overlap check.

The test items are indexed once: for each item the BM25 weight of each of its terms, scaled so that an
item scores ``1`` against a passage that holds ``recall`` of its own score. Items are sorted into blocks,
and each term has its largest weight in every block. Every training document is read as overlapping
passages; every passage is a query. A passage whose terms cannot reach the threshold in any block is
skipped, then blocks that cannot, and only the items of the rest are scored: all above the threshold are
retrieved, none is cut. This is not block-max WAND (no pivots over posting cursors): the maxima of a passage's
terms are summed for every block. The share of the item's word shingles that the passage holds decides a retrieved
pair; the shares of its question and of its answer (its last sentence) are told beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, pieces
from statfold.session import cut_lineage

SHINGLE, OVERLAP = 5, 0.8
BLOCK = 16              # items in a block of the index
INDEX_BYTES = 16 << 20  # items are broadcast in parts of at most this much text
INDEX_ITEMS = 20_000
CELLS = 1 << 21         # passages x blocks whose maxima are summed at once
K1, B = 1.2, 0.75

_END = re.compile(r"(?<=[.!?])\s+")
_MARKS = r"[^\p{L}\p{N}_]+"


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-case words (letters, digits, underscore) of every text."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(
        pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, " ")))


def words(text: str) -> list[str]:
    return [w for w in word_lists(pa.array([text], pa.string()))[0].as_py() if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer: the last sentence, or the last quarter of the only one."""
    parts = [p for p in ([w for w in x if w] for x in word_lists(pa.array(_END.split(text), pa.string())).to_pylist())
             if p]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = len(parts[0]) - max(1, len(parts[0]) // 4)
        return parts[0][:cut], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(ws: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Different ``n``-word shingles; of fewer words, all of them as one."""
    return {tuple(ws[k:k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def overlaps(passage: list[str], item: list[str], question: list[str], answer: list[str]):
    """(similarity, question, answer) shares of the item's shingles that the passage holds; None if similarity is too low."""
    share = []
    for part in (item, question, answer):
        own = shingles(part)
        held = shingles(passage, min(SHINGLE, len(part))) if part else set()
        share.append(len(own & held) / len(own) if own else 1.0)
        if share[0] < OVERLAP:
            return None
    return tuple(share)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first[k]``, ``first[k] + 1``, ... of every run, one run after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """BM25 weights of a part of the items, and what verifies them.

    Postings lie by term, then item. Those of one term and block of items are an entry, which knows its largest
    weight; only entries that have postings exist, so the index grows with the items' text and nothing else.
    """

    def __init__(self, items: list[tuple[object, str]]):
        lists = word_lists(pa.array([t for _, t in items], pa.string()))
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        flat, owner = flat.filter(pa.array(real)).dictionary_encode(), owner[real]
        length = np.bincount(owner, minlength=len(items))
        order = np.flatnonzero(length)[np.argsort(length[length > 0], kind="stable")]
        self.keys, self.texts = [items[k][0] for k in order], [items[k][1] for k in order]
        self.parts: dict[int, tuple] = {}
        n, length, self.vocab = len(order), length[order], flat.dictionary
        self.items, self.blocks = n, -(-n // BLOCK)
        self.half = int(length.max(initial=1))  # passages of twice as many words start every half
        place = np.zeros(len(items), np.int64)
        place[order] = np.arange(n)
        key, count = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, n) + place[owner],
                               return_counts=True)
        term, self.post_item = np.divmod(key, max(1, n))
        df = np.bincount(term, minlength=len(self.vocab))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, float(length.mean()) if n else 1.0))
        w = idf[term] * count * (K1 + 1) / (count + norm[self.post_item])
        # a passage that holds OVERLAP of the shingles lacks at most as many terms as it may lack shingles
        own = lists.take(pa.array(order)).to_pylist()
        lacking = np.array([int((1 - OVERLAP) * len(shingles([w for w in t if w])) + 1e-9) for t in own], np.int64)
        heavy = np.lexsort((-w, self.post_item))
        rank = np.empty(len(w), np.int64)
        size = np.bincount(self.post_item, minlength=n)
        rank[heavy] = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        total = np.bincount(self.post_item, w, minlength=n)
        lost = np.bincount(self.post_item, np.where(rank < lacking[self.post_item], w, 0), minlength=n)
        self.post_w = w / np.maximum(total - lost, 1e-3 * total)[self.post_item]
        cell = term * max(1, self.blocks) + self.post_item // BLOCK
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.entry_post = np.append(start, len(w))
        self.entry_block = cell[start] % max(1, self.blocks)
        self.entry_max = np.maximum.reduceat(self.post_w, start) if n else np.empty(0)
        self.term_entry = np.searchsorted(term[start], np.arange(len(self.vocab) + 1))
        self.top = np.maximum.reduceat(self.entry_max, self.term_entry[:-1]) if n else np.empty(0)

    def check(self, item: int) -> tuple[list[str], list[str], list[str]]:
        """Words of an item, of its question and of its answer."""
        if item not in self.parts:
            self.parts[item] = (words(self.texts[item]), *question_answer(self.texts[item]))
        return self.parts[item]

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that reach the threshold; the input pairs are distinct and sorted."""
        out_w, out_i = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if window.size and self.blocks:
            first = np.flatnonzero(np.diff(window, prepend=window[0] - 1))
            size = np.diff(np.append(first, len(window)))
            able = np.add.reduceat(self.top[term], first) >= 1 - 1e-4
            first, size = first[able], size[able]
            step = max(1, CELLS // self.blocks)
            for lo in range(0, len(first), step):
                at, of = first[lo:lo + step], size[lo:lo + step]
                slot, item = self._above(term[_spread(at, of)], np.repeat(np.arange(len(at)), of), len(at))
                out_w.append(window[at[slot]])
                out_i.append(item)
        return np.concatenate(out_w), np.concatenate(out_i)

    def _above(self, term: np.ndarray, slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, item) that reach the threshold, items being scored in blocks whose maxima can reach it only."""
        size = self.term_entry[term + 1] - self.term_entry[term]
        entry, slot = _spread(self.term_entry[term], size), np.repeat(slot, size)
        cell = slot * self.blocks + self.entry_block[entry]
        live = (np.bincount(cell, self.entry_max[entry], minlength=slots * self.blocks) >= 1 - 1e-4)[cell]
        entry, slot = entry[live], slot[live]
        size = self.entry_post[entry + 1] - self.entry_post[entry]
        post = _spread(self.entry_post[entry], size)
        pair, back = np.unique(np.repeat(slot, size) * self.items + self.post_item[post], return_inverse=True)
        found = pair[np.bincount(back, self.post_w[post], minlength=len(pair)) >= 1 - 1e-6]
        return np.divmod(found, max(1, self.items))


def _search(index: Index, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Of whole texts the (row, item) pairs retrieved and verified, with their largest overlaps."""
    parts = word_lists(texts)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index_in(parts.flatten(), value_set=index.vocab)
    term = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = term >= 0
    term, row, cell = term[hit], row[hit], inside[hit] // index.half
    # window j holds cells j - 1 and j: an item's words lie whole within one of them
    per, vocab = int(counts.max(initial=0)) // index.half + 2, max(1, len(index.vocab))
    own = (row * per + cell) * vocab + term
    both = np.unique(np.concatenate([own, own + vocab]))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for window, item in zip(*index.retrieve(both // vocab, both % vocab)):
        r, j = divmod(int(window), per)
        passage = parts[r].as_py()[max(0, j - 1) * index.half:(j + 1) * index.half]
        got = overlaps(passage, *index.check(int(item)))
        if got and got > found.get((r, int(item)), (0,)):
            found[r, int(item)] = got
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, item, similarity, question_overlap, answer_overlap): every document and the items it leaks.

    ``similarity`` is the share of the item's different 5-word shingles (all its words, if it has fewer)
    found in one passage of the document, at least 0.8; of several passages the best counts, of equal ones that
    with the larger shares. The shares of its question and its answer in that passage only tell where the copy
    differs. Items and documents without a word match nothing (null counts as empty); repeated rows give repeated
    results; extra columns are ignored; an empty table on either side gives no rows. The items are indexed in
    parts of at most ``INDEX_BYTES`` of text and ``INDEX_ITEMS`` rows; an index takes a few times its text.
    """
    spark = docs.sparkSession
    schema = T.StructType([field(docs, id_col, "doc"), T.StructField("row", T.LongType()),
                           T.StructField("similarity", T.DoubleType()),
                           T.StructField("question_overlap", T.DoubleType()),
                           T.StructField("answer_overlap", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    items = cut_lineage(benchmark.select(F.col(item_col).alias("item"), F.coalesce(item_text, F.lit("")).alias("text"))
                        .withColumn("row", F.monotonically_increasing_id()))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in pieces(batches, 1, 4 << 20):
                found = [(r, index.keys[item], *share) for (r, item), share
                         in sorted(_search(index, batch.column(1).cast(pa.string())).items())]
                if found:
                    at, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)).cast(arrow.field(0).type),
                         *[pa.array(x, arrow.field(k + 1).type) for k, x in enumerate(rest)]], schema=arrow)
        return run

    out = None
    for part in _parts(items):
        shared = spark.sparkContext.broadcast(Index(part))
        got = rows.mapInArrow(scan(shared), schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    return (out.join(items.select("row", "item"), "row")
            .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "similarity", "question_overlap",
                    "answer_overlap"))


def _parts(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded bytes and number, so each index has a proven size."""
    part, size = [], 0
    for x in items.select("row", "text").toLocalIterator():
        if part and (size + len(x.text) > INDEX_BYTES or len(part) >= INDEX_ITEMS):
            yield part
            part, size = [], 0
        part.append((x.row, x.text))
        size += len(x.text)
    if part:
        yield part


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The input's rows and columns without documents that hold a test item (as ``contaminated`` finds them)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, at = to_arrow_schema(docs.schema), docs.columns.index(text_col)
    items = benchmark.select(F.col(item_col).alias("row"), F.coalesce(item_text, F.lit("")).alias("text"))

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in pieces(batches, at, 4 << 20):
                texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
                bad = {r for r, _ in _search(index, texts)}
                left = batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))
                if left.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(left.columns, arrow)], schema=arrow)
        return run

    for part in _parts(items):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(Index(part))), docs.schema)
    return docs
