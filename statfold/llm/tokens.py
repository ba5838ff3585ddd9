"""Token ids and counts of whole texts with public tokenizers.

``count_tokens`` gives the library's count per document. Documents longer than ``chunk_chars`` are cut
into overlapping chunks that are encoded separately, with offsets; neighbouring chunks are spliced at a
boundary both encodings agree on and that is proven stable (see ``Encoder.stable``), and where a pair of
chunks has none its overlap is widened until there is one or it covers the whole document.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import cut_pieces, field, pieces
from statfold.session import cut_lineage

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
CACHE_WORDS = 120_000  # entries in each of two generations: under 100 MB a worker
_END = "</w>"
AGREE = 2  # tokens on either side of a splice that must be the same in both encodings

# words of these characters alone are normalised by lower-casing; others are left to the library
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
# the tokenizer's split pattern on such words, lower-cased, one a line
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|\n|[^ \t\n\r\x0b\x0c0-9a-zß-öø-ÿ]+")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class Cache:
    """Two generations of at most ``size`` entries each: what is used stays, memory is bounded."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """One tokenizer file: ``.json`` by the tokenizers library, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            self.kind, self.tok = "json", Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
            splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
            # white space is dropped and no piece crosses it: words can be encoded one by one
            self.by_word = _ordered(spec["model"]) and (steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("type") == "Split"
                            and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
                            and r"\s" in json.dumps(splits[0]["pattern"]) and len(splits) == 2
                            and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space"))
            if self.by_word:
                self._rank(spec["model"]["vocab"])
        else:
            import sentencepiece
            self.kind, self.tok = "model", sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_word = False
        self.words = Cache(CACHE_WORDS)

    def _rank(self, vocab: dict[str, int]) -> None:
        """The same merges as ranks of byte strings, a word's end being a blank.

        A token is merged from its own bytes in one way, whatever stands around it, so taking the pair with the
        smallest id is taking the first of the merges, which stand in the order of the ids they give.
        """
        import tiktoken
        back = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(map(back.__getitem__, t.removesuffix(_END))) + b" " * t.endswith(_END): i
                 for t, i in vocab.items() if not t.startswith("<|")}
        self.ranks = tiktoken.Encoding("word ends", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n "]

    def ids(self, text: str) -> list[int]:
        if self.kind == "json":
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.tok.encode(text, num_threads=1)

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Token ids and the character each starts at."""
        if self.kind == "json":
            enc = self.tok.encode(text, add_special_tokens=False)
            return enc.ids, [a for a, _ in enc.offsets]
        found = self.tok.encode(text, return_type="proto").pieces
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)  # its places are bytes
        chars = np.cumsum((raw & 0xC0) != 0x80)
        return [p.id for p in found], [int(chars[p.begin]) - 1 if p.begin < len(raw) else len(text) for p in found]

    def stable(self, text: str, at: int) -> bool:
        """True if no token of any longer text can cross ``at``, whatever stands on either side.

        Words follow single white space there and the piece before is a letter, digit or mark of ASCII, so
        neither normalisation nor the split pattern joins the two sides. For tokenizers that keep the
        space at a word's front the boundary is before the space, else after it.
        """
        if self.kind == "json" and self.by_word:
            return 0 < at < len(text) and text[at - 1] in " \n\t\r" and text[at] not in " \n\t\r"
        return 1 < at < len(text) - 1 and text[at] == " " and _hard(text[at - 1]) and _hard(text[at + 1])

    def _plain_ids(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters, one a line, one after another, and how many each has."""
        ids = np.array(self.ranks.encode_ordinary(" ".join(_PIECE.findall(lines.lower())) + " "), np.uint32)
        marks = ids == self.line  # a line's end is a piece of its own and one token
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, one after another, and how many each has."""
        if not len(words):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() + "\n"
        if "<|" not in lines and _PLAIN.fullmatch(lines):
            return self._plain_ids(lines)
        words = lines.split("\n")[:-1]
        plain = [k for k, w in enumerate(words) if "<|" not in w and _PLAIN.fullmatch(w)]
        parts: list = [None] * len(words)
        if plain:
            ids, counts = self._plain_ids("\n".join(words[k] for k in plain) + "\n")
            for k, part in zip(plain, np.split(ids, np.cumsum(counts)[:-1])):
                parts[k] = part
        for k, w in enumerate(words):
            if parts[k] is None:
                parts[k] = self.words.get(w)
                if parts[k] is None:
                    parts[k] = np.array(self.ids(w), np.uint32)
                    self.words.put(w, parts[k])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _lookup(self, texts: pa.Array):
        """Of texts: the number of words of each, the place of each word among the different ones, and those' ids."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        return (pc.list_value_length(split).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False),
                *self._words(coded.dictionary))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after another, and how many each has; each different word is encoded once."""
        if not self.by_word:
            each = [self.ids(t) for t in texts.to_pylist()]
            return np.array(list(chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each], np.int64)
        words, place, ids, size = self._lookup(texts)
        sizes = size[place]
        ends = np.cumsum(sizes)
        shift = (np.cumsum(size) - size)[place] - (ends - sizes)  # from a place in the output to one in ids
        ends = np.append(0, ends)[np.append(0, np.cumsum(words))]
        return ids[np.repeat(shift, sizes) + np.arange(ends[-1])], np.diff(ends)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return np.array([len(self.ids(t)) for t in texts.to_pylist()], np.int64)
        words, place, _, size = self._lookup(texts)
        return np.diff(np.append(0, np.cumsum(size[place]))[np.append(0, np.cumsum(words))])

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])


def _ordered(model: dict) -> bool:
    """True if a model merges bytes to words with ends, and its merges stand in the order of the ids they give."""
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _END or model.get("continuing_subword_prefix"):
        return False
    vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(m).removesuffix(_END) + _END * m[1].endswith(_END)] for m in pairs]
    return not model.get("dropout") and not model.get("ignore_merges") and all(a < b for a, b in zip(made, made[1:]))


def _hard(c: str) -> bool:
    return c.isascii() and c.isalnum()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path`` (kept between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _seam_rows(enc: Encoder, text: str, start: int, head: int, tail: int, length: int):
    """Total tokens of a chunk, and its agreed-on candidates in the overlap at either end.

    A candidate is (document position, tokens before it in the chunk, ids of the tokens around it).
    """
    ids, begins = enc.spans(text)
    heads, tails = [], []
    for k in range(len(begins)):
        at = begins[k]
        in_head, in_tail = start > 0 and at < head, start + len(text) < length and at >= len(text) - tail
        if (in_head or in_tail) and (k == 0 or begins[k - 1] < at) and enc.stable(text, at):
            near = ids[k:k + AGREE]
            if len(near) == AGREE:
                item = {"at": start + at, "before": k, "near": near}
                if in_head:
                    heads.append(item)
                if in_tail:
                    tails.append(item)
    return len(ids), heads, tails


_ITEM = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("before", T.LongType()),
                                  T.StructField("near", T.ArrayType(T.LongType()))]))


def _chunk_counts(path: str, schema: pa.Schema, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            firsts, lengths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [_seam_rows(enc, t, s, 2 * overlap, 2 * overlap, n) for t, s, n in zip(texts, firsts, lengths)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(
                    [keys, firsts, [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]], schema)],
                schema=schema)
    return run


def _spliced(long_docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, tokens or null where a seam found no common boundary) of documents cut into chunks."""
    # a chunk is a piece with the ends of its neighbours: a piece is cut from the text in linear time, see cut_pieces
    parts = F.posexplode(F.transform(F.col("cores"), lambda c, i: F.concat(
        F.when(i > 0, F.right(F.get("cores", i - 1), F.lit(overlap))).otherwise(""), c,
        F.coalesce(F.substring(F.get("cores", i + 1), 1, overlap), F.lit("")))))
    cut = (long_docs.select("key", "n_chars", cut_pieces(F.col("text"), chunk).alias("cores"))
           .select("key", "n_chars", parts.alias("number", "text"))
           .select("key", "text", F.greatest(F.col("number").cast("long") * chunk - overlap, F.lit(0)).alias("first"),
                   "n_chars"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("first", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("heads", _ITEM),
                           T.StructField("tails", _ITEM)])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    parts = cut_lineage(cut.repartition(cut.sparkSession.sparkContext.defaultParallelism * 4, "key", "first")
                        .mapInArrow(_chunk_counts(path, arrow, overlap), schema))
    number = F.when(F.col("first") == 0, F.lit(0)).otherwise((F.col("first") + overlap) / chunk).cast("long")
    left = parts.select("key", number.alias("seam"), "tails")
    right = parts.filter("first > 0").select("key", (number - 1).alias("seam"), "heads")
    common = F.filter(
        F.flatten(F.transform("tails", lambda a: F.transform(
            F.filter("heads", lambda b: (a["at"] == b["at"]) & (a["near"] == b["near"])),
            lambda b: F.struct(a["at"].alias("at"), a["before"].alias("l"), b["before"].alias("r"))))),
        lambda x: x["at"].isNotNull())
    seams = (left.join(right, ["key", "seam"]).select("key", "seam", F.element_at(
        F.when(F.size(common) > 0, common), 1).alias("s")))
    # tokens of a document: those of each chunk from its first splice up to its last
    total = parts.groupBy("key").agg(F.sum("n").alias("n"))
    # the left chunk loses what follows the splice, the right one what precedes it
    lost = (seams.join(parts.select("key", number.alias("seam"), F.col("n").alias("ln")), ["key", "seam"])
            .groupBy("key").agg(F.sum(F.col("ln") - F.col("s.l") + F.col("s.r")).alias("lost"),
                                F.count(F.when(F.col("s").isNull(), 1)).alias("open")))
    return total.join(lost, "key", "left").select(
        "key", F.when(F.coalesce("open", F.lit(0)) == 0, F.col("n") - F.coalesce("lost", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit): the library's token count of every whole text.

    Null and empty texts have no bytes and no tokens; a null id is an ordinary value; repeated rows give
    repeated results; extra columns are ignored; an empty table gives no rows. Texts over ``chunk_chars`` are
    cut in linear time and encoded in chunks, over several tasks. ``over_limit`` is ``n_tokens > limit``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    out_schema = T.StructType([field(docs, id_col, "id"), T.StructField("text", T.StringType()),
                               T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in pieces(batches, 1, 4 << 20):
            texts = batch.column(1).cast(pa.string())
            long_ = pc.greater(pc.utf8_length(texts), chunk_chars).to_pylist()
            left = pa.nulls(len(texts), pa.string())
            if any(long_):  # those are kept for the chunks
                every = texts.to_pylist()
                left = pa.array([t if x else None for t, x in zip(every, long_)], pa.string())
                texts = pa.array(["" if x else t for t, x in zip(every, long_)], pa.string())
            counts = pa.array([None if x else n for n, x in zip(enc.counts(texts).tolist(), long_)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), left, batch.column(2), counts],
                                             schema=arrow)

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("nb"))
    counted = cut_lineage(rows.mapInArrow(short, out_schema))
    done = counted.filter("n_tokens is not null").select("id", "n_bytes", "n_tokens")
    # huge texts: one copy of each, keyed by a row number that is written before it is used
    open_ = counted.filter("n_tokens is null").select("id", "n_bytes", "text")
    if open_.limit(1).count():
        open_ = cut_lineage(open_.withColumn("key", F.monotonically_increasing_id())
                            .withColumn("n_chars", F.length("text").cast("long")))
        longest = int(open_.agg(F.max("n_chars")).first()[0])
        chunk, overlap, todo = chunk_chars, min(overlap_chars, chunk_chars), open_
        while True:
            got = cut_lineage(_spliced(todo, tokenizer, chunk, overlap))
            done = done.unionByName(open_.join(got.filter("n_tokens is not null"), "key")
                                    .select("id", "n_bytes", "n_tokens"))
            failed = got.filter("n_tokens is null").select("key")
            if chunk >= longest or not failed.limit(1).count():
                break
            todo = open_.join(failed, "key", "left_semi")
            chunk, overlap = chunk * 4, min(overlap * 8, chunk * 4)  # a chunk reaches into its neighbours only
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                       (F.col("n_tokens") > limit).alias("over_limit"))
