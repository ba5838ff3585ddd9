"""Byte-level BPE encoding and decoding of whole texts with tiktoken and a local rank file.

``encode`` gives every text's ids, ``decode`` the raw bytes of ids. A long text is cut at safe boundaries first,
so that the regular expression and the merges see bounded pieces: a boundary is safe if no match of the split
pattern can hold the characters on both of its sides and no match before it looks beyond it (see ``SAFE``).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import field, pieces

CHUNK_CHARS = 1 << 16    # texts up to this go to the library whole; longer ones in pieces of about as many
BATCH_BYTES = 4 << 20    # text or ids handled at once

# Every match of the split pattern is a contraction ('s and the like), an optional space before a run of letters,
# of numbers or of other marks, or a run of white space; only white space looks ahead. So a match always ends
# after a character that is not white space where white space follows, after a letter where a number or mark
# follows, after a number where a letter or mark follows, and after a mark other than an apostrophe where a letter
# or number follows; none of these matches looks further. Letters and marks are named by ranges that every
# version of Unicode puts in the same class, because the library's tables are not this interpreter's.
# the characters of Unicode's White_Space property (fixed values)
WHITE_CHARS = ("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
WHITE = re.escape(WHITE_CHARS)
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿА-яぁ-ゔァ-ヺ一-龥가-힣"
_MARK = r"!-&(-/:-@\[-`{-~、。！，？"
SAFE = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{_LETTER}])(?=['0-9{_MARK}])|(?<=[0-9])(?=['{_LETTER}{_MARK}])"
                  rf"|(?<=[{_MARK}])(?=[0-9{_LETTER}])")
# of a run of white space before something else the pattern takes all but the last character as one match
LONG_WHITE = re.compile(rf"[{WHITE}]{{4096,}}+")


class Codec:
    """One rank file: lines of a base64 token and its rank."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def parts(self, text: str, chunk: int) -> Iterator[str]:
        """``text`` in pieces that end at the first safe boundary after ``chunk`` characters each."""
        start = 0
        while len(text) - start > chunk:
            found = SAFE.search(text, start + chunk)
            if found is None or found.start() >= len(text):
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def ids(self, text: str, chunk: int = CHUNK_CHARS) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if len(text) <= chunk:
            return _pack(self.library.encode_ordinary(text))
        out, done = [], 0
        # the library's regular expression overflows its stack on very long white space
        for white in LONG_WHITE.finditer(text):
            out += [self.library.encode_ordinary(p) for p in self.parts(text[done:white.start()], chunk)]
            done = white.end() if white.end() == len(text) else white.end() - 1
            out.append(self.library._encode_single_piece(text[white.start():done]))
        out += [self.library.encode_ordinary(p) for p in self.parts(text[done:], chunk)]
        return b"".join(map(_pack, out))

    def text(self, ids: bytes, step: int = BATCH_BYTES) -> bytes:
        """The bytes of packed ids, whether or not they are valid UTF-8."""
        decode = self.library.decode_bytes
        return b"".join(decode(_unpack(ids[k:k + step])) for k in range(0, len(ids), step))


def _pack(ids: list[int]) -> bytes:
    return pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()[:4 * len(ids)] if ids else b""


def _unpack(ids: bytes) -> list[int]:
    return pa.Array.from_buffers(pa.uint32(), len(ids) // 4, [None, pa.py_buffer(ids)]).to_pylist()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: str, pattern: str) -> Codec:
    """The worker's codec for a rank file (kept between tasks)."""
    if (ranks, pattern) not in _CODECS:
        _CODECS[ranks, pattern] = Codec(ranks, pattern)
    return _CODECS[ranks, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (id, n_tokens, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by the ranks on its own, as the library does; special strings are plain
    text. Null and empty texts have no ids (n_tokens 0, empty ids); a null id is an ordinary value; repeated rows
    give repeated results, in no promised order; there are no ties to break; an empty table gives an empty one;
    extra columns, whatever their names, are ignored. Texts over ``chunk_chars`` characters are cut at safe
    boundaries, and a run without one is split by the pattern here and merged match by match, so no length fails.
    """
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in pieces(batches, 1, BATCH_BYTES):
            ids = [own.ids(t or "", chunk_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type),
                                              pa.array([len(x) // 4 for x in ids], pa.int64()),
                                              pa.array(ids, pa.binary())], schema=arrow)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, ``keep`` columns, decoded): the raw bytes that packed ids stand for, as binary.

    Bytes are joined as they are: ids that cut a character in two give its part. Null and empty ids give no bytes;
    an id beyond the ranks is an error. Null row ids, repeated rows, empty tables and extra columns as in ``encode``.
    """
    names = [id_col, *keep]
    schema = T.StructType([*(field(encoded, c, f"k{i}") for i, c in enumerate(names)),
                           T.StructField("decoded", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in pieces(batches, last, BATCH_BYTES):
            found = [own.text(x or b"") for x in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(last)),
                                              pa.array(found, pa.binary())], schema=arrow)
    out = encoded.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names)), F.col(ids_col).alias("packed"))
    return out.mapInArrow(run, schema).toDF(*names, "decoded")
