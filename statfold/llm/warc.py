"""WARC archives: writing with segmented records and revisits, reading with segment reassembly.

Records are built by DataFrame functions and written by Spark's text writer: the record separator of WARC
(two line ends) is its line separator, so a record is a row. A response block longer than ``segment_chars``
is cut into a first record and continuation records. The reader parses each archive file in one pass;
blocks of segmented records are grouped by the origin's record id, put in order of their segment numbers,
checked against the total length, and then, as unsegmented ones at once, decoded from chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.llm.common import cut_pieces
from statfold.session import broadcast_if_small, cut_lineage

SEGMENT_CHARS = 32_768
CHUNK_CHARS = 8_192
FILE_RECORDS = 2_000
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_EOL = "\r\n"


def _base32(hex_digits: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hex digits: five hex digits are four of base 32."""
    groups = [F.lpad(F.conv(F.substring(hex_digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """``name: value`` and a line end, or nothing for null; line ends in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "),
                               F.lit(_EOL)), F.lit(""))


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _cut(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters; none of an empty text."""
    return F.when(F.length(text) > 0, cut_pieces(text, size)).otherwise(F.array().cast("array<string>"))


def _http(payload: Column) -> Column:
    """A response block whose body has chunked framing."""
    chunks = F.transform(_cut(payload, CHUNK_CHARS),
                         lambda c: F.concat(F.hex(F.octet_length(c)), F.lit(_EOL), c, F.lit(_EOL)))
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}"
                          f"Transfer-Encoding: chunked{_EOL}{_EOL}"), F.array_join(chunks, ""), F.lit(f"0{_EOL}{_EOL}"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", segment_chars: int = SEGMENT_CHARS,
                   revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row (and its continuations) under ``path``.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes those with the smallest id are
    responses and the others revisits without a payload. Null html is an empty payload; a null id is
    larger than any other; rows that share id and payload are written alike.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size"))
    again = (rows.filter(F.col("size") >= revisit_bytes).groupBy("key")
             .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"))
             .filter("n > 1 and first is not null").drop("n"))
    rows = rows.join(broadcast_if_small(cut_lineage(again)), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    digest = F.concat(F.lit("sha1:"), _base32(F.sha1("payload")))
    rows = rows.select("id", "url", "first", "first_url", revisit.alias("revisit"), digest.alias("digest"), "payload",
                       _uuid(F.concat_ws("/", F.monotonically_increasing_id(), F.col("id"))).alias("record"))
    block = F.when(F.col("revisit"), F.lit(f"HTTP/1.1 200 OK{_EOL}{_EOL}")).otherwise(_http(F.col("payload")))
    rows = rows.withColumn("block", block).withColumn("total", F.octet_length("block"))
    rows = rows.select("id", "url", "first", "first_url", "revisit", "digest", "record", "total",
                       F.ceil(F.length("block") / segment_chars).alias("n"),
                       F.posexplode(_cut(F.col("block"), segment_chars)).alias("k", "part"))
    first, split = F.col("k") == 0, F.col("n") > 1
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: "),
        F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response"), F.lit(_EOL),
        _header("WARC-Record-ID", F.when(first, F.col("record")).otherwise(
            _uuid(F.concat_ws("/", F.col("record"), F.col("k"))))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.when(first, F.col("url"))),
        _header("WARC-Payload-Digest", F.when(first, F.col("digest"))),
        _header("WARC-Profile", F.when(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("first_url"))),
        _header("WARC-Refers-To-Date", F.when(F.col("revisit"), F.lit(DATE))),
        _header("X-Refers-To-Page", F.when(F.col("revisit"), F.col("first"))),
        _header("X-Page", F.when(first, F.col("id"))),
        _header("WARC-Segment-Number", F.when(split, F.col("k") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.col("record"))),
        _header("WARC-Segment-Total-Length", F.when(~first & (F.col("k") + 1 == F.col("n")), F.col("total"))),
        F.when(first, _header("Content-Type", F.lit("application/http;msgtype=response"))).otherwise(""),
        _header("Content-Length", F.octet_length("part")), F.lit(_EOL))
    (rows.select(F.concat(head, "part").alias("value")).write
     .option("lineSep", _EOL + _EOL).option("maxRecordsPerFile", FILE_RECORDS).text(path))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive's bytes.

    Bytes that are no whole record (cut short, a wrong length, without a needed header) are given as one pair whose
    only header is ``error``; reading goes on at the next record.
    """
    at = 0
    while at < len(data):
        try:
            fields, start = _head(data, at)
            stop = start + int(fields["content-length"])
            if data[stop:stop + 4] != b"\r\n\r\n":
                raise ValueError("record cut short" if stop + 4 > len(data) else "record with a wrong length")
        except ValueError as e:
            again = at
            while True:
                again = data.find(b"\r\n\r\nWARC/", again)
                again = len(data) if again < 0 else again + 4
                if again == len(data) or _starts(data, again):
                    break
            yield {"error": f"{e} at byte {at}"}, data[at:again]
            at = again
            continue
        yield fields, data[start:stop]
        at = stop + 4


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Headers of the record at ``at`` and where its block begins; ValueError if it has not the needed ones."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("record without an end of its headers")
    lines = data[at:end].decode("utf-8").split(_EOL)
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    for name in ("content-length", "warc-segment-number", "warc-segment-total-length"):
        if name in fields and not (fields[name].isascii() and fields[name].isdigit()):
            raise ValueError(f"{name} is no number")
    return fields, end + 4


def _starts(data: bytes, at: int) -> bool:
    try:
        _head(data, at)
    except ValueError:
        return False
    return True


def dechunk(body: bytes) -> bytes:
    """The content of chunked transfer framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_FIELDS = ["record_id", "record_type", "url", "page", "refers_to", "stated_digest"]
_RECORD = T.StructType([*[T.StructField(x, T.StringType()) for x in _FIELDS],
                        T.StructField("origin", T.StringType()), T.StructField("number", T.IntegerType()),
                        T.StructField("total", T.LongType()), T.StructField("block", T.BinaryType()),
                        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                        T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


def _decoded(block: bytes, keep: bool) -> tuple:
    """(bytes, digest, payload) of a whole block; nulls if its framing is broken."""
    try:
        body = payload_of(block)
    except ValueError:
        return None, None, None
    return len(body), sha1_base32(body), body if keep else None


def _parse(keep: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in records(content.as_py()):
                    if "error" in f:
                        rows.append((None,) * (len(schema) - 1) + (f["error"],))
                        continue
                    kind = f["warc-type"]
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    origin = (f.get("warc-segment-origin-id") or f["warc-record-id"]) if number else None
                    total = f.get("warc-segment-total-length")
                    # a revisit's block has no payload of its own
                    whole = (None, None, None) if number or kind == "revisit" else _decoded(block, keep)
                    rows.append((f["warc-record-id"], kind, f.get("warc-target-uri"), f.get("x-page"),
                                 f.get("x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 origin, number, int(total) if total else None, block if number else None, *whole,
                                 _fault(kind, number, f.get("warc-payload-digest", ""), whole)))
                    size += len(block)
                    if size > 16 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)
    return run


def _fault(kind: str, number: int | None, stated: str, whole: tuple) -> str | None:
    """What is wrong with a record that is read whole."""
    if number or kind == "revisit":
        return None
    if whole[1] is None:
        return "broken framing"
    return "payload differs from its digest" if stated and stated.removeprefix("sha1:") != whole[1] else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_WHOLE = T.StructType([*[T.StructField(x, T.StringType()) for x in _FIELDS],
                       T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                       T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


def _reassemble(keep: bool, schema: pa.Schema):
    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        first = rows[0]
        block = b"".join(r["block"] for r in rows)
        whole = ([r["number"] for r in rows] == list(range(1, len(rows) + 1))
                 and rows[-1]["total"] == len(block))
        got = _decoded(block, keep) if whole else (None, None, None)
        fault = _fault("response", None, first["stated_digest"] or "", got) if whole else "segments missing or of another length"
        values = [*[first[x] for x in _FIELDS], *got, fault]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
    return one


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``: one row per response or revisit.

    record_id, record_type, url, page, refers_to, stated_digest (of the header), payload_bytes,
    payload_digest, payload and error. Payload and the two before it are of the decoded payload; they are null for a
    revisit, and for a response whose segments are not all there, do not add up to the total length, or have broken
    framing. ``error`` says so, and tells of a payload that differs from the digest in its header; bytes that are no
    whole record are a row with ``error`` alone. An empty folder gives no rows. Blocks may be of any length; the
    segments of one record are brought together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(_parse(with_payload, to_arrow_schema(_RECORD)), _RECORD)
    # parsed once: the unsegmented records and the segments are read from it separately
    rows = cut_lineage(rows)
    whole = rows.filter("number is null").select(*_WHOLE.names)
    parts = rows.filter("number is not null")
    joined = parts.groupBy("origin").applyInArrow(_reassemble(with_payload, to_arrow_schema(_WHOLE)), _WHOLE)
    return whole.unionByName(joined)


def resolve(found: DataFrame) -> DataFrame:
    """Give revisits the length and digest of the payload they refer to (null if it is not there)."""
    # a page id may stand for several payloads: the header's digest says which one is meant
    answers = (found.filter("record_type = 'response' and payload_digest is not null")
               .groupBy(F.col("page").alias("ap"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("b")))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    own = found.filter(~revisit)
    again = (found.filter(revisit).drop("payload_bytes", "payload_digest")
             .join(answers, (F.col("refers_to") == F.col("ap")) & (F.col("stated_digest") == F.col("d")), "left").drop("ap")
             .withColumnsRenamed({"b": "payload_bytes", "d": "payload_digest"}))
    return own.unionByName(again)
