import base64
import glob
import hashlib

import pytest

from statfold.llm.warc import dechunk, payload_of, read_archives, records, resolve, write_archives
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string, id string, record string"


def _pages(spark, data):
    return spark.createDataFrame([(*r, "i", "r") for r in data], PAGES).repartition(3)


def brute(data):
    out = []
    for i, _, h in data:
        body = (h or "").encode()
        same = [j for j, _, g in data if (g or "") == (h or "") and j is not None]
        first = min(same) if same else None
        again = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def _read(spark, path):
    found = resolve(read_archives(spark, path))
    return sorted([(None if r.page is None else int(r.page), r.payload_bytes, r.payload_digest, r.record_type,
                    None if r.refers_to is None else int(r.refers_to)) for r in found.collect()], key=str)


DATA = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "u\r\nX: y", ""),
        (5, "http://a/5", "é" * 700), (6, "", "\r\n\r\nWARC/1.1\r\n" * 90), (7, "http://a/7", "é" * 700),
        (None, "http://n", "lone"), (None, "http://n", "<p>one</p>"), (9, "x: y", "z" * 100_000), (10, "u", "é" * 700)]


@pytest.mark.parametrize("segment", [64, 200, 32_768])
def test_round_trip(spark, tmp_path, segment):
    path = str(tmp_path / "a")
    write_archives(_pages(spark, DATA), path, segment_chars=segment)
    assert _read(spark, path) == brute(DATA)
    kept = {r.page: bytes(r.payload).decode() for r in read_archives(spark, path).collect()
            if r.record_type == "response" and r.page}
    assert kept["5"] == "é" * 700 and kept["9"] == "z" * 100_000


def test_files_are_archives(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(_pages(spark, DATA), path, segment_chars=64)
    found = [x for f in glob.glob(path + "/part-*") for x in records(open(f, "rb").read())]
    by_origin = {}
    for f, block in found:
        if "warc-segment-number" in f:
            by_origin.setdefault(f.get("warc-segment-origin-id", f["warc-record-id"]), []).append(
                (int(f["warc-segment-number"]), f, block))
    assert by_origin and len({f["warc-record-id"] for f, _ in found}) == len(found)
    for parts in by_origin.values():
        parts.sort(key=lambda x: x[0])
        assert [n for n, *_ in parts] == list(range(1, len(parts) + 1))
        assert int(parts[-1][1]["warc-segment-total-length"]) == sum(len(b) for *_, b in parts)
        payload_of(b"".join(b for *_, b in parts))


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(_pages(spark, DATA), path, revisit_bytes=1000)
    got = {(r[0], r[3]) for r in _read(spark, path)}
    assert (2, "response") in got and (7, "revisit") in got


def test_repeated_rows(spark, tmp_path):
    data = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same" * 100)]
    path = str(tmp_path / "a")
    write_archives(_pages(spark, data), path, segment_chars=64)
    assert [r[0:2] + r[3:] for r in _read(spark, path)] == [(1, 4, "response", None)] * 2 + [(2, 400, "response", None)]


def test_broken_segments_give_no_payload(spark, tmp_path):
    eol = b"\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"

    def record(kind, rid, body, *more):
        lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *more,
                 b"Content-Length: " + str(len(body)).encode()]
        return eol.join(lines) + eol + eol + body + eol + eol
    data = (record(b"response", b"<a>", block[:9], b"WARC-Segment-Number: 1")
            + record(b"continuation", b"<b>", block[9:], b"WARC-Segment-Number: 2", b"WARC-Segment-Origin-ID: <a>",
                     b"WARC-Segment-Total-Length: " + str(len(block)).encode())
            + record(b"response", b"<c>", block[:9], b"WARC-Segment-Number: 1")
            + record(b"continuation", b"<d>", block[9:], b"WARC-Segment-Number: 3", b"WARC-Segment-Origin-ID: <c>",
                     b"WARC-Segment-Total-Length: " + str(len(block)).encode())
            + record(b"response", b"<e>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhel"))
    (tmp_path / "part-0").write_bytes(data)
    got = rows(read_archives(spark, str(tmp_path)), "record_id", "payload_bytes")
    assert got == [("<a>", 5), ("<c>", None), ("<e>", None)]


def test_chunked_framing():
    assert dechunk(b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert dechunk(b"0\r\n\r\n") == b""
    with pytest.raises(ValueError):
        dechunk(b"3\r\nabcd\r\n0\r\n\r\n")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(_pages(spark, []), path)
    assert _read(spark, path) == []


def _one(kind, rid, body, *more):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *more, b"Content-Length: " + str(len(body)).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_broken_records_are_rows(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = [_one(b"response", b"<%d>" % k, body) for k in range(4)]
    data = (good[0] + good[1].replace(b"WARC-Type: response\r\n", b"") + b"garbage\r\n\r\n" + good[2]
            + good[3].replace(b"Content-Length: 24", b"Content-Length: 9") + _one(b"response", b"<5>", body, b"WARC-Payload-Digest: sha1:AAAA")
            + good[0].replace(b"Content-Length: 24", b"Content-Length: x") + _one(b"response", b"<6>", body)[:-20])
    (tmp_path / "part-0").write_bytes(data)
    (tmp_path / "part-1").write_bytes(b"WARC/1.1\r\nWARC-Type: resp")
    (tmp_path / "part-2").write_bytes(b"")
    got = rows(read_archives(spark, str(tmp_path)), "record_id", "payload_bytes", "error")
    assert [(a, b) for a, b, _ in got if a] == [("<0>", 5), ("<2>", 5), ("<5>", 5)]
    assert [c for a, _, c in got if a == "<5>"] == ["payload differs from its digest"]
    told = sorted(c.split(" at byte")[0] for a, _, c in got if not a)
    assert told == ["content-length is no number", "record cut short", "record with a wrong length",
                    "record without an end of its headers", "record without warc-type"]
    assert [r for r in resolve(read_archives(spark, str(tmp_path))).collect() if r.error is None and not r.payload_bytes] == []


def test_revisits_of_an_id_with_several_payloads(spark, tmp_path):
    data = [(1, "u", "first payload"), (1, "u", "other"), (2, "v", "other"), (3, "w", "first payload")]
    path = str(tmp_path / "a")
    write_archives(_pages(spark, data), path)
    assert _read(spark, path) == brute(data)


def test_long_pages(spark, tmp_path):
    path = str(tmp_path / "a")
    data = [(1, "u", "äb c" * 2_000_000), (2, "u", "x")]
    write_archives(_pages(spark, data), path)
    assert _read(spark, path) == brute(data)
