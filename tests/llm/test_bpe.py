import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from statfold.llm.bpe import Codec, codec, decode, encode
from statfold.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, docs, rows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MANY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["", "'s", "'S", "don't", " it's''re 'll", " x", "a\x1cb\x1f ", "１2½ 3", "日本語。テスト", "é é",
          "  \n\n a", "!?'s", "--'t", "<|endoftext|>", " 　 ", "😀👩‍👩‍👧", "x" * 40, " " * 40, "\t1 "]


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def packed(ids):
    return b"".join(x.to_bytes(4, "little") for x in ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=8)), max_size=12), st.integers(1, 12))
def test_pieces_equal_the_whole(parts, chunk):
    own, text = codec(RANKS, PATTERN), "".join(parts)
    whole = own.library.encode_ordinary(text)
    assert own.ids(text, chunk) == packed(whole)
    assert own.text(packed(whole), 8) == text.encode()


def test_runs_beyond_the_librarys_stack(library):
    own = codec(RANKS, PATTERN)
    for run in (" " * 700_000 + "a", "a" + "\n " * 300_000, "x" * 300_000, "語" * 200_000):
        ids = own.ids(run)
        assert own.text(ids) == run.encode()
    # the same run where the library still copes
    for run in (" " * 5_000 + "a b", "\t \n" * 2_000 + "'s", "x" * 5_000 + "1" * 3_000, "!" * 4_000 + "'s"):
        assert own.ids(run, 64) == packed(library.encode_ordinary(run))


def test_time_grows_with_the_text():
    import time
    own, unit = codec(RANKS, PATTERN), "Words, 12 of them; isn't it? " * 20_000

    def took(text):
        best = 9.0
        for _ in range(2):
            t = time.process_time()
            own.ids(text)
            best = min(best, time.process_time() - t)
        return best
    assert took(unit * 8) < 8 * 3 * max(took(unit), 0.02)


@pytest.mark.parametrize("path", [RANKS, MANY])
def test_encode_and_decode(spark, path):
    own = Codec(path, PATTERN)
    data = [*AWKWARD, *[(100 + k, t) for k, t in enumerate(PIECES)], (99, "Long text, isn't it 1 2 3?\n" * 400)]
    table = docs(spark, data)
    coded = encode(table, path, PATTERN, chunk_chars=50)
    want = [(i, len(ids := own.library.encode_ordinary(t or "")), packed(ids)) for i, t in data]
    got = [(a, b, bytes(c)) for a, b, c in rows(coded, "doc_id", "n_tokens", "ids")]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = [(a, bytes(b)) for a, b in rows(decode(coded, path, PATTERN), "doc_id", "decoded")]
    assert sorted(back, key=str) == sorted([(i, (t or "").encode()) for i, t in data], key=str)


def test_raw_bytes_of_cut_characters(spark):
    own = codec(RANKS, PATTERN)
    ids = own.library.encode_ordinary("😀")
    assert len(ids) > 1
    coded = spark.createDataFrame([(1, bytearray(packed(ids[:1]))), (2, None), (None, bytearray())],
                                  "doc_id long, ids binary")
    got = dict((a, bytes(b)) for a, b in rows(decode(coded, RANKS, PATTERN), "doc_id", "decoded"))
    assert got == {1: own.library.decode_bytes(ids[:1]), 2: b"", None: b""}
    assert "😀".encode().startswith(got[1])


def test_empty_table(spark):
    coded = encode(docs(spark, []), RANKS, PATTERN)
    assert coded.count() == 0 and decode(coded, RANKS, PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_byte_bpe"](spark, sf)
    assert [c for c, _ in got.dtypes[:4]] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
