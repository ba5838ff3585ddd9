import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statfold.llm import tokens
from statfold.llm.common import pieces
from statfold.llm.tokens import Cache, Encoder, count_tokens
from tests.llm.helpers import AWKWARD, docs, rows

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "<|startoftext|> a<|endoftext|>b", "don't I'LL it's", "cafe\u0301 \u0301x", "İstanbul ΣΑΣ ß ﬁ",
       "a\x1cb\x1f c\x1dd", "１２3 4５", "!!!a??b--c 'S 's", "𝔸😀 x\u200dy", "日本語 テスト", "a\x85b \x0b\x0c c\u00a0d",
       "É!! È$$$ '", "\ufeffabc <|x|>", "_a_ 1a2", "a\u2028b", "x" * 400, "<|<|startoftext|>|>", "a.b,c;d"]


@pytest.fixture(scope="module")
def word():
    return Encoder(WORD)


def test_words_one_by_one_equal_the_whole(word):
    assert word.by_word
    for t in ODD:
        assert word.packed(t) == b"".join(x.to_bytes(4, "little") for x in word.ids(t)), t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    enc = tokens.encoder(WORD)
    assert enc.count(t) == len(enc.ids(t))


def test_cache_is_bounded():
    cache = Cache(10)
    for k in range(100):
        cache.put(k, k)
        cache.get(3)
    assert len(cache.new) + len(cache.old) <= 20 and cache.get(3) == 3


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_chunks_are_spliced_to_the_whole(spark, path):
    enc = Encoder(path)
    long_ = ["The quick, brown fox isn't 12 years old.\n" * 300, "x" * 5000, "ab " * 3000 + "y" * 4000 + " cd" * 3000,
             "日本語テスト" * 900, "é è ê " * 1200, " " * 4000 + "a", "a  b\t\tc " * 700]
    data = [*AWKWARD, *[(50 + k, t) for k, t in enumerate(long_)]]
    got = rows(count_tokens(docs(spark, data), path, chunk_chars=512, overlap_chars=64, limit=100),
               "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(enc.ids(t or "")), n > 100) for i, t in data]
    assert got == sorted(want, key=str)


def test_batches_of_a_larger_table(spark, monkeypatch):
    """Slices of Arrow batches, some with long texts and some without."""
    monkeypatch.setattr(tokens, "pieces", lambda batches, column, limit=0: pieces(batches, column, 300))
    enc = Encoder(WORD)
    data = [(k, ("long " * 200 if k % 9 == 0 else f"short text {k}, no more")) for k in range(60)]
    got = rows(count_tokens(docs(spark, data, parts=1), WORD, chunk_chars=512, overlap_chars=64), "doc_id", "n_tokens")
    assert got == sorted([(i, len(enc.ids(t))) for i, t in data], key=str)


def test_empty_table(spark):
    assert count_tokens(docs(spark, []), WORD).count() == 0


def test_batches_equal_the_library(word):
    """Every vocabulary token as a word, and random words, encoded by ranks; texts the library must see mixed in."""
    import random

    import numpy as np
    import pyarrow as pa
    draw = random.Random(5)
    stands = {c: b for b, c in tokens._byte_chars().items()}
    own = [bytes(stands[c] for c in t.removesuffix("</w>")).decode("utf-8", "ignore")
           for t in word.tok.get_vocab() if not t.startswith("<|")]
    made = ["".join(draw.choice(al) for _ in range(draw.randint(1, 20)))
            for al in ("etaoinshr", "abcdefghijklmnopqrstuvwxyzàéüß'", "aA1!.,'é") for _ in range(3000)]
    texts = [" ".join(own[k:k + 50]) for k in range(0, len(own), 50)]
    texts += [" ".join(made[k:k + 30]) for k in range(0, len(made), 30)] + ODD
    ids, sizes = word.batch(pa.array(texts, pa.string()))
    for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == word.ids(t), t
    assert word.counts(pa.array(texts, pa.string())).tolist() == sizes.tolist()
    assert word.batch(pa.array([], pa.string()))[0].size == 0
    part = word.batch(pa.array(texts, pa.string()).slice(7, 900))  # a view into a larger array
    assert part[1].tolist() == sizes[7:907].tolist()
    assert part[0].tolist() == ids[sizes[:7].sum():sizes[:907].sum()].tolist()


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F
    frame = spark.range(1).select(F.repeat(F.lit("word and word "), 100_000).alias("t"))

    def seconds(times):
        began = time.time()
        frame.select(F.size(tokens.cut_pieces(F.repeat("t", times), 4096)).alias("n")).collect()
        return time.time() - began
    seconds(1)
    assert seconds(16) < 8 * seconds(4) + 2
