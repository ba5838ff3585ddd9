import collections
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from statfold.llm import langid
from statfold.llm.queries import QUERIES, tokenizer_path
from statfold.llm.tokens import Encoder
from tests.llm.helpers import docs
from tests.llm.test_blocknames import lower
from tests.llm.test_simhash import fingerprint

from ..conftest import SF_SMALL


def _components(data):
    fps = np.array([fingerprint(t) for _, t in data], np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    low = np.arange(len(data))
    while True:
        new = np.array([low[close[k]].min() for k in range(len(data))])
        if (new == low).all():
            return low
        low = new


def test_run_equals_brute_force(spark):
    table = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    left = sorted(zip(table["doc_id"], table["text"]))
    model = langid.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter(~langid.held_out()))
    far = model.nearest([t or "" for _, t in left])[2]
    left = [x for x, f in zip(left, far) if langid.has_letter(x[1] or "") and not f]
    best = {}
    for i, t in left:
        best[lower(t)] = max(i, best.get(lower(t), i))
    left = [(i, t) for i, t in left if best[lower(t)] == i]
    root = _components(left)
    left = [x for k, x in enumerate(left) if root[k] == k]
    items = duckdb.sql(f"select text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    left = [(i, t) for i, t in left if not any(x in t for (x,) in items)]
    enc = Encoder(tokenizer_path())
    want = {i: len(enc.ids(t)) + 1 for i, t in left}
    got, pieces = collections.Counter(), collections.defaultdict(int)
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        got[r.doc_id] += r.length
        pieces[r.sequence_id] += r.length
    assert got == want and max(pieces.values()) <= 4096


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup",
                                                      "benchmark_decontamination", "lexical_packing"]
    start = docs(spark, [(1, "The one text that is here of words."), (2, "the ONE text that is here of words."), (3, None)])
    cut = start
    for _, stage in corpus_pipeline.STAGES[:-1]:
        cut = stage(spark, cut, SF_SMALL)
        assert cut.columns == start.columns
    assert {r.doc_id for r in cut.collect()} == {2}


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF_SMALL).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_language_learns_from_held_out_documents_too(spark):
    """A language whose documents all lie in the quarter that op3 holds out is learned, so its documents stay."""
    out = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2]
    ids = sorted(set(range(1000)) - set(out))
    words = [f"{a}{b}" for a in ("har", "mon", "tel", "vis") for b in ("den", "lor", "ser", "tam")]
    other = [f"{a}{b}" for a in ("щук", "жёл", "цыф", "эхо") for b in ("ющи", "мыш", "ньк", "зъе")]
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(draw.choice(words, 30)), "aa") for i in ids[:60]] + [(i, " ".join(draw.choice(other, 30)), "bb") for i in out[:20]]
    left = corpus_pipeline.language(spark, docs(spark, rows), SF_SMALL)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in rows}


def test_packed_pieces_have_the_ids_of_their_documents(spark):
    data = [(1, "some words to pack"), (2, None), (3, "long text of words " * 2000)]
    enc, got = Encoder(tokenizer_path()), collections.defaultdict(list)
    for r in sorted(corpus_pipeline.packed(spark, docs(spark, data), SF_SMALL).collect(), key=lambda r: r.start):
        assert len(r.ids) == r.length
        got[r.doc_id] += r.ids
    assert got == {i: [*enc.ids(t or ""), 2] for i, t in data}
