import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from statfold.llm.pack import Leaders, Pool, pack
from statfold.llm.tokens import Encoder
from tests.llm.helpers import AWKWARD, docs

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(df, data, window):
    enc = Encoder(WORD)
    want = [[*enc.ids(t or ""), 2] for _, t in data]
    seqs, whole = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes())
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    got = []
    for (i, n), parts in whole.items():
        ids, copies = [], 0
        for start, piece in sorted(parts):
            copies += start == 0
            ids += piece
        got.append((i, n, copies, len(ids)))
        assert len(ids) == n * copies
    assert sum(c for _, _, c, _ in got) == len(data)
    assert sum(n for *_, n in got) == sum(map(len, want))
    return seqs


def test_every_id_lies_in_one_piece(spark):
    data = [*AWKWARD, *[(100 + k, f"word{k % 5} and some more text " * (k % 40)) for k in range(150)]]
    seqs = check(pack(docs(spark, data), WORD, window=256, shard_docs=20), data, 256)
    full = [sum(n for _, n in s) == 256 for s in seqs.values()]
    assert full.count(False) <= 3  # one for each partition


def test_empty_table(spark):
    assert pack(docs(spark, []), WORD).count() == 0


def test_partitions_without_rows(spark):
    data = [(1, "one text"), (2, "two texts")]
    check(pack(docs(spark, data, parts=7), WORD, window=64), data, 64)


def test_scores_are_bm25():
    texts = [[1, 2, 3, 3], [3, 4], [5, 6, 7], [1, 1, 9]]
    pool = Pool([(k, np.array(t, np.uint32), 0) for k, t in enumerate(texts)])
    got = pool.scores(0)
    mean = np.mean([len(t) for t in texts])
    for d, t in enumerate(texts):
        want = 0.0
        for term in set(texts[0]):
            df = sum(term in x for x in texts)
            tf = t.count(term)
            want += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        assert abs(got[d] - want) < 1e-9


def test_a_window_is_filled_with_neighbours(spark):
    topics = ["red apple pear plum", "iron steel copper tin", "river lake sea ocean"]
    data = [(k, " ".join([topics[k % 3]] * 12)) for k in range(30)]
    df = pack(docs(spark, data, parts=1), WORD, window=250)
    groups = defaultdict(set)
    for r in df.collect():
        groups[r.sequence_id].add(r.doc_id % 3)
    assert sum(len(g) == 1 for g in groups.values()) >= len(groups) / 2


def test_neighbours_meet_from_anywhere_in_the_input(spark):
    """Thirty topics in turn: no shard of the input order holds a topic twice, the routed ones do."""
    data = [(k, " ".join(f"topic{chr(97 + k % 30)}{chr(97 + j)}{k % 30}" for j in range(12))) for k in range(600)]
    frame = docs(spark, data, parts=1).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id")
    seqs = defaultdict(list)
    for r in pack(frame, WORD, window=400, shard_docs=30).collect():
        seqs[r.sequence_id].append(r.doc_id % 30)
    pairs = [a == b for s in seqs.values() for a, b in zip(s, s[1:])]
    assert sum(pairs) > len(pairs) / 2


def test_routes_are_the_nearest_leaders():
    draw = np.random.default_rng(3)
    docs_ = [draw.integers(0, 60, draw.integers(1, 40)).astype(np.uint32) for _ in range(30)]
    lead = Leaders(docs_[:12], most=8)
    docs_ += [np.array([70, 99], np.uint32), np.array([], np.uint32)]  # no term of any leader
    got = lead.routes(np.concatenate(docs_), np.array([len(x) for x in docs_]))
    for x, route in zip(docs_, got):
        terms, counts = np.unique(x, return_counts=True)
        near = np.zeros(8)
        for t, c in zip(terms, counts):
            if t < len(lead.row) and lead.row[t] >= 0:
                near += lead.idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / lead.mean)) * lead.profile[lead.row[t]]
        best = [int(route) >> s & 0xFFFF for s in (32, 16, 0)]
        assert len(set(best)) == 3
        assert np.allclose(near[best], np.sort(near)[::-1][:3], atol=1e-4)
