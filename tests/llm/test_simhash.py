import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from statfold.llm import simhash
from statfold.llm.simhash import block_masks, components, drop_near_copies, links, pivot_table, pivots, simhash_components
from tests.llm.helpers import AWKWARD, docs, rows


def fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k:k + n]).encode(), 42) for k in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(data):
    fps = [fingerprint(t) for _, t in data]
    root = list(range(len(data)))
    for _ in data:
        root = [min(root[j] for j in range(len(data)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(data))]
    out = []
    for k, (i, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root[j] == root[k] and data[j][0] is not None]
        out.append((i, f"{fps[k]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


COLS = ("doc_id", "fingerprint", "component_id")


def test_awkward_rows(spark):
    base = " ".join(f"w{k}" for k in range(400))
    data = [*AWKWARD, (20, base), (21, base + " one"), (22, base.upper()), (23, "w0 w1"), (24, "a\u00a0b c\x85d e f g")]
    assert rows(simhash_components(docs(spark, data)), *COLS) == brute(data)


def test_empty_table(spark):
    assert simhash_components(docs(spark, [])).count() == 0


def test_links_span_all_close_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)  # groups are also compared in blocks
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        x = int(s)
        for _ in range(40):  # chains: each step within reach of the last only
            x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, T.StructType([T.StructField("fp", T.LongType())])).repartition(3)
    got = {r.vertex: r.root for r in components(links(df)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want, own = {}, {}
    for (s,), x in zip(signed, fps):
        want.setdefault(find(x), set()).add(s)
        own.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, own.values()))


@pytest.mark.parametrize("count", [10, 10 ** 7, 10 ** 10, 10 ** 13])
def test_some_mask_is_equal_for_close_prints(count):
    rng = np.random.default_rng(5)
    masks = block_masks(count, 4)
    for _ in range(200):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_pivots_never_discard_a_close_pair():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
    assert np.abs(pivot_table(a, pivots()) - pivot_table(b, pivots())).max() <= 4


def test_drop_keeps_the_smallest(spark):
    base = " ".join(f"w{k}" for k in range(300))
    left = drop_near_copies(docs(spark, [(5, base), (3, base), (9, base + " x"), (4, "other words here now")]))
    assert rows(left, "doc_id") == [(3,), (4,)]
