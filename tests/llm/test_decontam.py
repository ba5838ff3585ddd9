import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from statfold.llm.decontam import Index, _search, contaminated, drop_contaminated, overlaps, question_answer, words
from tests.llm.helpers import AWKWARD, docs, rows


def brute(texts, items):
    """Every passage against every item."""
    kept = [(k, words(t), question_answer(t)) for k, t in items if words(t)]
    half = max((len(ws) for _, ws, _ in kept), default=1)
    out = {}
    for r, text in enumerate(texts):
        ws = words(text)
        for j in range(len(ws) // half + 2):
            passage = ws[max(0, j - 1) * half:(j + 1) * half]
            for k, own, parts in kept:
                got = overlaps(passage, own, *parts)
                if got and passage and got > out.get((r, k), (0,)):
                    out[r, k] = got
    return out


def search(texts, items):
    index = Index(items)
    return {(r, index.keys[i]): s for (r, i), s in _search(index, pa.array(texts, pa.string())).items()}


def _corpus(rng, n):
    vocab = [f"w{k}" for k in range(120)] + ["the", "of", "and"] * 30
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    items = [(k, " ".join(sentence(rng.randint(1, 12)) for _ in range(rng.randint(1, 4)))) for k in range(n)]
    texts = []
    for _ in range(80):
        parts = [sentence(rng.randint(3, 15)) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.7:
            ws = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                ws[rng.randrange(len(ws))] = "changed"
            parts.insert(rng.randrange(len(parts) + 1), " ".join(ws))
        texts.append(" ".join(parts))
    return texts, items


def test_search_equals_brute_force():
    for seed in range(4):
        texts, items = _corpus(random.Random(seed), 50)
        got = search(texts, items)
        assert got == brute(texts, items)
        assert got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef."), max_size=14).map(" ".join), max_size=4),
       st.lists(st.lists(st.sampled_from("abcdef."), max_size=9).map(" ".join), max_size=4))
def test_any_words(texts, items):
    items = list(enumerate(items))
    assert search(texts, items) == brute(texts, items) if texts else True


def _items(spark, data):
    return spark.createDataFrame(data, "item_id long, text string, row long, doc string")


def test_awkward_rows(spark):
    leak = "What is the capital of the land far away? It is the town by the sea."
    items = _items(spark, [(1, leak, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "...", 0, ""), (1, leak, 0, "")])
    data = [*AWKWARD, (30, f"before {leak.upper()} after"), (None, leak), (31, leak[:40]), (32, "filler words " * 9000 + leak)]
    got = rows(contaminated(docs(spark, data), items), "doc_id", "item_id", "similarity")
    assert got == sorted([(30, 1, 1.0), (None, 1, 1.0), (32, 1, 1.0)] * 2, key=str)
    left = drop_contaminated(docs(spark, data), items)
    assert left.columns == docs(spark, data).columns and left.count() == len(data) - 3


def test_empty_tables(spark):
    none = _items(spark, [])
    assert contaminated(docs(spark, [(1, "a")]), none).count() == 0
    assert contaminated(docs(spark, []), _items(spark, [(1, "a b", 0, "")])).count() == 0
    assert drop_contaminated(docs(spark, [(1, "a")]), none).count() == 1


def test_question_and_answer():
    assert question_answer("One two. Three four!") == (["one", "two"], ["three", "four"])
    assert question_answer("a b c d e") == (["a", "b", "c", "d"], ["e"])
    assert question_answer("?!") == ([], [])


def test_near_copies_of_four_fifths_are_leaks(spark):
    """One word changed, or the last one left out: the item's own shingle share decides, counted here by itself."""
    def grams(ws):
        return {" ".join(ws[k:k + 5]) for k in range(len(ws) - 4)}

    items, data, want = [], [], []
    for i in range(12):
        own = [f"t{i}x{k}" for k in range(26 + i)]
        items.append((i, " ".join([*own[:10], own[10] + ".", *own[11:-1]]) + f". {own[-1]}.", 0, ""))
        for n, changed in enumerate([own[:-1], *[[*own[:k], "other", *own[k + 1:]] for k in range(len(own))]]):
            doc = 1000 * i + n
            data.append((doc, " ".join(["before", *changed, "after"])))
            share = len(grams(own) & grams(changed)) / len(grams(own))
            if share >= 0.8:
                want.append((doc, i, round(share, 9)))
    found = contaminated(docs(spark, data), _items(spark, items))
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in found.collect()) == sorted(want)
    assert drop_contaminated(docs(spark, data), _items(spark, items)).count() == len(data) - len(want)
    without = {r.doc_id: r.answer_overlap for r in found.collect()}
    assert without[0] == 0.0 and without[2] == 1.0  # the answer is left out; a word of the question is changed


def test_an_index_grows_with_its_text():
    """Thousands of items with terms of their own: no table of terms by blocks is made."""
    import pickle

    def size(n):
        rng = random.Random(1)
        items = [(k, " ".join(["the of and", *[f"w{rng.randrange(20 * n)}" for _ in range(30)]])) for k in range(n)]
        index = Index(items)
        text = " ".join(["before", items[n // 2][1], "after"])
        assert n // 2 in {index.keys[i] for _, i in _search(index, pa.array([text], pa.string()))}
        return len(pickle.dumps(index)) / sum(len(t) for _, t in items)
    small, large = size(500), size(8000)
    assert large < 1.5 * small and large < 12
