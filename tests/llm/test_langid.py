from pyspark.sql import functions as F

from statfold.llm.langid import drop_unknown, fit, held_out, identify, ngram_counts
from tests.llm.helpers import AWKWARD, docs, rows

from ..conftest import SF_SMALL


def _table(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_held_out_accuracy(spark):
    d = _table(spark)
    model = fit(d.filter(~held_out()))
    got = identify(d, model).join(d.select("doc_id", "lang"), "doc_id").filter(held_out())
    n, good = got.count(), got.filter("lang = lang_pred").count()
    assert n > 30 and good >= 0.95 * n
    assert got.filter("score < 0 or score > 1").count() == 0


def test_labels_are_no_input(spark):
    d = _table(spark)
    model = fit(d.filter(~held_out()))
    shuffled = d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert rows(identify(d, model), "doc_id", "lang_pred") == rows(identify(shuffled, model), "doc_id", "lang_pred")


def test_awkward_rows(spark):
    model = fit(_table(spark).filter(~held_out()))
    data = [*AWKWARD, (11, "1234 !!"), (12, "日本語")]
    got = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in identify(docs(spark, data), model).collect()}
    for i, t in data:
        if not any(c.isalpha() for c in t or ""):
            assert (i, True, True) in got
        else:
            assert any(a == i and not u for a, u, _ in got)
    left = drop_unknown(docs(spark, data), model)
    assert left.columns == docs(spark, data).columns
    assert not {r.doc_id for r in left.collect()} & {1, 2, 3, 11}


def test_nothing_to_learn_from(spark):
    model = fit(docs(spark, [(1, "abc"), (2, None)]))  # no labels
    assert rows(identify(docs(spark, [(1, "abc")]), model), "lang_pred", "score") == [("und", 0.0)]
    assert identify(docs(spark, []), model).count() == 0
    assert drop_unknown(docs(spark, [(1, "abc"), (2, "1")]), model).count() == 1


def test_a_label_with_one_row_is_learned(spark):
    train = docs(spark, [(1, "aaa bbb", "p"), (2, "ccc ddd", "q"), (3, None, "q"), (4, "77", "q")])
    got = rows(identify(docs(spark, [(5, "bbb aaa"), (6, "ddd")]), fit(train)), "doc_id", "lang_pred")
    assert got == [(5, "p"), (6, "q")]


def test_counts_ignore_what_is_no_letter():
    a, b = ngram_counts("Ab  cd!"), ngram_counts("ab, 1 cd")
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_other_scripts_are_rejected_and_short_clean_texts_kept(spark):
    d = _table(spark)
    model = fit(d.filter(~held_out()))
    odd = ["Съешь же ещё этих мягких французских булок да выпей чаю " * n for n in (1, 5, 40)] + ["漢字と仮名の文章です " * 9]
    assert model.nearest(odd)[2].all()
    clean = [" ".join(r.text.split()[:n]) for r in d.limit(60).collect() for n in (5, 30, 10_000) if len(r.text.split()) >= 5]
    assert model.nearest(clean)[2].mean() < 0.02


def test_every_row_teaches(spark):
    """No sample: 1,300 texts of one language that share nothing are all learned, whichever way they are split."""
    def word(i):
        return "".join(chr(97 + i // 26 ** j % 26) for j in range(3)) * 2
    data = [(i, f"{word(i * 13)} {word(i * 13 + 5)}", "p") for i in range(1300)] + [(9001, "zzz yyy", "q"), (9002, "zzy", "q")]
    models = [fit(docs(spark, data, parts=n)) for n in (1, 7)]
    assert (models[0].centroids == models[1].centroids).all() and (models[0].idf == models[1].idf).all()
    places = set().union(*(ngram_counts(t)[0].tolist() for _, t, lang in data if lang == "p"))
    own = models[0].centroids[[x == "p" for x in models[0].langs]]
    assert all(own[:, p].max() > 0 for p in places)
