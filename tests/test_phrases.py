from statfold.operators import phrases


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


FILLER = ["The sun rose over the hills and the river ran on.", "A man went to the market with his dog.",
          "Rain fell on the old roof all night long.", "It is not clear who wrote the report."]
TEXTS = [*FILLER * 5, "We met Maria Lopez in New York City today.", "Maria Lopez said that New York City is large.",
         "In New York City they saw Maria Lopez again.", "Then Maria Lopez left New York City.", "Maria Lopez, and New York.",
         "The Man Went home. The Man Went on.", None, "", "Go Go Go Go Go Go Go Go"]


def test_names_that_no_pattern_lists(spark):
    docs = _docs(spark, TEXTS)
    got = {r["phrase"]: (r["n_words"], r["n"], r["docs"]) for r in phrases.mine_phrases(docs, "id", "text").collect()}
    assert got == {"maria lopez": (2, 4 + 1, 5), "new york city": (3, 4, 4)}


def test_candidates_by_hand(spark):
    docs = _docs(spark, ["Ab Cd Ef gh Ij Kl. Ab  Cd", "Ab Cd", "Xx Xx Xx", "ab cd", None])
    got = {tuple(r) for r in phrases.candidate_counts(docs, "id", "text").collect()}
    assert got == {("ab cd", 2, 3, 2), ("cd ef", 2, 1, 1), ("ab cd ef", 3, 1, 1), ("ij kl", 2, 1, 1)}


def test_the_longest_name_at_each_place(spark):
    docs = _docs(spark, ["Dear New York City Council Board, hello", "New York City New York", "York City Council", "no names", None])
    known = spark.createDataFrame([("new york",), ("new york city",), ("york city council",), ("council board",)], "phrase string")
    got = sorted((r["id"], r["entity"]) for r in phrases.tag_phrases(docs, "id", "text", known).collect())
    assert got == [(0, "council board"), (0, "new york city"), (1, "new york"), (1, "new york city"), (2, "york city council")]


def test_no_texts(spark):
    docs = _docs(spark, ["x"]).where("id < 0")
    assert phrases.mine_phrases(docs, "id", "text").count() == 0
    known = spark.createDataFrame([("a b",)], "phrase string")
    assert phrases.tag_phrases(docs, "id", "text", known).count() == 0
