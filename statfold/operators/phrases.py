"""Names mined from the texts themselves (TXT9, AGG15): no list and no pattern says what they are.

Candidates are runs of ``2..MAX_WORDS`` capitalised words. Over the whole corpus a candidate is kept if it stands in
enough documents and its words belong together: for every way to cut it in two, the parts meet far more often than
their own counts would let them (normalised pointwise mutual information). A candidate that mostly stands inside one
longer name is a part of it. Texts are then tagged with the names found, the longest at each place.

Counts are plain groupings, map-side first; the phrase table is as long as the corpus has repeated candidates and is
joined by shuffle unless it is counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statfold.session import broadcast_if_small, cut_lineage

MAX_WORDS = 4
MIN_DOCS = 3
MIN_NPMI = 0.3
PART_SHARE = 0.8   # a candidate is part of a longer one that makes up this share of it

RUN = r"\p{Lu}[\p{L}\p{N}]*(?:[ \t]+\p{Lu}[\p{L}\p{N}]*)+"
WORD = r"[\p{L}\p{N}]+"


def _runs(text: str) -> Column:
    """Arrays of lower-cased words, one for each run of capitalised words."""
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(RUN), 0), lambda r: F.split(F.lower(r), r"[ \t]+"))


def _grams(words: Column, least: int = 2) -> Column:
    """(place, words, phrase) of all stretches of ``least..MAX_WORDS`` different words."""
    def of(n: int) -> Column:
        last = F.size(words) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(n).alias("n"), F.slice(words, i + 1, n).alias("w")))
    found = F.concat(*[of(n) for n in range(least, MAX_WORDS + 1)])
    return F.transform(F.filter(found, lambda g: F.size(F.array_distinct(g["w"])) == g["n"]),
                       lambda g: F.struct(g["place"].alias("place"), g["n"].alias("n"), F.array_join(g["w"], " ").alias("phrase")))


def candidate_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(phrase, n_words, n, docs): how often each candidate stands in the texts, and in how many of them.

    Rows with one key are one document; null texts have no candidates.
    """
    runs = docs.select(F.col(key).alias("_k"), F.explode(_runs(text)).alias("_r"))
    each = runs.select("_k", F.explode(_grams(F.col("_r"))).alias("g")).select("_k", "g.n", "g.phrase")
    per_doc = each.groupBy("phrase", "n", "_k").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("phrase", F.col("n").alias("n_words")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


def mine_phrases(docs: DataFrame, key: str, text: str, min_docs: int = MIN_DOCS, min_npmi: float = MIN_NPMI) -> DataFrame:
    """(phrase, n_words, n, docs, npmi): the candidates whose words belong together, parts of longer ones left out."""
    counts = cut_lineage(candidate_counts(docs, key, text).where(F.col("docs") >= min_docs))
    words = (docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)).alias("part"))
             .groupBy("part").agg(F.count(F.lit(1)).alias("m")))
    wanted = counts.select(F.explode(F.array_distinct(F.split("phrase", " "))).alias("part")).distinct()
    total = docs.agg(F.sum(F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0))).cast("long").alias("total"))
    # counts of every part a phrase is cut into: single words, and shorter candidates
    parts = cut_lineage(words.join(wanted, "part", "left_semi").unionByName(
        counts.select(F.col("phrase").alias("part"), F.col("n").alias("m"))))
    w = F.split("phrase", " ")
    cuts = counts.withColumn("w", w).select("phrase", "n_words", "n", "docs", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.struct(
            F.array_join(F.slice("w", F.lit(1), k), " ").alias("a"),
            F.array_join(F.slice("w", k + 1, F.col("n_words") - k), " ").alias("b")))).alias("c")).select(
        "phrase", "n_words", "n", "docs", "c.a", "c.b")
    small = broadcast_if_small(parts)
    met = (cuts.join(small.select(F.col("part").alias("a"), F.col("m").alias("ma")), "a")
           .join(small.select(F.col("part").alias("b"), F.col("m").alias("mb")), "b").join(F.broadcast(total)))
    scored = met.withColumn("npmi", F.log(F.col("n") * F.col("total") / (F.col("ma") * F.col("mb"))) /
                            -F.log(F.col("n") / F.col("total")))
    kept = cut_lineage(scored.groupBy("phrase", "n_words", "n", "docs").agg(F.min("npmi").alias("npmi"))
                       .where(F.col("npmi") >= min_npmi))
    inner = kept.select(F.col("n").alias("outer_n"), F.col("phrase").alias("outer"), F.explode(F.array_distinct(
        F.transform(_grams(F.split("phrase", " ")), lambda g: g["phrase"]))).alias("phrase")).where("phrase <> outer")
    most = inner.groupBy("phrase").agg(F.max("outer_n").alias("outer_n"))
    return kept.join(most, "phrase", "left").where(
        F.coalesce("outer_n", F.lit(0)) < PART_SHARE * F.col("n")).drop("outer_n")


def tag_phrases(docs: DataFrame, key: str, text: str, phrases: DataFrame, label: str = "NAME") -> DataFrame:
    """(key, label, entity) of every place in the texts where a phrase stands; of overlapping ones the first, then longest."""
    runs = docs.select(F.col(key).alias("_k"), F.posexplode(_runs(text)).alias("_at", "_r"))
    places = runs.select("_k", "_at", F.xxhash64("_k", "_r").alias("_h"), F.explode(_grams(F.col("_r"))).alias("g")).select(
        "_k", "_at", "_h", "g.place", "g.n", "g.phrase")
    hits = places.join(broadcast_if_small(phrases.select("phrase")), "phrase", "left_semi")
    rows = hits.groupBy("_k", "_at", "_h").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("n")).alias("less"), "phrase"))).alias("h"))
    none = F.array().cast("array<string>")
    chosen = F.aggregate("h", F.struct(F.lit(0).alias("end"), none.alias("got")), lambda s, x: F.when(
        x["place"] >= s["end"], F.struct((x["place"] - x["less"]).alias("end"), F.array_append(s["got"], x["phrase"]).alias("got"))
    ).otherwise(s), lambda s: s["got"])
    return rows.select(F.col("_k").alias(key), F.lit(label).alias("label"), F.explode(chosen).alias("entity"))
