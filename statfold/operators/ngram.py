"""Bigram language model with add-k smoothing and perplexity (TXT11, TXT12).

Counting is ``explode`` + ``groupBy``; scoring joins each document's bigrams
to the bigram and unigram count tables on their keys (shuffle joins, so the
model may be as large as the corpus); the vocabulary size is a one-row
aggregate broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.operators.text import words
from statfold.session import cut_lineage


def _bigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    toks = docs.select(key, words(text).alias("_t"))
    pairs = toks.select(key, F.explode(F.arrays_zip(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))).alias("w1"),
                                                    F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))).alias("w2")))
                        .alias("b"))
    return pairs.select(key, "b.w1", "b.w2")


def fit_bigram(train: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts: bigrams (w1, w2, c12), context unigrams (w1, c1), vocabulary size (one row).

    The training text is tokenised once: every token is paired with its
    successor (null after a document's last token), so one aggregate holds
    the bigram counts and, through ``w1``, every word of the vocabulary. That
    aggregate is the fitted model; it is written once to the shared folder
    and the three tables are read from it.
    """
    t = F.col("_t")
    nxt = F.concat(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    toks = train.select(words(text).alias("_t"))
    pairs = (toks.select(F.explode(F.arrays_zip(t.alias("w1"), nxt.alias("w2"))).alias("b"))
             .select("b.w1", "b.w2").where(F.col("w1").isNotNull()))
    model = cut_lineage(pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c12")))
    bi = model.where(F.col("w2").isNotNull())
    ctx = bi.groupBy("w1").agg(F.sum("c12").alias("c1"))
    vocab = model.agg(F.count_distinct("w1").alias("V"))
    return bi, ctx, vocab


def perplexity(test: DataFrame, key: str, text: str, model, k: float = 1.0) -> DataFrame:
    """TXT11 / TXT12: per-document nll, bigram count and perplexity = exp(nll / count)."""
    bi, ctx, vocab = model
    b = _bigrams(test.select(key, text), key, text)
    j = (b.join(bi, ["w1", "w2"], "left").join(ctx, "w1", "left")
         .withColumn("_one", F.lit(1)).join(F.broadcast(vocab.withColumn("_one", F.lit(1))), "_one"))
    logp = F.log((F.coalesce("c12", F.lit(0)) + k) / (F.coalesce("c1", F.lit(0)) + k * F.col("V")))
    per = j.groupBy(key).agg((-F.sum(logp)).alias("nll"), F.count(F.lit(1)).alias("bigrams"))
    return per.withColumn("perplexity", F.exp(F.col("nll") / F.col("bigrams")))


def corpus_perplexity(per_doc: DataFrame) -> DataFrame:
    """TXT11: exp(mean token loss) over the whole evaluation corpus."""
    return per_doc.agg(F.exp(F.sum("nll") / F.sum("bigrams")).alias("perplexity"),
                       F.sum("bigrams").alias("bigrams"), F.count(F.lit(1)).alias("documents"))
