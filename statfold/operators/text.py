"""Text operators (TXT1-9, TXT13-15, AGG15) as JVM string functions and DataFrame plans.

Regex notes (Python vs Java): Python ``\\s`` on ``str`` is Unicode-aware and
also covers ``\\x1c-\\x1f``; Java needs ``(?U)`` plus that range. Python ``.``
excludes only ``\\n``; Java needs ``(?d)`` for the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.functions import arrays
from statfold.operators.position import with_group_rank, with_position
from statfold.session import broadcast_if_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- normalisers

def normalize_contract(text) -> Column:
    """TXT1, in order: non-ASCII runs -> space, lower, ``---+`` -> space, CR/LF/TAB -> space,
    whitespace runs -> one space and strip, then stand-alone numbers removed (double spaces stay)."""
    t = F.lower(F.regexp_replace(_c(text), r"[^\x00-\x7F]+", " "))
    t = F.regexp_replace(t, r"---+", " ")
    t = F.regexp_replace(t, r"[\n\r\t]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^\s+|\s+$", "")
    return F.regexp_replace(t, r"\b\d+\b", "")


_PY_SPACE = r"\s\x1c-\x1f"


def clean_prompt(text, max_len: int = 500) -> Column:
    """TXT2: collapse 3+ repeats of a character to one, keep ``[a-zA-Z0-9\\s.,!?']``,
    strip, cut to ``max_len`` characters (Python semantics of ``.`` and ``\\s``)."""
    t = F.regexp_replace(_c(text), r"(?d)(.)\1{2,}", "$1")
    t = F.regexp_replace(t, rf"(?U)[^a-zA-Z0-9{_PY_SPACE}.,!?']", "")
    t = F.regexp_replace(t, rf"(?U)^[{_PY_SPACE}]+|[{_PY_SPACE}]+$", "")
    return F.substring(t, 1, max_len)


# Phrases removed with URLs from uploaded judgments.
REMOVED_PHRASES = ["Indian Kanoon"]


def remove_urls(text, phrases: Sequence[str] = REMOVED_PHRASES) -> Column:
    """TXT3: drop ``https?://\\S+``, ``www.\\S+`` and fixed phrases, case-insensitive."""
    import re
    alts = [r"https?://\S+", r"www\.\S+"] + [re.escape(p).replace("\\ ", " ") for p in phrases]
    return F.regexp_replace(_c(text), "(?iU)" + "|".join(alts), "")


def last_words(text, n: int = 300) -> Column:
    """TXT4: last n whitespace-separated words joined by one space."""
    return F.array_join(arrays.last_n(arrays.whitespace_words(text), n), " ")


def strip_prompt(reply, prompt) -> Column:
    """TXT5: remove the prompt from the start of the reply, case-insensitive."""
    r, p = _c(reply), _c(prompt)
    hit = F.lower(F.substring(r, 1, F.length(p))) == F.lower(p)
    return F.when(hit, r.substr(F.length(p) + 1, F.length(r))).otherwise(r)


def join_question_answer(question, answer, text=None) -> Column:
    """TXT6: ``question`` (or ``text`` when there is no question column value) + answer."""
    q = F.coalesce(_c(question), _c(text)) if text is not None else _c(question)
    return F.concat_ws(" ", q, _c(answer))


# ---------------------------------------------------------------- tokens and vocabulary

def words(text) -> Column:
    """Lower-cased letter/digit tokens (the tokeniser used by the vocabulary and the n-gram model)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


# Reserved token ids (padding, unknown, start, end).
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3


def build_vocabulary(docs: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """Word -> id by descending frequency (ties by word); ids start after the reserved ones.

    Numbering uses global positions, so a large vocabulary never passes
    through one task.
    """
    w = docs.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    w = w.where(F.col("n") >= min_count)
    pos = with_position(w, [F.col("n").desc(), F.col("word")], "_pos")
    return pos.select("word", (F.col("_pos") + END_ID).cast("int").alias("token_id"), "n")


def encode(docs: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int = 512,
           left_pad: bool = False) -> DataFrame:
    """TXT7 / TXT8: ids by vocabulary, keep the last ``max_len - 2``, add start/end, pad; attention mask.

    Every text is tokenised whole; only the tokens the output keeps (the last
    ``max_len - 2``) are exploded with their position, looked up in the
    vocabulary (unknown -> UNK) and regrouped per document in order. The
    vocabulary is broadcast while it is small (counted), so frequent words
    never pile up in one join task; a larger one goes to a shuffle join.
    """
    body_len = max_len - 2
    toks = docs.select(key, words(text).alias("_w"))
    toks = toks.select(key, F.size("_w").alias("n_tokens"), arrays.last_n(F.col("_w"), body_len).alias("_w"))
    tok = toks.select(key, "n_tokens", F.posexplode_outer("_w").alias("i", "word"))
    ids = tok.join(broadcast_if_small(vocab.select("word", "token_id")), "word", "left").select(
        key, "n_tokens", F.when(F.col("i").isNotNull(), F.struct(
            "i", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id"))).alias("_e"))
    grouped = ids.groupBy(key, "n_tokens").agg(F.sort_array(F.collect_list("_e")).alias("_s"))   # no comparing lambda
    seq = grouped.select(key, "n_tokens", F.transform("_s", lambda s: s["token_id"]).alias("_ids"))
    framed = F.concat(F.array(F.lit(START_ID)), F.col("_ids"), F.array(F.lit(END_ID)))
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(framed))
    padded = F.concat(pad, framed) if left_pad else F.concat(framed, pad)
    out = seq.select(key, "n_tokens", F.slice(padded, 1, max_len).alias("input_ids"))
    return out.withColumn("attention_mask", attention_mask("input_ids"))


def attention_mask(ids) -> Column:
    """TXT8."""
    return F.transform(_c(ids), lambda x: (x > 0).cast("int"))


# ---------------------------------------------------------------- entities

# Entity rules (label, pattern) standing in for the statistical NER model.
ENTITY_RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("URL", r"https?://[^\s\"<>]+"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("CARD_NUMBER", r"[0-9]{16}"),
    ("LICENSE", r"(?i)licen[cs]e[^.\n]*"),
]


def entities(docs: DataFrame, key: str, text: str, rules=ENTITY_RULES) -> DataFrame:
    """TXT9: (doc, label, lower-cased entity) for every rule match."""
    parts = [F.struct(F.lit(lbl).alias("label"), F.regexp_extract_all(F.col(text), F.lit(pat), 0).alias("hits"))
             for lbl, pat in rules]
    e = docs.select(key, F.explode(F.array(*parts)).alias("r")).select(key, "r.label", F.explode("r.hits").alias("entity"))
    return e.select(key, "label", F.lower("entity").alias("entity"))


def entity_sets(ents: DataFrame, key: str) -> DataFrame:
    """AGG15: sorted distinct entities per (document, label)."""
    return ents.groupBy(key, "label").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


# ---------------------------------------------------------------- extractive summary

SENTENCE = r"[^.!?\n]+[.!?]*"


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with their index: runs of text ending in ``.``, ``!`` or ``?`` (or a line end)."""
    s = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0)).alias("idx", "raw"))
    s = s.select(key, "idx", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("sentence"))
    return s.where(F.length("sentence") > 0)


def _best_sentences(max_words: int, schema: pa.Schema):
    """mapInArrow body: of (key, sentences) the sentences that go into the summary, and their words.

    Words are numbered by the batch's dictionary, so counting them is a count of whole numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, each = batch.column(1), batch.column(1).flatten()
            doc = np.repeat(np.arange(len(docs)), pc.list_value_length(docs).to_numpy())
            idx, listed = each.field("idx").to_numpy().astype(np.int64), each.field("w")
            size = pc.list_value_length(listed).to_numpy().astype(np.int64)
            codes = listed.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(each)), size)
            _, at, times = np.unique(doc[owner] * (len(codes.dictionary) + 1) + codes.indices.to_numpy(),
                                     return_inverse=True, return_counts=True)
            # rows that repeat a key share its sentence numbers, and so their sums
            _, place = np.unique(doc * (idx.max() + 1) + idx, return_inverse=True)
            score = np.bincount(place[owner], weights=times[at])[place] / size
            order = np.lexsort((idx, -score, doc))
            start = np.searchsorted(doc, np.arange(len(docs)))
            total = np.cumsum(size[order])
            total -= (total[start] - size[order][start])[doc]   # ``order`` keeps the documents in their order
            keep = np.sort(order[(total <= max_words) | (np.arange(len(order)) == start[doc])])
            picked = each.take(pa.array(keep))
            ends = np.searchsorted(doc[keep], np.arange(len(docs) + 1)).astype(np.int32)
            texts = pa.StructArray.from_arrays([picked.field("idx"), picked.field("sentence")], fields=list(schema.field(1).type.value_type))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type), pa.ListArray.from_arrays(pa.array(ends), texts).cast(schema.field(1).type),
                pa.array(np.bincount(doc[keep], weights=size[keep], minlength=len(docs)).astype(np.int64))], schema=schema)
    return run


def extractive_summary(docs: DataFrame, key: str, text: str, max_words: int = 250) -> DataFrame:
    """TXT13: highest-scoring sentences within a word budget, re-assembled in document order.

    score = (sum over the sentence's words of the word's count in the document) / words in the
    sentence (an exact rational: no float ties across engines); ties by sentence index. Sentences
    are taken greedily by score while the running word total stays within ``max_words`` (the best
    sentence is always kept).

    A document is scored where it is: its sentences are cut by column functions, texts of one key meet in one
    shuffle, and no word becomes a row. Rows with a null key take no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    cut = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0), lambda raw, i: F.struct(
        i.cast("int").alias("idx"), F.regexp_replace(raw, r"^\s+|\s+$", "").alias("sentence"))), lambda x: F.length(x["sentence"]) > 0)
    told = F.filter(F.transform(cut, lambda x: F.struct(
        x["idx"].alias("idx"), x["sentence"].alias("sentence"), words(x["sentence"]).alias("w"))), lambda x: F.size(x["w"]) > 0)
    each = docs.where(F.col(key).isNotNull()).select(key, told.alias("_s")).where(F.size("_s") > 0)
    grouped = each.groupBy(key).agg(F.flatten(F.collect_list("_s")).alias("_s"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType),
                           T.StructField("_p", T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()),
                                                                         T.StructField("sentence", T.StringType())]))),
                           T.StructField("summary_words", T.LongType())])
    out = grouped.mapInArrow(_best_sentences(max_words, to_arrow_schema(schema)), schema)
    return out.select(key, F.array_join(F.transform(F.array_sort("_p"), lambda p: p["sentence"]), " ").alias("summary"),
                      "summary_words")


# ---------------------------------------------------------------- conversation history

def conversation_history(conv: DataFrame, keep_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """TXT15: valid turns in order per conversation with cleaned text (only assistant replies are
    stored, quirk Q16).

    The position in the history is a per-conversation rank from range-partitioned
    global positions, so one very long conversation is spread over many tasks
    instead of one window partition.
    """
    from statfold.operators.clean import valid_input
    ok = conv.where(F.col("role").isin(list(keep_roles)) & valid_input(F.col("text")))
    ranked = with_group_rank(ok.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], "position")
    return ranked.select("conv_id", "turn", "role", "position", clean_prompt(F.col("text")).alias("cleaned"))
