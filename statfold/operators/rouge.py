"""ROUGE scores (TXT10) over (id, candidate, reference) pairs.

ROUGE-N counts n-grams where the pair is: tokens are cut by column functions, rows
of one key meet in one shuffle, and no n-gram becomes a row.
ROUGE-L needs a longest common subsequence per pair; that is a small
Arrow-batched helper using the bit-parallel LCS (no prefix cut, whole texts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rouge_tokens(text) -> Column:
    """``rouge-score`` tokenisation: lower case, non ``[a-z0-9]`` runs are separators."""
    t = F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"^ +| +$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _gram_counts(n: int, unique: bool, schema: pa.Schema):
    """mapInArrow body: of (key, [(candidate tokens, reference tokens)]) a row a pair: key, n-grams of either side, overlap.

    The overlap is that of all pairs of the key; n-grams never cross texts. Tokens and n-grams are numbered by batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = batch.column(1).flatten()
            group = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
            sides = [each.field("c"), each.field("r")]
            sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in sides]).astype(np.int64)
            flat = pa.chunked_array([x.flatten() for x in sides]).combine_chunks().dictionary_encode()
            code = flat.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)   # references after candidates
            left = np.cumsum(sizes)[row] - np.arange(len(row))   # tokens from here to the end of the text
            at = np.flatnonzero(left >= n)
            gram = code[at]
            for k in range(1, n):
                gram = np.unique(gram * (len(flat.dictionary) + 1) + code[at + k], return_inverse=True)[1]
            row, most = row[at], int(gram.max(initial=0)) + 1
            inside = np.unique(row * most + gram) // most if unique else row
            count = np.bincount(inside, minlength=len(sizes)).astype(np.int64)
            of_ref = row >= len(group)
            place = group[row % max(len(group), 1)] * most + gram
            (c, cc), (r, rc) = (np.unique(place[x], return_counts=True) for x in (~of_ref, of_ref))
            both, i, j = np.intersect1d(c, r, assume_unique=True, return_indices=True)
            shared = np.ones(len(both), np.int64) if unique else np.minimum(cc[i], rc[j])
            overlap = np.bincount(both // most, weights=shared, minlength=batch.num_rows).astype(np.int64)
            overlap[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0   # a null key meets nothing
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type).take(pa.array(group)), pa.array(count[:len(group)]),
                pa.array(count[len(group):]), pa.array(overlap[group])], schema=schema)
    return run


def rouge_n(pairs: DataFrame, key: str, cand: str, ref: str, n: int = 1, mode: str = "clipped") -> DataFrame:
    """Precision, recall, F per pair. ``clipped``: overlap = sum min(count_c, count_r) (``rouge-score``);
    ``unique``: overlap of n-gram sets (the ``rouge`` package)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    none = F.array().cast("array<string>")
    toks = pairs.select(key, F.struct(F.coalesce(rouge_tokens(cand), none).alias("c"), F.coalesce(rouge_tokens(ref), none).alias("r")).alias("_t"))
    grouped = toks.groupBy(key, F.when(F.col(key).isNull(), F.xxhash64("_t")).alias("_alone")).agg(F.collect_list("_t").alias("_t"))
    schema = T.StructType([T.StructField(key, pairs.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("_nc", "_nr", "_o")]])
    j = grouped.select(key, "_t").mapInArrow(_gram_counts(n, mode == "unique", to_arrow_schema(schema)), schema)
    p = F.when(F.col("_nc") > 0, F.col("_o") / F.col("_nc")).otherwise(F.lit(0.0))
    rc = F.when(F.col("_nr") > 0, F.col("_o") / F.col("_nr")).otherwise(F.lit(0.0))
    out = j.select(key, p.alias("precision"), rc.alias("recall"))
    f = F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("fmeasure", f).withColumn("rouge", F.lit(f"rouge{n}"))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence length, bit-parallel (Allison-Dix / Hyyro)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for tok in b:
        u = s & masks.get(tok, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


_TOK = re.compile(r"[^a-z0-9]+")


def _toks(t: str | None) -> list[str]:
    return [w for w in _TOK.sub(" ", (t or "").lower()).split(" ") if w]


def rouge_l(pairs: DataFrame, key: str, cand: str, ref: str, summary_level: bool = False) -> DataFrame:
    """ROUGE-L (or ``rougeLsum``: union LCS over newline-separated sentences) per pair."""

    @F.pandas_udf("struct<lcs:long,nc:long,nr:long>")
    def _lcs(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(c, r):
            if not summary_level:
                a, b = _toks(x), _toks(y)
                out.append((lcs_length(b, a), len(a), len(b)))
            else:
                cs = [_toks(s) for s in (x or "").split("\n") if _toks(s)]
                rs = [_toks(s) for s in (y or "").split("\n") if _toks(s)]
                hits = 0
                for rsent in rs:
                    union: set[int] = set()
                    for csent in cs:
                        union |= _lcs_positions(rsent, csent)
                    hits += len(union)
                out.append((hits, sum(map(len, cs)), sum(map(len, rs))))
        return pd.DataFrame(out, columns=["lcs", "nc", "nr"])

    j = pairs.select(key, _lcs(F.col(cand), F.col(ref)).alias("_l")).select(key, "_l.*")
    p = F.when(F.col("nc") > 0, F.col("lcs") / F.col("nc")).otherwise(F.lit(0.0))
    r = F.when(F.col("nr") > 0, F.col("lcs") / F.col("nr")).otherwise(F.lit(0.0))
    out = j.select(key, p.alias("precision"), r.alias("recall"))
    f = F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("fmeasure", f).withColumn("rouge", F.lit("rougeLsum" if summary_level else "rougeL"))


def _lcs_positions(ref: list, cand: list) -> set[int]:
    """Indices of ``ref`` on one LCS with ``cand`` (dynamic programming; sentence-sized inputs)."""
    m, n = len(ref), len(cand)
    table = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            table[i + 1][j + 1] = table[i][j] + 1 if ref[i] == cand[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = set(), m, n
    while i > 0 and j > 0:
        if ref[i - 1] == cand[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def corpus_mean(scores: DataFrame) -> DataFrame:
    """Mean precision / recall / F per ROUGE variant over all pairs."""
    return scores.groupBy("rouge").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                       F.avg("fmeasure").alias("fmeasure"), F.count(F.lit(1)).alias("pairs"))
