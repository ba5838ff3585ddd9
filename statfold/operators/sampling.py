"""Splits, samples, folds, batches and positional slices (SPL*, SRC5-7).

Randomness is a hash of (seed, id), never ``rand()``: the same rows are
chosen for any partitioning and on recomputation after a lost executor.
Exact sizes come from the row at the cut, found by counting buckets of the
order key (:mod:`statfold.operators.select`): rows are then only filtered.
Where equal rows lie on both sides of a cut, or the key is not numeric, rows
get global positions instead (:mod:`statfold.operators.position`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.functions.hashing import hash_uniform
from statfold.operators.position import with_group_rank, with_position
from statfold.operators.select import blocks, first_rows


def with_hash_order(df: DataFrame, id_col: str, seed: int, col: str = "_u") -> DataFrame:
    return df.withColumn(col, hash_uniform(seed, id_col))


def exact_split(df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 42,
                out: str = "split") -> DataFrame:
    """SPL1: shuffled split with exactly ``ceil(test_size * n)`` test rows.

    Rows are ordered by ``(md5 uniform, id)``; the first ``n_test`` positions
    are the test set.
    """
    u = with_hash_order(df, id_col, seed)
    cut = blocks(u, ["_u", id_col], lambda n: [math.ceil(float(test_size) * n)], out)
    if cut is not None:
        return cut.withColumn(out, F.when(F.col(out) == 0, F.lit("test")).otherwise(F.lit("train"))).drop("_u")
    pos = with_position(u, ["_u", id_col], "_pos")
    n = pos.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    joined = pos.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    return (joined.withColumn(out, F.when(F.col("_pos") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_u", "_pos", "_n", "_one"))


def bernoulli_split(df: DataFrame, id_col: str, probs: Sequence[float] = (0.7, 0.3),
                    names: Sequence[str] = ("train", "test"), seed: int = 42, out: str = "split") -> DataFrame:
    """SPL2: independent draw per row with the given probabilities."""
    u = hash_uniform(seed, id_col)
    expr = None
    edge = 0.0
    for p, nm in zip(probs[:-1], names[:-1]):
        edge += p
        expr = (F.when(u < edge, F.lit(nm)) if expr is None else expr.when(u < edge, F.lit(nm)))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return df.withColumn(out, expr)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42, topk_limit: int = 100_000) -> DataFrame:
    """SPL3 / TXT14: simple random sample of ``n`` rows without replacement.

    Small ``n``: a top-k on the hash (no full sort). Large ``n``: the row at the cut.
    """
    u = with_hash_order(df, id_col, seed)
    if n <= topk_limit:
        return u.orderBy("_u", id_col).limit(n).drop("_u")
    cut = first_rows(u, ["_u", id_col], lambda _: [n])
    if cut is not None:
        return u.where(cut[0]).drop("_u")
    return with_position(u, ["_u", id_col], "_pos").where(F.col("_pos") <= n).drop("_u", "_pos")


def _block_of(pos, n, k):
    """Index of the contiguous block of ``pos`` when n rows are cut in k folds
    (the first ``n % k`` folds are one row longer, as in KFold)."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1))).otherwise(r + F.floor((pos - 1 - big) / q)).cast("int")


def kfold(df: DataFrame, id_col: str, k: int = 10, mode: str = "shuffled", seed: int = 42,
          label: str | None = None, out: str = "fold") -> DataFrame:
    """SPL4: fold column for ``CrossValidator(foldCol=...)``.

    ``shuffled``: contiguous blocks of the hash order; ``contiguous``: blocks
    of the id order; ``stratified``: round-robin over positions within each
    class (in hash order), so every fold has the class mix.
    """
    if mode == "stratified":
        if not label:
            raise ValueError("stratified folds need a label column")
        u = with_hash_order(df, id_col, seed)
        ranked = with_group_rank(u, [label], ["_u", id_col], "_r")
        return ranked.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_u", "_r")
    order = ["_u", id_col] if mode == "shuffled" else [id_col]
    base = with_hash_order(df, id_col, seed) if mode == "shuffled" else df
    cut = blocks(base, order, lambda n: [n // k * (i + 1) + min(i + 1, n % k) for i in range(k - 1)], out)
    if cut is not None:
        return cut.drop("_u")
    pos = with_position(base, order, "_pos")
    n = pos.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    joined = pos.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    return joined.withColumn(out, _block_of(F.col("_pos"), F.col("_n"), k)).drop("_u", "_pos", "_n", "_one")


def batches(df: DataFrame, id_col: str, size: int, shuffle: bool = False, seed: int = 42,
            out: str = "batch") -> DataFrame:
    """SPL5: batch id = floor((position - 1) / size), sequential or shuffled order."""
    base = with_hash_order(df, id_col, seed) if shuffle else df
    order = ["_u", id_col] if shuffle else [id_col]
    pos = with_position(base, order, "_pos")
    return pos.withColumn(out, F.floor((F.col("_pos") - 1) / size).cast("long")).drop("_u", "_pos")


def prefix_percent(df: DataFrame, order_by: Sequence[str], percent: float, rounding: str = "floor") -> DataFrame:
    """SRC5: the first ``percent`` % of rows under ``order_by`` (1 <= p <= 100).

    ``rounding='floor'`` keeps ``floor(n * p / 100)`` rows; ``'closest'``
    rounds half to even as Python's ``round``.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be within 1..100")
    whole = (lambda n: math.floor(n * float(percent) / 100)) if rounding == "floor" else (lambda n: round(n * float(percent) / 100))
    cut = first_rows(df, order_by, lambda n: [whole(n)])
    if cut is not None:
        return df.where(cut[0])
    pos = with_position(df, list(order_by), "_pos")
    n = pos.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    raw = F.col("_n") * F.lit(float(percent)) / 100
    bound = F.floor(raw) if rounding == "floor" else F.bround(raw, 0)
    joined = pos.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    return joined.where(F.col("_pos") <= bound).drop("_pos", "_n", "_one")


def prefix_slices(df: DataFrame, order_by: Sequence[str], bounds: dict[str, tuple[int, int]],
                  out: str = "slice") -> DataFrame:
    """SRC6: positional slices ``[lo, hi)`` (0-based) after any filter."""
    flat = [b for pair in bounds.values() for b in pair]
    cut = first_rows(df, order_by, lambda n: flat)
    if cut is not None:
        expr = F.lit(None).cast("string")
        for i, name in reversed(list(enumerate(bounds))):
            expr = F.when(cut[2 * i + 1] & ~cut[2 * i], F.lit(name)).otherwise(expr)
        return df.withColumn(out, expr).where(F.col(out).isNotNull())
    pos = with_position(df, list(order_by), "_pos")
    expr = None
    for name, (lo, hi) in bounds.items():
        cond = (F.col("_pos") > lo) & (F.col("_pos") <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return pos.withColumn(out, expr).where(F.col(out).isNotNull()).drop("_pos")


def split_frames(df: DataFrame, col: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """SRC7: one frame per split value (each a filter over the same scan)."""
    return {nm: df.where(F.col(col) == nm) for nm in names}
