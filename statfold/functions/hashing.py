"""Reproducible pseudo-random numbers from row ids.

``rand()`` depends on partitioning and is not reproducible across engines.
Instead a uniform in [0, 1) is derived from the first 32 bits of
``md5(seed || '|' || id)``; DuckDB computes the same value with
``('0x' || substr(md5(...), 1, 8))::BIGINT / 4294967296.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))]
    for p in parts:
        cols += [F.lit("|"), (p if isinstance(p, Column) else F.col(p)).cast("string")]
    return F.concat(*cols)


def hash_uniform(seed, *parts) -> Column:
    """Uniform [0,1) from ``md5(seed|part1|part2...)``; same in DuckDB."""
    hexs = F.substring(F.md5(_key(seed, *parts)), 1, 8)
    return F.conv(hexs, 16, 10).cast("double") / F.lit(4294967296.0)


def hash_u32(seed, *parts) -> Column:
    """The same 32 bits as a long, for exact integer draws."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("long")


def hash_bit(seed, id_col) -> Column:
    """0/1 flag with probability one half."""
    return (hash_uniform(seed, id_col) < 0.5).cast("int")


def sql_hash_uniform(seed, *parts: str) -> str:
    """DuckDB text of :func:`hash_uniform` (for oracle SQL)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / 4294967296.0)"


def hash_digest(seed, *parts) -> Column:
    """One md5 per row; its four 32-bit windows are four independent draws."""
    return F.md5(_key(seed, *parts))


def digest_u32(digest: Column, k: int) -> Column:
    """Window ``k`` (0..3) of a digest as an unsigned 32-bit long."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def digest_uniform(digest: Column, k: int) -> Column:
    return digest_u32(digest, k).cast("double") / F.lit(4294967296.0)


def sql_digest_u32(seed, k: int, *parts: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5({inner}), {8 * k + 1}, 8))::BIGINT"
