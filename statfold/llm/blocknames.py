"""Exact copies by block naming.

Normalised texts are cut into fixed-size blocks. The distinct blocks are sorted, and a block's place in
that order is its integer name; adjacent names are paired, the distinct pairs sorted and named, and so on
until each document has one name. Names are assigned by comparing contents, so two documents have the same
name exactly if their texts are equal. Documents whose vector of 64-bit block keys occurs once can have no
copy (equal texts have equal keys); only the others carry text through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statfold.llm.common import ascii_lower, cut_pieces
from statfold.operators.position import with_position
from statfold.session import broadcast_if_small, cut_lineage

BLOCK_CHARS = 4096


def _blocks(norm: Column, block: int) -> Column:
    """The text's fixed-size blocks; an empty text has one empty block."""
    return cut_pieces(norm, block)


def _named(rows: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``name``: the place of the key columns among their distinct values, sorted."""
    names = with_position(rows.select(*keys).distinct(), keys, "name", partitions)
    return rows.join(names, keys)


def exact_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): every document's id and digest, and of those that may have copies their text's name.

    ``rows`` has id and sha for every input row; ``groups`` has id, sha, copies (equal rows) and identity for
    each different (id, sha) whose block keys are not unique.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keyed = rows.select("id", "norm", F.sha2("norm", 256).alias("sha"),
                        F.xxhash64(F.length("norm"), F.transform(_blocks(F.col("norm"), block_chars),
                                                                 lambda b: F.xxhash64(b))).alias("vector"))
    light = cut_lineage(keyed.select("id", "sha", "vector"))
    shared = broadcast_if_small(cut_lineage(light.groupBy("vector").count().filter("count > 1").select("vector")))
    copies = light.join(shared, "vector", "left_semi").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    # one text for each (id, sha): repeated rows need no second one
    text = keyed.join(shared, "vector", "left_semi").select("id", "sha", "norm")
    level = cut_lineage(text.select("id", "sha", F.posexplode(_blocks(F.col("norm"), block_chars)).alias("k", "block"))
                        .dropDuplicates(["id", "sha", "k"]))
    names = with_position(level.select("block").distinct(), "block", "name")
    level = cut_lineage(level.join(names, "block").select("id", "sha", "k", "name"))
    most = level.agg(F.max("k")).first()[0]
    while most:  # log2 of the longest document's blocks
        pairs = (level.groupBy("id", "sha", F.shiftright("k", 1).alias("k2"))
                 .agg(F.max(F.when(F.col("k") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("k") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")))
        level = cut_lineage(_named(pairs, ["a", "b"]).select("id", "sha", F.col("k2").alias("k"), "name"))
        most //= 2
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.sha") == F.col("r.sha"))
    groups = copies.alias("l").join(level.alias("r"), same).select(
        "l.id", "l.sha", "l.copies", F.col("r.name").alias("identity"))
    return light.select("id", "sha"), groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is less than any other). Rows that share both id and text are one
    document given twice: all of them carry ``kept`` if it stays, and each counts in ``group_size``. An
    empty table gives no rows; extra columns are ignored.
    """
    rows, groups = exact_names(docs, id_col, text_col, block_chars)
    groups = cut_lineage(groups)
    best = groups.groupBy("identity").agg(F.max("id").alias("keep"), F.sum("copies").alias("size"))
    found = groups.select("id", "sha", "identity").join(best, "identity").select("id", "sha", "keep", "size")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.sha") == F.col("r.sha"))
    keep = F.when(F.col("size").isNull(), F.col("l.id")).otherwise(F.col("keep"))
    return (rows.alias("l").join(found.alias("r"), same, "left")
            .select(F.col("l.id").alias(id_col), keep.alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    F.col("l.id").eqNullSafe(keep).alias("kept"), F.col("l.sha").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without exact copies: of equal texts the one with the largest id stays.

    Rows that share id and text too are cut to one. Which rows go is decided by ``exact_dedup``.
    """
    decided = cut_lineage(exact_dedup(docs, id_col, text_col))
    gone = decided.filter(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha"))
    gone = broadcast_if_small(cut_lineage(gone.distinct()))
    sha = F.sha2(ascii_lower(F.col(text_col)), 256)
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
    again = decided.filter("kept").groupBy(id_col, "text_sha256").count().filter("count > 1")
    if again.limit(1).count():
        left = left.withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
    return left
