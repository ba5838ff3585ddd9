"""Over-sampling with replacement (BAL1, BAL3) and SMOTE (BAL2, in neighbors).

Draws are generated by ``spark.range`` (so the work is spread over tasks no
matter how many rows are added) and mapped to a row of the class through a
hash of (seed, draw id); the drawn rows are fetched with an equi-join on
(class, rank). All original rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statfold.functions.hashing import hash_u32
from statfold.operators.position import with_group_rank
from statfold.session import BROADCAST_MAX_ROWS


def _class_counts(df: DataFrame, label: str) -> list[tuple]:
    # One row per class: a bounded, tiny result.
    return [(r[0], int(r[1])) for r in df.groupBy(label).count().collect()]


def oversample_classes(df: DataFrame, label: str, id_col: str, targets: dict, seed: int = 42,
                       draw_col: str = "draw") -> DataFrame:
    """Add ``targets[c] - n_c`` rows drawn with replacement from class ``c``.

    Output = original rows (``draw`` null) plus the drawn copies (``draw`` =
    global draw number).
    """
    spark = df.sparkSession
    counts = dict(_class_counts(df, label))
    plan, start = [], 0
    for cls in sorted(targets, key=lambda v: (v is None, v)):
        need = int(targets[cls]) - counts.get(cls, 0)
        if need > 0 and counts.get(cls, 0) > 0:
            plan.append((cls, start, start + need, counts[cls]))
            start += need
    original = df.withColumn(draw_col, F.lit(None).cast("long"))
    if not plan:
        return original
    label_type = df.schema[label].dataType.simpleString()
    ranges = spark.createDataFrame(plan, f"_cls {label_type}, _lo long, _hi long, _nc long")
    draws = spark.range(start).withColumnRenamed("id", draw_col)
    # Range lookup against a table with one row per class (size bound = #classes).
    draws = draws.join(F.broadcast(ranges), (F.col(draw_col) >= F.col("_lo")) & (F.col(draw_col) < F.col("_hi")))
    draws = draws.select(draw_col, F.col("_cls").alias(label),
                         (hash_u32(seed, F.col(draw_col)) % F.col("_nc") + 1).alias("_r"))
    ranked = with_group_rank(df.where(F.col(label).isin([p[0] for p in plan])), [label], [id_col], "_r",
                             max_groups=len(plan))
    # The sampled classes' sizes are known, so the ranked rows are broadcast only under a proven bound;
    # otherwise a shuffle join, where AQE splits keys drawn very often (a tiny class drawn many times).
    if sum(p[3] for p in plan) <= BROADCAST_MAX_ROWS:
        ranked = F.broadcast(ranked)
    drawn = draws.join(ranked, [label, "_r"]).drop("_r")
    return original.unionByName(drawn.select(*original.columns))


def oversample_minority(df: DataFrame, label: str, id_col: str, total: int | None = None, seed: int = 42,
                        draw_col: str = "draw") -> DataFrame:
    """BAL1: ROSE ``ovun.sample(method='over', N=total)``: the smallest class
    gets ``total - n`` extra rows (default total = 2 x majority count)."""
    counts = _class_counts(df, label)
    minority = min(counts, key=lambda kv: (kv[1], str(kv[0])))
    n = sum(c for _, c in counts)
    if total is None:
        total = 2 * max(c for _, c in counts)
    return oversample_classes(df, label, id_col, {minority[0]: minority[1] + total - n}, seed, draw_col)


def oversample_equal(df: DataFrame, label: str, id_col: str, seed: int = 42, draw_col: str = "draw") -> DataFrame:
    """BAL3: random over-sampler: every class grows to the largest class size."""
    counts = _class_counts(df, label)
    top = max(c for _, c in counts)
    return oversample_classes(df, label, id_col, {k: top for k, _ in counts}, seed, draw_col)
