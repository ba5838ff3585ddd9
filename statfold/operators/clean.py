"""Projection, filters, cleaning and recoding (PRJ*, FIL*, CLN1-6).

Everything here is row-local (narrow) except duplicates (one shuffle on the
full row) and the outlier fences (one aggregate, broadcast back as one row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statfold.operators.position import order_statistics


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """PRJ1 (by name; positions are not stable in a distributed table)."""
    return df.drop(*names)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """PRJ2."""
    return df.select(*names)


def select_numeric(df: DataFrame) -> DataFrame:
    """PRJ3: only int/long/float/double/decimal columns."""
    from statfold.operators.profile import numeric_columns
    return df.select(*numeric_columns(df))


def add_sums(df: DataFrame, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ4: derived composite columns, ``{"age_tenure": ["age", "tenure"]}``."""
    for out, parts in pairs.items():
        expr = F.col(parts[0])
        for p in parts[1:]:
            expr = expr + F.col(p)
        df = df.withColumn(out, expr)
    return df


def safe_cast(df: DataFrame, casts: Mapping[str, str], strict: bool = False) -> DataFrame:
    """PRJ5: cast columns; dirty values become null (R ``as.numeric``) unless strict."""
    for c, t in casts.items():
        df = df.withColumn(c, F.col(c).cast(t) if strict else F.col(c).try_cast(t))
    return df


def filter_equal(df: DataFrame, col: str, value) -> DataFrame:
    """FIL1: rows where ``col == value``."""
    return df.where(F.col(col) == F.lit(value))


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    """FIL2."""
    return df.where(F.col(col).isNotNull())


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """FIL3: drop rows with any null (optionally in ``subset``)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def valid_input(text: Column) -> Column:
    """FIL4: non-blank, more than 3 characters and at least one letter."""
    return (text.isNotNull() & (F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) > 0)
            & (F.length(text) > 3) & text.rlike(r"\p{L}"))


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """CLN1: per-column null fill."""
    return df.na.fill(dict(values))


def replace_blank(df: DataFrame, value: str = "0", cols: Sequence[str] | None = None) -> DataFrame:
    """CLN2: exactly-empty strings become ``value`` in string columns."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c) == "", F.lit(value)).otherwise(F.col(c)))
    return df


def recode(col: Column | str, mapping: Mapping, keep_unmatched: bool = True) -> Column:
    """CLN3: value recode through a literal map (row-local, see quirk Q2).

    Unmatched values are kept (pandas ``replace``), cast to the type of the
    new values, or become null when ``keep_unmatched=False`` (strict).
    """
    c = F.col(col) if isinstance(col, str) else col
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    hit = F.try_element_at(F.create_map(*pairs), c)
    if not keep_unmatched:
        return hit
    kinds = {type(v) for v in mapping.values()}
    target = "string" if kinds == {str} else ("double" if float in kinds else "bigint")
    return F.coalesce(hit, c.try_cast(target))


# Copies emitted per generated chunk: bounds every array built by CLN4.
COPY_CHUNK = 4096


def duplicated_rows(df: DataFrame, chunk: int = COPY_CHUNK) -> DataFrame:
    """CLN4: second and later copies of every repeated row (nulls equal).

    One ``groupBy`` on all columns (partial counts before the shuffle); a
    repeated row is emitted ``n - 1`` times in two levels: chunks of at most
    ``chunk`` copies, spread round-robin over the shuffle partitions, then the
    copies of each chunk. A group of copies holding a third of all rows thus
    never builds one array or one task of that size.
    """
    cols = df.columns
    n = F.col("_n")
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(n > 1)
    chunks = counts.select(*cols, "_n", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil((n - 1) / chunk).cast("long") - 1)).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = F.least(F.lit(chunk).cast("long"), n - 1 - F.col("_c") * chunk)
    copies = chunks.repartition(parts).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_k"))
    return copies.drop("_k")


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """CLN5."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def tukey_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "hinges") -> DataFrame:
    """Lower/upper fences per column: hinges (R ``fivenum``) or type-7 quartiles."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("u")
    ).select("u.*").where(F.col("value").isNotNull())
    if method == "hinges":
        n4 = F.floor((F.col("_n") + 3) / 2) / 2
        positions = [n4, F.col("_n") + 1 - n4]
    elif method == "quartiles":
        positions = [0.25 * (F.col("_n") - 1) + 1, 0.75 * (F.col("_n") - 1) + 1]
    else:
        raise ValueError("method must be 'hinges' or 'quartiles'")
    q = order_statistics(long, "value", positions, ["col_name"], ["lower_hinge", "upper_hinge"], max_groups=len(cols))
    iqr = F.col("upper_hinge") - F.col("lower_hinge")
    return q.select("col_name", "lower_hinge", "upper_hinge",
                    (F.col("lower_hinge") - k * iqr).alias("lower_fence"),
                    (F.col("upper_hinge") + k * iqr).alias("upper_fence"))


def tukey_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5, action: str = "null",
                   method: str = "hinges") -> tuple[DataFrame, DataFrame]:
    """CLN6: outlier report and cleaned table.

    Returns ``(cleaned, report)``; the report has
    ``(column, n, n_out, prop, mean_before, mean_after)``. ``action`` is
    ``'flag'`` (adds ``<col>_outlier``), ``'null'`` or ``'drop'``.
    """
    cols = list(cols)
    fences = tukey_fences(df, cols, k, method)
    wide = fences.groupBy().agg(*[
        F.max(F.when(F.col("col_name") == c, F.col(b))).alias(f"_{b}__{c}")
        for c in cols for b in ("lower_fence", "upper_fence")]).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(wide), "_one")
    flags = {c: (F.col(c) < F.col(f"_lower_fence__{c}")) | (F.col(c) > F.col(f"_upper_fence__{c}")) for c in cols}
    for c in cols:
        joined = joined.withColumn(f"{c}_outlier", F.coalesce(flags[c], F.lit(False)))
    long = joined.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value"), F.col(f"{c}_outlier").alias("out"))
        for c in cols])).alias("u")).select("u.*").where(F.col("value").isNotNull())
    report = long.groupBy("col_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("out").cast("long")).alias("n_out"),
        F.avg("value").alias("mean_before"), F.avg(F.when(~F.col("out"), F.col("value"))).alias("mean_after"))
    report = report.withColumn("prop", F.col("n_out") / F.col("n"))
    helper = [f"_{b}__{c}" for c in cols for b in ("lower_fence", "upper_fence")] + ["_one"]
    if action == "flag":
        cleaned = joined.drop(*helper)
    elif action == "null":
        for c in cols:
            joined = joined.withColumn(c, F.when(F.col(f"{c}_outlier"), None).otherwise(F.col(c)))
        cleaned = joined.drop(*helper, *[f"{c}_outlier" for c in cols])
    elif action == "drop":
        keep = F.lit(True)
        for c in cols:
            keep = keep & ~F.col(f"{c}_outlier")
        cleaned = joined.where(keep).drop(*helper, *[f"{c}_outlier" for c in cols])
    else:
        raise ValueError("action must be flag, null or drop")
    return cleaned, report
