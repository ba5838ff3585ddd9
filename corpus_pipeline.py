"""A training-corpus pipeline over ``documents``: each stage is one operator and works on what the last one kept.

``run(spark, sf_dir)`` writes every stage's rows as Parquet in the shared checkpoint folder and rereads them.
The language stage learns from every labelled row it gets (no quarter is held out: nothing is evaluated here);
documents it rejects go. Exact copies go, then all but one document of each SimHash component, then documents that
hold a benchmark item; the rest is packed, and each piece has its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statfold.llm.blocknames import drop_exact_copies
from statfold.llm.decontam import drop_contaminated
from statfold.llm.langid import drop_unknown, fit
from statfold.llm.pack import pack
from statfold.llm.queries import tokenizer_path
from statfold.llm.simhash import drop_near_copies
from statfold.session import cut_lineage, ensure_checkpoint_dir, ship_package
from statfold.sources.tables import table


ARROW_ROWS = 2_000  # rows of whole texts that are handed to Python at once


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_unknown(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("benchmark_decontamination", decontaminate), ("lexical_packing", packed)]

# language centroids, SimHash components and BPE tokens are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
