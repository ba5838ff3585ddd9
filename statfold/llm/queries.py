"""Registered queries of the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statfold.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


EXACT_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@register("op1_exact_dedup", EXACT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.blocknames import exact_dedup
    return exact_dedup(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.langid import fit, held_out, identify
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@register("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_lexical_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.pack import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.tokens import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op4_warc_segments")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.warc import read_archives, resolve, write_archives
    from statfold.session import scratch_path
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = resolve(read_archives(spark, path, with_payload=False))
    return found.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


@register("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.boilerplate import extract
    return extract(table(spark, sf_dir, "pages"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


@register("op6_pii_boosted")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.pii import BASE, find_spans, span_list
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    found = find_spans(docs)
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))


@register("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.suffix import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


@register("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from statfold.llm.bpe import decode, encode
    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(table(spark, sf_dir, "documents"), ranks, pattern)
    coded = coded.withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded, ranks, pattern, keep=("n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS aid, r.vec_id AS id, a.y = r.y AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.aid, p.id AS pid, p.score AS ps, s.id AS nid, s.score AS ns,
         row_number() OVER (PARTITION BY p.aid, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT aid AS anchor_id, pid AS positive_id, rank::INTEGER AS rank, nid AS negative_id, ps AS positive_score,
       ns AS negative_score
FROM n WHERE rank <= 3
"""


@register("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.negatives import hard_negatives, scaled
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    data = rows.select("vec_id", moved.alias("label"), scaled(rows, "embedding").alias("vec"))
    return hard_negatives(data, F.col("vec_id") % 50 == 0, id_col="vec_id")


def _repair_sql() -> str:
    """Damage, faults, and the cheapest repair row by row (states e, s, u, a of a recursive query)."""
    def add(way, cost, letter, line=None):
        line = f"list_append({way}.t, {line})" if line else f"{way}.t"
        return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {line}}} END"

    def least(*ways):
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    user, assistant = "'user:'", "'assistant:'"
    kept = "r.role || ':' || r.text"

    def taken(way, initial, line):
        keep, change = add(way, "r.extra", "K", kept), add(way, "r.extra + 3", "R", f"{line} || r.text")
        return f"CASE WHEN NOT r.removed THEN CASE WHEN r.initial = '{initial}' THEN {keep} ELSE {change} END END"
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT keyed.*, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
           lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) % 20 AS kind
  FROM keyed, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
n AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, role[1] AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n),
r AS (
  SELECT conv_id, i, role, text, initial, fault IN ('blank', 'duplicate') AS removed,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS e,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS u,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT r.conv_id, r.i, {add('w.e', 4, 'D')},
         {least(add('w.s', 4, 'D'),
                f"CASE WHEN r.initial = 's' AND NOT r.removed THEN {add('w.e', 'r.extra', 'K', kept)} END")},
         {least(add('w.u', 4, 'D'), *[taken(f'w.{x}', 'u', user) for x in 'esa'])},
         {least(add('w.a', 4, 'D'), taken('w.u', 'a', assistant))}
  FROM (SELECT conv_id, i, e, s,
               {least('dp.u', *[add(f'dp.{x}', 3, 'I', user) for x in 'esa'])} AS u,
               {least('dp.a', add('dp.u', 3, 'I', assistant),
                      *[add(f'({add(f"dp.{x}", 3, "I", user)})', 3, 'I', assistant) for x in 'es'])} AS a
        FROM dp) w
  JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
last AS (
  SELECT conv_id, {least('e', 'a', add('u', 3, 'I', assistant),
                         add(f'({add("s", 3, "I", user)})', 3, 'I', assistant))} AS w
  FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c::BIGINT AS cost, w.a AS audit,
       sha256(array_to_string(w.t, chr(10))) AS repaired_sha256
FROM last l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""


@register("op12_conversation_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statfold.llm.repair import SUMMARY, damaged, repair, summaries
    rows = table(spark, sf_dir, "conversations")
    found = summaries(repair(damaged(rows), together=True)).withColumnRenamed("conv_id", "found_id")
    ids = rows.select("conv_id").distinct()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
