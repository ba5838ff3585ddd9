"""Text queries (TXT*, AGG15). Long texts are compared through md5 + length on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from statfold.functions.hashing import sql_hash_uniform
from statfold.operators import ngram, phrases, rouge, sampling, text
from statfold.plans.common import round_doubles
from statfold.plans.registry import Tables, register
from statfold.session import cut_lineage
from statfold.sources import dataset

WS = r"'^\s+|\s+$'"
SQL_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)"


def sql_words(t: str) -> str:
    return SQL_WORDS.format(t=t)


@register("txt1_normalize_contract", r"""
SELECT doc_id, md5(t) AS norm_md5, length(t) AS norm_len FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           lower(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g')), '---+', ' ', 'g'), '[\n\r\t]', ' ', 'g'),
           '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\b\d+\b', '', 'g') AS t FROM documents)
""")
def txt1_normalize_contract(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", text.normalize_contract("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("norm_md5"), F.length("t").alias("norm_len"))


@register("txt2_clean_prompt")
def txt2_clean_prompt(spark, sf):
    c = Tables(spark, sf).conversations.where(F.col("role") == "user")
    return c.select("conv_id", "turn", text.clean_prompt("text").alias("cleaned"))


_PAGE = "concat(url, ' ', html)"


@register("txt3_remove_urls", rf"""
SELECT page_id, md5(t) AS clean_md5, length(t) AS clean_len
FROM (SELECT page_id, regexp_replace({_PAGE}, 'https?://\S+|www\.\S+|Indian Kanoon', '', 'gi') AS t FROM pages)
""")
def txt3_remove_urls(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", text.remove_urls(F.concat_ws(" ", "url", "html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("clean_md5"), F.length("t").alias("clean_len"))


@register("txt4_last_words", rf"""
SELECT page_id, md5(array_to_string(w[greatest(len(w) - 299, 1):], ' ')) AS tail_md5, CAST(len(w) AS INTEGER) AS n_words
FROM (SELECT page_id, CASE WHEN regexp_replace(t, {WS}, '', 'g') = '' THEN []::VARCHAR[]
             ELSE string_split_regex(regexp_replace(t, {WS}, '', 'g'), '\s+') END AS w
      FROM (SELECT page_id, regexp_replace({_PAGE}, 'https?://\S+|www\.\S+|Indian Kanoon', '', 'gi') AS t FROM pages))
""")
def txt4_last_words(spark, sf):
    from statfold.functions import arrays
    p = Tables(spark, sf).pages.select("page_id", text.remove_urls(F.concat_ws(" ", "url", "html")).alias("t"))
    return p.select("page_id", F.md5(text.last_words("t", 300)).alias("tail_md5"),
                    F.size(arrays.whitespace_words("t")).alias("n_words"))


def _pairs(spark, sf):
    """(user turn, next assistant turn) pairs; ``pair_id = conv_id * 1000 + turn``."""
    c = Tables(spark, sf).conversations
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                                                 "prompt", "reply")


PAIRS_SQL = """(SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS prompt, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


@register("txt5_strip_prompt", f"""
SELECT pair_id, md5(CASE WHEN lower(substr(r, 1, length(prompt))) = lower(prompt) THEN substr(r, length(prompt) + 1) ELSE r END) AS out_md5
FROM (SELECT pair_id, prompt, prompt || ' ' || reply AS r FROM {PAIRS_SQL})
""")
def txt5_strip_prompt(spark, sf):
    p = _pairs(spark, sf).withColumn("r", F.concat(F.col("prompt"), F.lit(" "), F.col("reply")))
    return p.select("pair_id", F.md5(text.strip_prompt("r", "prompt")).alias("out_md5"))


@register("txt6_join_question_answer", f"""
SELECT pair_id, md5(concat_ws(' ', prompt, reply)) AS qa_md5 FROM {PAIRS_SQL}
""")
def txt6_join_question_answer(spark, sf):
    p = _pairs(spark, sf)
    return p.select("pair_id", F.md5(text.join_question_answer("prompt", "reply")).alias("qa_md5"))


_ENCODE_SQL = f"""
WITH toks AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
     vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS token_id
               FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM toks) GROUP BY word)),
     ex AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM toks),
     ids AS (SELECT ex.doc_id, list(coalesce(vocab.token_id, 1) ORDER BY ex.i) AS ids FROM ex LEFT JOIN vocab USING (word) GROUP BY ex.doc_id),
     enc AS (SELECT t.doc_id, coalesce(ids.ids, []::INTEGER[]) AS ids FROM toks t LEFT JOIN ids USING (doc_id)),
     framed AS (SELECT doc_id, len(ids) AS n_tokens, [2] || ids[greatest(len(ids) - 509, 1):] || [3] AS f FROM enc),
     padded AS (SELECT doc_id, n_tokens, (f || list_transform(range(512 - len(f)), lambda x: 0))[1:512] AS input_ids FROM framed)"""


@register("txt7_encode_tokens", _ENCODE_SQL + """
SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens, md5(array_to_string(input_ids, ',')) AS ids_md5,
       CAST(len(input_ids) AS INTEGER) AS width FROM padded
""")
def txt7_encode_tokens(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", "text")
    vocab = text.build_vocabulary(docs, "text")
    enc = text.encode(docs, "doc_id", "text", vocab, 512)
    return enc.select("doc_id", "n_tokens", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                      F.size("input_ids").alias("width"))


@register("txt8_attention_mask", _ENCODE_SQL + """
SELECT doc_id, CAST(list_sum(list_transform(input_ids, lambda x: CAST(x > 0 AS INTEGER))) AS BIGINT) AS mask_sum FROM padded
""")
def txt8_attention_mask(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", "text")
    enc = text.encode(docs, "doc_id", "text", text.build_vocabulary(docs, "text"), 512)
    return enc.select("doc_id", F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


def _entities_sql() -> str:
    parts = [f"SELECT doc_id, '{lbl}' AS label, lower(unnest(regexp_extract_all(text, '{pat}'))) AS entity FROM documents"
             for lbl, pat in text.ENTITY_RULES]
    return "\nUNION ALL\n".join(parts)


@register("txt9_entities", _entities_sql())
def txt9_entities(spark, sf):
    return text.entities(Tables(spark, sf).documents, "doc_id", "text")


@register("agg15_entity_sets", f"""
SELECT doc_id, label, CAST(count(DISTINCT entity) AS INTEGER) AS n_entities,
       array_to_string(list_sort(list_distinct(list(entity))), '|') AS entities
FROM ({_entities_sql()}) GROUP BY 1, 2
""")
def agg15_entity_sets(spark, sf):
    sets = text.entity_sets(text.entities(Tables(spark, sf).documents, "doc_id", "text"), "doc_id")
    return sets.select("doc_id", "label", F.size("entities").alias("n_entities"),
                       F.array_join("entities", "|").alias("entities"))


_CANDIDATES_SQL = r"""
WITH runs AS (
  SELECT doc_id, regexp_split_to_array(lower(unnest(regexp_extract_all(text,
         '\p{Lu}[\p{L}\p{N}]*(?:[ \t]+\p{Lu}[\p{L}\p{N}]*)+'))), '[ \t]+') AS r FROM documents),
grams AS (
  SELECT doc_id, r[i:i + n - 1] AS w, n
  FROM (SELECT doc_id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM runs, (VALUES (2), (3), (4)) AS x(n))),
cand AS (
  SELECT array_to_string(w, ' ') AS phrase, n AS n_words, count(*) AS n, count(DISTINCT doc_id) AS docs
  FROM grams WHERE len(list_distinct(w)) = n GROUP BY 1, 2)"""


@register("txt9_phrase_candidates", _CANDIDATES_SQL + """
SELECT phrase, n_words, n, docs FROM cand
""")
def txt9_phrase_candidates(spark, sf):
    return phrases.candidate_counts(Tables(spark, sf).documents, "doc_id", "text")


@register("txt9_named_phrases", _CANDIDATES_SQL + r""",
frequent AS (SELECT * FROM cand WHERE docs >= 3),
tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS part FROM documents),
parts AS (
  SELECT part, count(*) AS m FROM tokens GROUP BY 1 UNION ALL SELECT phrase, n FROM frequent),
cuts AS (
  SELECT phrase, n_words, n, docs, array_to_string(w[1:k], ' ') AS a, array_to_string(w[k + 1:], ' ') AS b
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, n_words)) AS k FROM frequent)),
kept AS (
  SELECT phrase, n_words, n, docs, min(ln(n::DOUBLE * total / (pa.m * pb.m)) / -ln(n::DOUBLE / total)) AS npmi
  FROM cuts JOIN parts pa ON pa.part = a JOIN parts pb ON pb.part = b, (SELECT count(*) AS total FROM tokens)
  GROUP BY ALL HAVING npmi >= 0.3)
SELECT phrase, n_words, n, docs, round(npmi, 6) AS npmi FROM kept k
WHERE coalesce((SELECT max(o.n) FROM kept o WHERE o.phrase <> k.phrase AND contains(' ' || o.phrase || ' ', ' ' || k.phrase || ' ')), 0)
      < 0.8 * n
""")
def txt9_named_phrases(spark, sf):
    found = phrases.mine_phrases(Tables(spark, sf).documents, "doc_id", "text")
    return found.withColumn("npmi", F.round("npmi", 6))


@register("agg15_name_sets")
def agg15_name_sets(spark, sf):
    docs = Tables(spark, sf).documents
    names = phrases.tag_phrases(docs, "doc_id", "text", phrases.mine_phrases(docs, "doc_id", "text"))
    sets = text.entity_sets(text.entities(docs, "doc_id", "text").unionByName(names), "doc_id")
    return sets.select("doc_id", "label", F.size("entities").alias("n_entities"),
                       F.array_join("entities", "|").alias("entities"))


def _summary_sql(source: str) -> str:
    return f"""
WITH s0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.SENTENCE}')) AS raw,
                   unnest(range(len(regexp_extract_all(text, '{text.SENTENCE}')))) AS idx FROM {source}),
     s AS (SELECT doc_id, idx, sentence, {sql_words('sentence')} AS w FROM
           (SELECT doc_id, idx, regexp_replace(raw, {WS}, '', 'g') AS sentence FROM s0) WHERE length(sentence) > 0),
     s2 AS (SELECT *, len(w) AS nw FROM s WHERE len(w) > 0),
     tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM s2) GROUP BY 1, 2),
     sc AS (SELECT x.doc_id, x.idx, sum(tf.tf) AS ssum FROM (SELECT doc_id, idx, unnest(w) AS word FROM s2) x
            JOIN tf USING (doc_id, word) GROUP BY 1, 2),
     r AS (SELECT s2.doc_id, s2.idx, s2.sentence, s2.nw, sc.ssum / s2.nw AS score FROM s2 JOIN sc USING (doc_id, idx)),
     c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                  row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM r)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS summary, sum(nw) AS summary_words FROM c WHERE cum <= 250 OR rk = 1 GROUP BY doc_id"""


@register("txt13_extractive_summary", f"""
SELECT doc_id, md5(summary) AS summary_md5, CAST(summary_words AS BIGINT) AS summary_words FROM ({_summary_sql('documents')})
""")
def txt13_extractive_summary(spark, sf):
    s = text.extractive_summary(Tables(spark, sf).documents, "doc_id", "text", 250)
    return s.select("doc_id", F.md5("summary").alias("summary_md5"), F.col("summary_words").cast("long"))


@register("txt14_show_samples", f"""
SELECT doc_id, md5(summary) AS summary_md5 FROM ({_summary_sql(
    f"(SELECT doc_id, text FROM documents ORDER BY {sql_hash_uniform(42, 'doc_id')}, doc_id LIMIT 3)")})
""")
def txt14_show_samples(spark, sf):
    picked = sampling.sample_rows(Tables(spark, sf).documents.select("doc_id", "text"), "doc_id", 3, 42)
    s = text.extractive_summary(picked, "doc_id", "text", 250)
    return s.select("doc_id", F.md5("summary").alias("summary_md5"))


@register("txt15_conversation_history", r"""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations
WHERE role = 'assistant' AND text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0
  AND length(text) > 3 AND regexp_matches(text, '\p{L}')
""")
def txt15_conversation_history(spark, sf):
    h = text.conversation_history(Tables(spark, sf).conversations)
    return h.select("conv_id", "turn", "role", F.col("position").cast("long").alias("position"))


def _rouge_tokens_sql(col: str) -> str:
    body = f"regexp_replace(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'), '^ +| +$', '', 'g')"
    return f"CASE WHEN {body} = '' THEN []::VARCHAR[] ELSE string_split({body}, ' ') END"


def _rouge_n_sql(n: int) -> str:
    grams = "{t}" if n == 1 else "list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"""
WITH p AS (SELECT pair_id, {grams.format(t='c')} AS cg, {grams.format(t='r')} AS rg FROM
           (SELECT pair_id, {_rouge_tokens_sql('reply')} AS c, {_rouge_tokens_sql('prompt')} AS r FROM {PAIRS_SQL})),
     cc AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(cg) AS g FROM p) GROUP BY 1, 2),
     rc AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(rg) AS g FROM p) GROUP BY 1, 2),
     o AS (SELECT pair_id, sum(least(cc.n, rc.n)) AS o FROM cc JOIN rc USING (pair_id, g) GROUP BY 1),
     s AS (SELECT p.pair_id, len(cg) AS nc, len(rg) AS nr, coalesce(o.o, 0) AS o FROM p LEFT JOIN o USING (pair_id)),
     pr AS (SELECT pair_id, CASE WHEN nc > 0 THEN o / nc ELSE 0.0 END AS precision, CASE WHEN nr > 0 THEN o / nr ELSE 0.0 END AS recall FROM s)
SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS fmeasure,
       'rouge{n}' AS rouge FROM pr"""


@register("txt10_rouge_n", "SELECT * FROM (" + _rouge_n_sql(1) + ")\nUNION ALL\nSELECT * FROM (" + _rouge_n_sql(2) + ")")
def txt10_rouge_n(spark, sf):
    p = _pairs(spark, sf)
    r1 = rouge.rouge_n(p, "pair_id", "reply", "prompt", 1)
    r2 = rouge.rouge_n(p, "pair_id", "reply", "prompt", 2)
    return round_doubles(r1.unionByName(r2), 6)


@register("txt10_rouge_unique_mean")
def txt10_rouge_unique_mean(spark, sf):
    p = _pairs(spark, sf)
    return rouge.corpus_mean(rouge.rouge_n(p, "pair_id", "reply", "prompt", 1, "unique")
                             .unionByName(rouge.rouge_n(p, "pair_id", "reply", "prompt", 2, "unique")))


@register("txt10_rouge_l")
def txt10_rouge_l(spark, sf):
    p = _pairs(spark, sf)
    return rouge.rouge_l(p, "pair_id", "reply", "prompt").unionByName(
        rouge.rouge_l(p, "pair_id", "reply", "prompt", summary_level=True))


@register("txt10_summary_vs_lead")
def txt10_summary_vs_lead(spark, sf):
    docs = Tables(spark, sf).documents
    summ = text.extractive_summary(docs, "doc_id", "text", 250)
    lead = text.sentences(docs, "doc_id", "text").where(F.col("idx") < 3).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda s: s["sentence"]),
                     " ").alias("lead"))
    pairs = cut_lineage(summ.join(lead, "doc_id"))   # three scores read them
    return rouge.corpus_mean(rouge.rouge_n(pairs, "doc_id", "summary", "lead", 1)
                             .unionByName(rouge.rouge_n(pairs, "doc_id", "summary", "lead", 2))
                             .unionByName(rouge.rouge_l(pairs, "doc_id", "summary", "lead")))


_SPLIT = f"CASE WHEN {sql_hash_uniform(42, 'doc_id')} < 0.8 THEN 'train' ELSE 'eval' END"
_LM_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS split, {sql_words('text')} AS t FROM documents),
     bg AS (SELECT doc_id, split, unnest(list_transform(range(1, len(t)), lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS b FROM d),
     b AS (SELECT doc_id, split, b.w1 AS w1, b.w2 AS w2 FROM bg),
     c12 AS (SELECT w1, w2, count(*) AS c12 FROM b WHERE split = 'train' GROUP BY 1, 2),
     c1 AS (SELECT w1, sum(c12) AS c1 FROM c12 GROUP BY 1),
     v AS (SELECT count(DISTINCT w) AS V FROM (SELECT unnest(t) AS w FROM d WHERE split = 'train')),
     per AS (SELECT b.doc_id, -sum(ln((coalesce(c12.c12, 0) + 1.0) / (coalesce(c1.c1, 0) + 1.0 * v.V))) AS nll, count(*) AS bigrams
             FROM b LEFT JOIN c12 USING (w1, w2) LEFT JOIN c1 USING (w1), v WHERE b.split = 'eval' GROUP BY b.doc_id)"""


def _lm(spark, sf):
    docs = dataset.with_hash_split(Tables(spark, sf).documents.select("doc_id", "text"), "doc_id",
                                   (("train", 0.8), ("eval", 0.2)))
    model = ngram.fit_bigram(docs.where(F.col("split") == "train"), "text")
    return ngram.perplexity(docs.where(F.col("split") == "eval"), "doc_id", "text", model, 1.0)


@register("txt12_bigram_perplexity", _LM_SQL + """
SELECT doc_id, round(nll, 4) AS nll, bigrams, round(exp(nll / bigrams), 4) AS perplexity FROM per
""")
def txt12_bigram_perplexity(spark, sf):
    return round_doubles(_lm(spark, sf), 4)


@register("txt11_corpus_perplexity", _LM_SQL + """
SELECT round(exp(sum(nll) / sum(bigrams)), 4) AS perplexity, CAST(sum(bigrams) AS BIGINT) AS bigrams, count(*) AS documents FROM per
""")
def txt11_corpus_perplexity(spark, sf):
    return round_doubles(ngram.corpus_perplexity(_lm(spark, sf)), 4)
