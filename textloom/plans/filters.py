"""Queries for projections, filters and predicates (inventory 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicon import stop_words
from textloom.operators import counting, datasets
from textloom.operators.common import evaluate_once
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.strings import STOP_TOKENS_SQL, clean_tokens, stop_tokens
from textloom.sources import tables as S

NOTES = S.with_sql(S.NOTES_SQL)


@query("proj_text_label", sql=NOTES + """
SELECT id, IN07 AS text, CAST(severity AS INTEGER) AS label FROM notes""")
def q_proj_text_label(spark, sf_dir):
    return datasets.text_label(S.notes(spark, sf_dir), text_col="IN07", label_col="severity")


@query("proj_rename_tasks", sql=S.with_sql(S.NOTES_RAW_SQL) + """
SELECT id, IN07, "Key.PD09" AS severity, "Key.IN05" AS type, "Key.RP02" AS location FROM notes_raw""")
def q_proj_rename_tasks(spark, sf_dir):
    return datasets.rename_tasks(S.notes_raw(spark, sf_dir))


@query("proj_multi_task", sql=NOTES + """
SELECT id, text, task, CAST(label AS INTEGER) AS label FROM (
  SELECT id, IN07 AS text, 'severity' AS task, severity AS label FROM notes
  UNION ALL SELECT id, IN07 AS text, 'type' AS task, type AS label FROM notes)
WHERE label IS NOT NULL""")
def q_proj_multi_task(spark, sf_dir):
    return datasets.multi_task(S.notes(spark, sf_dir), tasks=("severity", "type"), text_col="IN07")


@query("flt_null_text", sql=NOTES + "SELECT id, IN07 FROM notes WHERE IN07 IS NOT NULL")
def q_flt_null_text(spark, sf_dir):
    return S.notes(spark, sf_dir).select("id", "IN07").where(F.col("IN07").isNotNull())


@query("flt_dropna_any", sql=NOTES + f"""
SELECT * FROM (SELECT id, {Q.clean_note('IN07')} AS IN07, severity, type, location FROM notes
               WHERE IN07 IS NOT NULL)
WHERE id IS NOT NULL AND IN07 IS NOT NULL AND severity IS NOT NULL AND type IS NOT NULL
  AND location IS NOT NULL""")
def q_flt_dropna_any(spark, sf_dir):
    """Clean, then drop a row null in any column (a report missing one code is lost)."""
    n = S.notes(spark, sf_dir).where(F.col("IN07").isNotNull())
    return evaluate_once(n.withColumn("IN07", T.clean_note("IN07")), "IN07").dropna("any")


@query("flt_null_label", sql=NOTES + "SELECT id, IN07, severity FROM notes WHERE severity IS NOT NULL")
def q_flt_null_label(spark, sf_dir):
    return S.notes(spark, sf_dir).select("id", "IN07", "severity").where(F.col("severity").isNotNull())


SPLIT_SQL = """split3 AS (
  SELECT id, IN07, severity, CASE WHEN r <= n_v THEN 'valid' WHEN r <= n_s THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '41', CAST(id AS VARCHAR))), id) AS r,
               round_even(round_even(count(*) OVER () * 0.8, 0) * 0.25, 0) AS n_v,
               round_even(count(*) OVER () * 0.8, 0) AS n_s
        FROM notes WHERE severity IS NOT NULL))"""


@query("flt_severity_valid", sql=S.with_sql(S.NOTES_SQL, SPLIT_SQL) + """
SELECT id, split, severity FROM split3 WHERE split <> 'train' OR severity < 6""")
def q_flt_severity_valid(spark, sf_dir):
    from textloom.operators.sampling import three_way_split
    n = S.notes(spark, sf_dir).where(F.col("severity").isNotNull())
    s = three_way_split(n, "id", seed=41)
    return datasets.drop_train_label(s, "severity", 6).select("id", "split", "severity")


@query("flt_min_tokens", sql=f"""
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens FROM ({STOP_TOKENS_SQL}) WHERE len(tokens) > 2""")
def q_flt_min_tokens(spark, sf_dir):
    t = stop_tokens(spark, sf_dir)
    return t.where(F.size("tokens") > 2).select("doc_id", F.size("tokens").alias("n_tokens"))


@query("flt_min_span", sql=f"""
SELECT doc_id, CAST(len({Q.tokens_ws('text')}) AS INTEGER) AS n_tokens FROM documents
WHERE len({Q.tokens_ws('text')}) >= 2 * 2 * 64""")
def q_flt_min_span(spark, sf_dir):
    """Keep documents with at least 2 * num_anchors * max_span_len tokens (A=2, M=64)."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokenize_ws("text")).alias("n_tokens"))
    return d.where(F.col("n_tokens") >= 2 * 2 * 64)


@query("flt_empty_docs", sql=f"""
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, CAST(sum(n) AS INTEGER) AS n_words FROM (
  SELECT doc_id, len({Q.tokens('line')}) AS n
  FROM (SELECT doc_id, unnest(string_split_regex(text, '{T.LINE_BREAK_PATTERN}')) AS line FROM documents))
WHERE n > 0 GROUP BY doc_id""")
def q_flt_empty_docs(spark, sf_dir):
    """Documents as lines of word tokens; empty lines and then empty documents are skipped."""
    d = S.read(spark, sf_dir, "documents")
    sents = d.select("doc_id", F.transform(F.split("text", T.LINE_BREAK_PATTERN),
                                           lambda s: F.size(T.tokenize_words(s))).alias("ns"))
    kept = sents.select("doc_id", F.filter("ns", lambda n: n > 0).alias("ns")).where(F.size("ns") > 0)
    return kept.select("doc_id", F.size("ns").alias("n_sentences"),
                       F.aggregate("ns", F.lit(0), lambda a, x: a + x).alias("n_words"))


WORD_COUNTS_SQL = f"""SELECT word, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest({Q.tokens(Q.clean_note('text'))}) AS word FROM documents WHERE text IS NOT NULL)
GROUP BY word"""


@query("flt_vocab_min_count", sql=f"SELECT * FROM ({WORD_COUNTS_SQL}) WHERE cnt >= 5")
def q_flt_vocab_min_count(spark, sf_dir):
    return counting.word_counts(clean_tokens(spark, sf_dir)).where(F.col("cnt") >= 5)


@query("flt_first_n", sql=NOTES + "SELECT id, IN07 FROM notes ORDER BY id LIMIT 100")
def q_flt_first_n(spark, sf_dir):
    """First N rows for a development sample (the limit is the feature)."""
    return S.notes(spark, sf_dir).select("id", "IN07").orderBy("id").limit(100)


@query("flt_digit_tokens", sql=f"""
SELECT CAST(count(*) FILTER (WHERE regexp_matches(word, '\\p{{Nd}}') AND NOT contains(word, 'unused')) AS BIGINT) AS n_digit,
       CAST(count(*) AS BIGINT) AS n_vocab,
       round(count(*) FILTER (WHERE regexp_matches(word, '\\p{{Nd}}') AND NOT contains(word, 'unused')) / count(*), 6) AS share
FROM ({WORD_COUNTS_SQL})""")
def q_flt_digit_tokens(spark, sf_dir):
    v = counting.word_counts(clean_tokens(spark, sf_dir))
    return counting.digit_token_stats(v)


@query("flt_vocab_contains", sql=f"""
WITH vocab AS ({WORD_COUNTS_SQL}),
terms AS (SELECT DISTINCT unnest({Q.tokens(Q.clean_note('text'))}) AS term FROM benchmark)
SELECT term, term IN (SELECT word FROM vocab) AS in_vocab FROM terms""")
def q_flt_vocab_contains(spark, sf_dir):
    """Which query terms (benchmark tokens) are in the corpus vocabulary."""
    vocab = counting.word_counts(clean_tokens(spark, sf_dir))
    b = S.read(spark, sf_dir, "benchmark")
    terms = b.select(F.explode(T.tokenize_words(T.clean_note("text"))).alias("term")).distinct()
    return counting.in_vocabulary(terms, vocab, "term")


del stop_words
