"""Queries for the row-local string operators and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import counting
from textloom.operators.common import drop_stopwords, evaluate_once
from textloom.operators.sentences import split_sentences
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.sources import tables as S

def clean_tokens(spark, sf_dir, documents=None):
    d = (S.read(spark, sf_dir, "documents") if documents is None else documents).where(F.col("text").isNotNull())
    return evaluate_once(d.select("doc_id", T.tokenize_words(T.clean_note("text")).alias("tokens")), "tokens")


@query("rank_top_words", sql=f"""
SELECT word, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest({Q.tokens(Q.clean_note('text'))}) AS word FROM documents WHERE text IS NOT NULL)
GROUP BY word ORDER BY cnt DESC, word LIMIT 10""")
def q_rank_top_words(spark, sf_dir):
    return counting.top_words(counting.word_counts(clean_tokens(spark, sf_dir)))


def _dirty(spark, sf_dir):
    return S.notes_dirty(spark, sf_dir)


DIRTY = S.with_sql(S.NOTES_DIRTY_SQL)


@query("str_strip_brackets", sql=DIRTY + f"SELECT id, {Q.brackets('IN07')} AS text FROM notes_dirty")
def q_strip_brackets(spark, sf_dir):
    return _dirty(spark, sf_dir).select("id", T.strip_brackets("IN07").alias("text"))


@query("str_replace_chain", sql=DIRTY + f"SELECT id, {Q.replace_chain('IN07')} AS text FROM notes_dirty")
def q_replace_chain(spark, sf_dir):
    return _dirty(spark, sf_dir).select("id", T.replace_chain("IN07").alias("text"))


@query("str_remove_admin", sql=DIRTY + f"SELECT id, {Q.admin(Q.replace_chain('IN07'))} AS text FROM notes_dirty")
def q_remove_admin(spark, sf_dir):
    return _dirty(spark, sf_dir).select("id", T.remove_admin(T.replace_chain("IN07")).alias("text"))


@query("str_strip_lower", sql=DIRTY + f"SELECT id, lower({Q.strip(Q.lit(chr(9) + ' ') + ' || IN07 || ' + Q.lit(chr(10) + chr(160)))}) AS text FROM notes_dirty")
def q_strip_lower(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("IN07"), F.lit("\n "))
    return _dirty(spark, sf_dir).select("id", T.strip_lower(padded).alias("text"))


@query("str_backslash_s", sql=DIRTY + f"SELECT id, {Q.backslash_s('IN07')} AS text FROM notes_dirty")
def q_backslash_s(spark, sf_dir):
    return _dirty(spark, sf_dir).select("id", T.backslash_s("IN07").alias("text"))


@query("str_clean_note", sql=DIRTY + f"""
SELECT id, text, severity, type, location FROM (
  SELECT id, {Q.clean_note('IN07')} AS text, severity, type, location
  FROM notes_dirty WHERE IN07 IS NOT NULL)
WHERE text IS NOT NULL""")
def q_clean_note(spark, sf_dir):
    """Whole report cleaner on the dirty notes; null text dropped (not whole rows:
    flt_dropna_any is the separate any-column drop)."""
    n = _dirty(spark, sf_dir).where(F.col("IN07").isNotNull())
    # pin the cleaned text: otherwise the null filter is pushed below the
    # projection and the whole cleaner runs twice per row
    cleaned = evaluate_once(n.select("id", T.clean_note("IN07").alias("text"), "severity", "type", "location"), "text")
    return cleaned.where(F.col("text").isNotNull())


@query("str_alpha_only", sql=f"SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z'']+', ' ', 'g')) AS text FROM documents")
def q_alpha_only(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.alpha_only("text").alias("text"))


def _sql_html(expr):
    e = f"lower({expr})"
    for s in T.HTML_NEWLINES:
        e = f"replace({e}, {Q.lit(s)}, chr(10))"
    return f"coalesce({e}, '')"


@query("str_html_newlines", sql=f"SELECT page_id, {_sql_html('html')} AS text FROM pages")
def q_html_newlines(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", T.html_newlines("html").alias("text"))


@query("str_sanitize", sql=f"SELECT doc_id, {Q.sanitize('text', lower=True)} AS text FROM documents")
def q_sanitize(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.sanitize("text", lowercase=True).alias("text"))


@query("str_char_chunks", sql="""
SELECT doc_id, CAST(i / 200 AS BIGINT) AS pos, substr(text, i + 1, 200) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 200)) AS i
      FROM documents WHERE length(text) > 0)""")
def q_char_chunks(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    return (d.select("doc_id", F.posexplode(T.char_chunks("text", 200)).alias("pos", "chunk"))
            .withColumn("pos", F.col("pos").cast("bigint")))


@query("str_paragraphs", sql=fr"""
WITH paras AS (
  SELECT doc_id, unnest({Q.split_lines('text')}) AS ptext,
         generate_subscripts({Q.split_lines('text')}, 1) - 1 AS para FROM documents),
words AS (
  SELECT lower(rtrim(ltrim(w, '"''([{{«“‘'), '"'')]}}»”’,;:!?')) AS c
  FROM (SELECT unnest(regexp_split_to_array(ptext, '[ \t]+')) AS w FROM paras)),
kinds AS (
  SELECT CASE WHEN c LIKE '%.' THEN left(c, length(c) - 1) ELSE c END AS word, CAST(c LIKE '%.' AS INTEGER) AS dot FROM words),
counts AS (
  SELECT word, count(*) AS n, sum(dot) AS k, length(replace(word, '.', '')) AS size FROM kinds
  WHERE word <> '' AND word NOT LIKE '%.' AND word NOT LIKE '.%' AND NOT regexp_matches(word, '[^\pL.]') GROUP BY word),
rated AS (
  SELECT word, 2 * (k * (ln(0.99) - ln(p)) + (n - k) * (ln(0.01) - ln(1 - p))) * exp(-size)
               * (length(word) - size + 1) * pow(size, -(n - k)) AS score
  FROM counts, (SELECT sum(k) / sum(n) AS p FROM counts) WHERE k > 0 AND p < 1),
cut AS (
  SELECT doc_id, para, string_split(regexp_replace(trim(ptext, ' ' || chr(9)), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS cs
  FROM paras),
pieces AS (SELECT doc_id, para, unnest(cs) AS piece, generate_subscripts(cs, 1) AS i FROM cut),
ends AS (
  SELECT *, CASE WHEN piece LIKE '%.' THEN lower(rtrim(ltrim(
    string_split(replace(piece, chr(9), ' '), ' ')[-1], '"''([{{«“‘'), '"'')]}}»”’,;:!?')) END AS c
  FROM pieces WHERE piece <> ''),
marked AS (
  SELECT *, left(c, length(c) - 1) IN (SELECT word FROM rated WHERE score >= 0.3) AS abbr FROM ends),
opened AS (
  SELECT *, CASE WHEN lag(coalesce(abbr, false), 1, false) OVER (PARTITION BY doc_id, para ORDER BY i) THEN 0 ELSE 1 END AS o
  FROM marked),
numbered AS (
  SELECT *, sum(o) OVER (PARTITION BY doc_id, para ORDER BY i) - 1 AS sent FROM opened)
SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(sent AS INTEGER) AS sent, string_agg(piece, ' ' ORDER BY i) AS sentence
FROM numbered GROUP BY doc_id, para, sent""")
def q_paragraphs(spark, sf_dir):
    """Paragraphs (line split), then sentences that don't end at abbreviations learned from
    the whole table."""
    d = S.read(spark, sf_dir, "documents")
    p = d.select("doc_id", F.posexplode(T.split_lines("text")).alias("para", "ptext"))
    return split_sentences(p, ["doc_id", "para"], "ptext")


@query("str_tokenize_ws", sql=f"""
SELECT doc_id, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT doc_id, {Q.tokens_ws('text')} AS tk FROM documents)""")
def q_tokenize_ws(spark, sf_dir):
    tk = T.tokenize_ws("text")
    return S.read(spark, sf_dir, "documents").select(
        "doc_id", F.size(tk).alias("n_tokens"), F.array_join(tk, " ").alias("tokens"))


@query("str_tokenize_words", sql=f"""
SELECT doc_id, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT doc_id, {Q.tokens('lower(text)')} AS tk FROM documents)""")
def q_tokenize_words(spark, sf_dir):
    tk = T.tokenize_words("text", lower=True)
    return S.read(spark, sf_dir, "documents").select(
        "doc_id", F.size(tk).alias("n_tokens"), F.array_join(tk, " ").alias("tokens"))


def stop_tokens(spark, sf_dir, documents=None):
    from textloom.functions.lexicon import stop_words
    d = S.read(spark, sf_dir, "documents") if documents is None else documents
    t = d.select("doc_id", T.tokenize_words("text").alias("raw"))
    return drop_stopwords(t, "raw", "tokens", stop_words()).select("doc_id", "tokens")


STOP_TOKENS_SQL = f"SELECT doc_id, {Q.remove_stopwords(Q.tokens('text'))} AS tokens FROM documents"


@query("str_stopwords", sql=f"""
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens
FROM ({STOP_TOKENS_SQL})""")
def q_stopwords(spark, sf_dir):
    t = stop_tokens(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("str_ngrams", sql=f"""
SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT doc_id, {Q.ngrams2('tokens')} AS g FROM ({STOP_TOKENS_SQL}))""")
def q_ngrams(spark, sf_dir):
    g = T.ngrams("tokens", 2)
    return stop_tokens(spark, sf_dir).select("doc_id", F.size(g).alias("n_grams"),
                                            F.array_join(g, "|").alias("grams"))


@query("str_token_labels", sql=f"""
SELECT conv_id, string_agg(lbl, ' ' ORDER BY turn, pos) AS labelled
FROM (SELECT conv_id, turn, pos, tok || '_' || CAST(turn AS VARCHAR) AS lbl
      FROM (SELECT conv_id, turn, unnest(tk) AS tok, unnest(generate_series(1, len(tk))) AS pos
            FROM (SELECT conv_id, turn, {Q.tokens_ws('text')} AS tk FROM conversations)))
GROUP BY conv_id""")
def q_token_labels(spark, sf_dir):
    """Token occurrence labels ``token_turn``; each conversation rebuilt from them
    in (turn, position) order. Ordered collect = sort_array of structs."""
    c = S.read(spark, sf_dir, "conversations")
    labelled = c.select("conv_id", "turn", F.transform(T.tokenize_ws("text"),
                        lambda t: T.token_labels(t, F.col("turn"))).alias("lbl"))
    per_conv = labelled.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "lbl"))).alias("parts"))
    return per_conv.select("conv_id", F.array_join(F.flatten(F.transform("parts", lambda s: s["lbl"])), " ")
                           .alias("labelled"))


@query("str_strip_special", sql=f"""
SELECT doc_id, CAST(len(m) AS INTEGER) AS n, CAST(list_sum(m) AS INTEGER) AS n_attended,
       array_to_string(m, '') AS mask
FROM (SELECT doc_id, list_transform(generate_series(1, len(tk) + 2),
             lambda i: CASE WHEN i = 1 OR i = len(tk) + 2 THEN 0 ELSE 1 END) AS m
      FROM (SELECT doc_id, {Q.tokens_ws('text')} AS tk FROM documents))""")
def q_strip_special(spark, sf_dir):
    """Attention mask over [CLS] tokens [SEP] with the special ends zeroed."""
    d = S.read(spark, sf_dir, "documents")
    # project the raw mask first: lambdas must reference columns, not expressions
    raw = d.select("doc_id", F.array_repeat(F.lit(1), F.size(T.tokenize_ws("text")) + 2).alias("m"))
    masked = raw.select("doc_id", T.strip_special("m").alias("m"))
    return masked.select("doc_id", F.size("m").alias("n"),
                         F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("n_attended"),
                         F.array_join("m", "").alias("mask"))


@query("str_format_prediction", sql=S.with_sql(S.PREDS_MULTI_SQL) + """
SELECT id, format('Category: {}, Probability: {}%', 'class_' || CAST(prediction AS VARCHAR),
                  printf('%.2f', list_max(probs) * 100)) AS line
FROM preds_multi""")
def q_format_prediction(spark, sf_dir):
    pm = S.preds_multi(spark, sf_dir)
    return pm.select("id", T.format_prediction(F.concat(F.lit("class_"), F.col("prediction").cast("string")),
                                               F.array_max("probs")).alias("line"))
