"""Queries for counts, vocabulary, encoding, TF / TF-IDF and phrases
(inventory 2.3 encode join, 2.4 vocabulary rows, 2.6 padding / merge)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicon import stop_words
from textloom.operators import counting
from textloom.operators import vocab as V
from textloom.operators.common import drop_stopwords, evaluate_once, with_one_row
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.strings import STOP_TOKENS_SQL, clean_tokens, stop_tokens
from textloom.sources import tables as S

CT_SQL = f"ct AS (SELECT doc_id, {Q.tokens(Q.clean_note('text'))} AS tokens FROM documents WHERE text IS NOT NULL)"
POS_SQL = "pos AS (SELECT doc_id, unnest(tokens) AS word, unnest(generate_series(0, len(tokens) - 1)) AS p FROM ct)"
VOCAB_SQL = """vocab AS (
  SELECT word, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS id, cnt
  FROM (SELECT word, CAST(count(*) AS BIGINT) AS cnt, min(doc_id * 1000000 + p) AS first FROM pos GROUP BY word)
  WHERE cnt >= 5
  UNION ALL SELECT '<pad>', 0, CAST(0 AS BIGINT)
  UNION ALL SELECT '<unk>', CAST((SELECT count(*) FROM (SELECT word FROM pos GROUP BY word HAVING count(*) >= 5)) + 1 AS INTEGER),
                   CAST(0 AS BIGINT))"""
ENC_SQL = """enc AS (
  SELECT ct.doc_id, coalesce(e.ids, []) AS ids FROM ct LEFT JOIN (
    SELECT pos.doc_id, list(coalesce(v.id, (SELECT id FROM vocab WHERE word = '<unk>')) ORDER BY pos.p) AS ids
    FROM pos LEFT JOIN (SELECT * FROM vocab WHERE word NOT IN ('<pad>', '<unk>')) v ON pos.word = v.word
    GROUP BY pos.doc_id) e ON ct.doc_id = e.doc_id)"""


@query("agg_word_count", sql=f"""WITH {CT_SQL}
SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(tokens) AS word FROM ct) GROUP BY word""")
def q_word_count(spark, sf_dir):
    return counting.word_counts(clean_tokens(spark, sf_dir))


@query("agg_vocab", sql=f"WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL} SELECT * FROM vocab")
def q_vocab(spark, sf_dir):
    return V.vocabulary(clean_tokens(spark, sf_dir), min_word_count=5)


@query("agg_vocab_stats", sql=f"""WITH {CT_SQL}
SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS freq_rank,
       (SELECT count(*) FROM ct) AS n_docs
FROM (SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(tokens) AS word FROM ct) GROUP BY word)""")
def q_vocab_stats(spark, sf_dir):
    """Vocabulary sorted by frequency (distributed rank), with the document count."""
    from textloom.operators.ordering import ordered_prefix
    ct = clean_tokens(spark, sf_dir)
    r = ordered_prefix(counting.word_counts(ct), ["cnt", "word"], rank_col="freq_rank", descending=True)
    n_docs = S.read(spark, sf_dir, "documents").where(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"))
    return with_one_row(r, n_docs)


@query("agg_vocab_overlap", sql=f"""
WITH a AS (SELECT DISTINCT unnest({Q.tokens('lower(text)')}) AS w FROM documents),
     b AS (SELECT DISTINCT unnest({Q.tokens('lower(text)')}) AS w FROM conversations)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
       (SELECT count(*) FROM a JOIN b USING (w)) AS n_both,
       (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)) AS n_union,
       round((SELECT count(*) FROM a JOIN b USING (w)) / (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)), 6) AS overlap""")
def q_vocab_overlap(spark, sf_dir):
    a = S.read(spark, sf_dir, "documents").select(F.explode(T.tokenize_words("text", lower=True)).alias("w"))
    b = S.read(spark, sf_dir, "conversations").select(F.explode(T.tokenize_words("text", lower=True)).alias("w"))
    return counting.vocab_overlap(a, b, "w")


def _grams(spark, sf_dir):
    tokens = stop_tokens(spark, sf_dir, S.documents_by_id(spark, sf_dir))
    return evaluate_once(tokens.select("doc_id", T.ngrams("tokens", 2).alias("terms")), "terms")


#: The train split of the supplied documents: three of five ids, as in ``preds``.
TRAIN = "doc_id % 5 > 1"

GRAMS_SQL = f"""grams AS (SELECT doc_id, {Q.ngrams2('tokens')} AS terms FROM ({STOP_TOKENS_SQL})),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM grams)
       GROUP BY doc_id, term),
tv AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf WHERE doc_id % 5 > 1 GROUP BY term ORDER BY cf DESC, term LIMIT 50000)"""


@query("agg_tf", sql=f"WITH {GRAMS_SQL} SELECT tf.doc_id, tf.term, tf.tf FROM tf JOIN tv USING (term)")
def q_tf(spark, sf_dir):
    """Counts of all splits over the vocabulary fitted on train."""
    tf = V.term_frequencies(_grams(spark, sf_dir))                # counted twice: cheaper than kept
    vocab = F.broadcast(V.top_terms(tf.where(TRAIN), 50000))      # at most max_features rows
    return V.count_vectors(tf, vocab).select("doc_id", "term", "tf")


@query("agg_tfidf", sql=f"""WITH {GRAMS_SQL},
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1 + (SELECT count(*) FROM grams WHERE doc_id % 5 > 1)) / (1 + tv.df)) + 1) AS w
      FROM tf JOIN tv USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""")
def q_tfidf(spark, sf_dir):
    """TF-IDF of all splits with vocabulary and document frequencies fitted on train."""
    g = _grams(spark, sf_dir)
    tf = V.term_frequencies(g)                                    # counted twice: cheaper than kept
    n_docs = S.read(spark, sf_dir, "documents").where(TRAIN).agg(F.count(F.lit(1)).alias("_nd"))
    vocab = with_one_row(V.top_terms(tf.where(TRAIN), 50000), n_docs)
    out = V.tfidf(tf, F.broadcast(vocab), F.col("_nd"))           # at most max_features rows
    return out.withColumn("tfidf", F.round("tfidf", 6))


def w2v_sentences(spark, sf_dir):
    """Word-vector corpus: letters-only lower text, stop words out, > 2 tokens."""
    d = S.read(spark, sf_dir, "documents")
    t = d.select("doc_id", T.alpha_words("text").alias("raw"))
    tokens = drop_stopwords(t, "raw", "tokens", stop_words()).select("doc_id", "tokens")
    return evaluate_once(tokens, "tokens").where(F.size("tokens") > 2)


W2V_SQL = f"""s AS (SELECT doc_id, tokens FROM (
  SELECT doc_id, {Q.remove_stopwords(Q.tokens_ws("lower(regexp_replace(text, '[^A-Za-z'']+', ' ', 'g'))"))} AS tokens
  FROM documents) WHERE len(tokens) > 2)"""


def _phrases_sql(min_count: int) -> str:
    return f"""{W2V_SQL},
uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM s) GROUP BY w),
bi AS (SELECT a, b, count(*) AS n_ab FROM (
         SELECT unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i])) AS a,
                unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i + 1])) AS b
         FROM s) GROUP BY a, b),
ph AS (SELECT * FROM (
  SELECT bi.a, bi.b, bi.n_ab,
         CAST(bi.n_ab - {min_count} AS DOUBLE) / (ua.n * ub.n) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi)) AS score
  FROM bi JOIN uni ua ON bi.a = ua.w JOIN uni ub ON bi.b = ub.w)
WHERE score > 10)"""


@query("agg_phrase_scores", sql=f"""WITH {_phrases_sql(30)}
SELECT a, b, CAST(n_ab AS BIGINT) AS n_ab, round(score, 6) AS score FROM ph""")
def q_phrase_scores(spark, sf_dir):
    ph = V.phrase_scores(w2v_sentences(spark, sf_dir), min_count=30, threshold=10.0)
    return ph.withColumn("score", F.round("score", 6))


@query("str_merge_phrases", sql=f"""WITH {_phrases_sql(5)},
tk AS (SELECT doc_id, unnest(tokens) AS w, unnest(generate_series(1, len(tokens))) AS i FROM s),
nx AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM tk),
hit AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM nx WHERE (w, next) IN (SELECT (a, b) FROM ph)),
took AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM hit)
         WHERE k % 2 = 1),
mg AS (SELECT nx.doc_id, nx.i, CASE WHEN t.i IS NULL THEN w ELSE w || '_' || next END AS w
       FROM nx LEFT JOIN took t USING (doc_id, i) LEFT JOIN took p ON p.doc_id = nx.doc_id AND p.i = nx.i - 1
       WHERE p.i IS NULL)
SELECT s.doc_id, CAST(any_value(len(s.tokens)) AS INTEGER) AS n_tokens, CAST(count(*) AS INTEGER) AS n_merged,
       string_agg(mg.w, ' ' ORDER BY mg.i) AS merged
FROM s JOIN mg USING (doc_id) GROUP BY s.doc_id""")
def q_merge_phrases(spark, sf_dir):
    """Greedy merge of accepted bigrams (min_count lowered to 5 so phrases exist)."""
    s = w2v_sentences(spark, sf_dir)
    ph = V.phrase_scores(s, min_count=5, threshold=10.0)
    m = V.merge_phrases(s, ph)
    return m.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("merged").alias("n_merged"),
                    F.array_join("merged", " ").alias("merged"))


@query("join_vocab_encode", sql=f"""WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL}, {ENC_SQL}
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS ids FROM enc""")
def q_vocab_encode(spark, sf_dir):
    ct = clean_tokens(spark, sf_dir)
    enc = V.encode(ct, V.vocabulary(ct, min_word_count=5))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@query("str_pad_truncate", sql=f"""WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL}, {ENC_SQL}
SELECT doc_id, CAST(least(len(ids), 50) AS INTEGER) AS length,
       array_to_string(list_concat(ids[1:50], list_transform(generate_series(1, 50 - least(len(ids), 50)), lambda x: 0)), ' ') AS padded
FROM enc""")
def q_pad_truncate(spark, sf_dir):
    ct = clean_tokens(spark, sf_dir)
    enc = V.pad_encoded(V.encode(ct, V.vocabulary(ct, min_word_count=5)), "ids", 50)
    return enc.select("doc_id", "length", F.array_join("padded", " ").alias("padded"))
