"""Queries for token-vector operators (layer combination, span means, nBOW,
relaxed WMD), encoded-corpus preparation and LM accuracies, related-noun
perturbation, embedding alignment and topic-model timing.

Token vectors: a word maps to the ``embeddings`` row
``conv(md5(word)[0:8], 16) mod n`` (same integer in Spark and DuckDB)."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import vectors as VX
from textloom.operators import vocab as V
from textloom.operators.common import evaluate_once, materialize
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.strings import clean_tokens
from textloom.plans.vocab import CT_SQL, ENC_SQL, POS_SQL, VOCAB_SQL
from textloom.sources import tables as S

LAYERS, LAYER_W = 4, 16
#: Words of turns in a part of pairs.
PART_WORDS = 200_000


def word_vector_id(spark, sf_dir, word_col="word"):
    """The hashed embedding row of a word."""
    n = S.read(spark, sf_dir, "embeddings").count()
    return F.pmod(F.conv(F.substring(F.md5(F.col(word_col)), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def word_vectors(spark, sf_dir, words, word_col="word"):
    """Attach the hashed embedding row to each word."""
    e = S.read(spark, sf_dir, "embeddings")
    return words.withColumn("_vid", word_vector_id(spark, sf_dir, word_col)).join(e.select(F.col("vec_id").alias("_vid"), F.col("embedding").alias("v")), "_vid").drop("_vid")


WV_JOIN = "JOIN embeddings e ON e.vec_id = ('0x' || substr(md5({w}), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"


def _layer_sql(mode_expr: str, mode: str) -> str:
    return f"""SELECT vec_id AS id, '{mode}' AS mode, CAST(i - 1 AS INTEGER) AS dim, round(v[i], 6) AS value
FROM (SELECT vec_id, {mode_expr} AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
     LATERAL (SELECT unnest(generate_series(1, len(v))) AS i)"""


LAYER_SQL = " UNION ALL ".join([
    _layer_sql("x", "concat"),
    _layer_sql("list_transform(generate_series(1, 16), lambda j: (x[j] + x[16 + j] + x[32 + j] + x[48 + j]) / 4)", "average"),
    _layer_sql("list_transform(generate_series(1, 16), lambda j: x[j] + x[16 + j] + x[32 + j] + x[48 + j])", "sum"),
    _layer_sql("x[49:64]", "last"),
    _layer_sql("x[33:48]", "second_last"),
])


@query("vec_layer_combine", sql=LAYER_SQL)
def q_layer_combine(spark, sf_dir):
    """Each 64-dim vector as 4 layers of 16; top-4 layers combined by concat,
    average, sum, last and second-last."""
    e = S.read(spark, sf_dir, "embeddings")
    layers = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)),
                                            lambda l: F.slice(F.transform("embedding", lambda x: x.cast("double")),
                                                              l * LAYER_W + 1, LAYER_W)).alias("layers"))
    layers = evaluate_once(layers, "layers")
    outs = [layers.select("vec_id", F.lit(m).alias("mode"), VX.layer_combine("layers", m, 4).alias("v"))
            for m in ("concat", "average", "sum", "last", "second_last")]
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.select(F.col("vec_id").alias("id"), "mode", F.posexplode("v").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("vec_word_span_mean", sql=f"""
WITH t AS (SELECT item_id, unnest(tk) AS word, unnest(generate_series(0, len(tk) - 1)) AS pos, tk[1] AS w0
           FROM (SELECT item_id, {Q.tokens('lower(text)')} AS tk FROM benchmark)),
tv AS (SELECT t.*, CAST(e.embedding AS DOUBLE[]) AS v FROM t JOIN embeddings e
       ON e.vec_id = (t.item_id * 7 + t.pos) % (SELECT count(*) FROM embeddings)),
k AS (SELECT item_id, 'sentence' AS kind, v FROM tv UNION ALL SELECT item_id, 'word' AS kind, v FROM tv WHERE word = w0)
SELECT item_id, kind, CAST(i - 1 AS INTEGER) AS dim, round(avg(v[i]), 6) AS value
FROM (SELECT item_id, kind, v, unnest(generate_series(1, len(v))) AS i FROM k) GROUP BY item_id, kind, i""")
def q_word_span_mean(spark, sf_dir):
    """Mean token vector of a word's positions in a text (the text's first
    word) and of the whole text; token i of text t uses embedding (7t + i) mod n."""
    b = S.read(spark, sf_dir, "benchmark")
    e = S.read(spark, sf_dir, "embeddings")
    n = e.count()
    tok = b.select("item_id", F.posexplode(T.tokenize_words("text", lower=True)).alias("pos", "word"))
    first = tok.where(F.col("pos") == 0).select("item_id", F.col("word").alias("w0"))
    tv = tok.join(first, "item_id").withColumn("_vid", F.pmod(F.col("item_id") * 7 + F.col("pos"), F.lit(n))).join(
        e.select(F.col("vec_id").alias("_vid"), F.col("embedding").alias("v")), "_vid")
    k = tv.select("item_id", F.lit("sentence").alias("kind"), "v").unionByName(
        tv.where(F.col("word") == F.col("w0")).select("item_id", F.lit("word").alias("kind"), "v"))
    m = VX.mean_vector(k, ["item_id", "kind"], "v")
    return m.select("item_id", "kind", F.posexplode("mean").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("vec_nbow", sql=f"""WITH {CT_SQL}
SELECT doc_id, word, round(ln(1 + cnt) / sum(ln(1 + cnt)) OVER (PARTITION BY doc_id), 6) AS weight FROM (
  SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest(tokens) AS word FROM ct) GROUP BY doc_id, word)""")
def q_nbow(spark, sf_dir):
    """nBOW weights: ln(1 + tf) normalised to sum 1 per document."""
    tf = V.term_frequencies(clean_tokens(spark, sf_dir, S.documents_by_id(spark, sf_dir)), "doc_id", "tokens")
    return VX.nbow(tf, "doc_id", "term", "tf").select("doc_id", F.col("term").alias("word"),
                                                      F.round("weight", 6).alias("weight"))


RWMD_SQL = f"""
WITH pairs AS (SELECT conv_id, turn AS ta, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS tb FROM conversations),
w AS (SELECT conv_id, turn, word, ln(1 + cnt) / sum(ln(1 + cnt)) OVER (PARTITION BY conv_id, turn) AS wt FROM (
        SELECT conv_id, turn, word, count(*) AS cnt FROM (
          SELECT conv_id, turn, unnest({Q.tokens('lower(text)')}) AS word FROM conversations) GROUP BY conv_id, turn, word)),
wv AS (SELECT w.*, CAST(e.embedding AS DOUBLE[]) AS v FROM w {WV_JOIN.format(w='w.word')}),
d AS (SELECT p.conv_id, p.ta, p.tb, a.word AS wa, a.wt AS wta, b.word AS wb, b.wt AS wtb, list_distance(a.v, b.v) AS dist
      FROM pairs p JOIN wv a ON a.conv_id = p.conv_id AND a.turn = p.ta JOIN wv b ON b.conv_id = p.conv_id AND b.turn = p.tb
      WHERE p.tb IS NOT NULL),
ab AS (SELECT conv_id, ta, tb, sum(wta * md) AS x FROM (SELECT conv_id, ta, tb, wa, any_value(wta) AS wta, min(dist) AS md
       FROM d GROUP BY conv_id, ta, tb, wa) GROUP BY conv_id, ta, tb),
ba AS (SELECT conv_id, ta, tb, sum(wtb * md) AS x FROM (SELECT conv_id, ta, tb, wb, any_value(wtb) AS wtb, min(dist) AS md
       FROM d GROUP BY conv_id, ta, tb, wb) GROUP BY conv_id, ta, tb)
SELECT conv_id, ta, tb, round(greatest(ab.x, ba.x), 6) AS rwmd FROM ab JOIN ba USING (conv_id, ta, tb)"""


@query("vec_relaxed_wmd", sql=RWMD_SQL)
def q_relaxed_wmd(spark, sf_dir):
    """Relaxed word mover's distance between each conversation turn and the
    next: per direction the nBOW-weighted sum of each word's distance to the
    nearest word of the other text; the larger direction is the bound.
    A turn moves as (vector id, weight) of its words; pairs of turns are dealt into parts,
    and a part gets each vector it needs once."""
    c = S.read(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", F.col("turn").alias("ta"),
                     F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("tb")).where(
        F.col("tb").isNotNull()).groupBy("conv_id", "ta", "tb").agg(F.count(F.lit(1)).alias("m"))
    # texts move once; a turn's words are counted and weighted in place
    texts = c.select("conv_id", "turn", "text").repartition("conv_id", "turn")
    toks = texts.select("conv_id", "turn", F.explode(T.tokenize_words("text", lower=True)).alias("word"))
    tf = toks.groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("tf"))
    w = VX.nbow(tf, ["conv_id", "turn"], "word", "tf")
    turns = materialize(w.select("conv_id", "turn", F.struct(word_vector_id(spark, sf_dir).alias("vid"), "weight").alias("x"))
                        .groupBy("conv_id", "turn").agg(F.collect_list("x").alias("x")))
    parts = max(1, ceil((turns.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0) / PART_WORDS))
    a, b = (turns.select("conv_id", F.col("turn").alias(f"t{k}"), F.col("x").alias(k)) for k in "ab")
    both = pairs.join(a, ["conv_id", "ta"]).join(b, ["conv_id", "tb"]).withColumn(
        "part", F.pmod(F.xxhash64("conv_id", "ta", "tb"), F.lit(parts)))
    rows = both.select("part", "conv_id", "ta", "tb", "m", *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in "ab" for f in ("vid", "weight")])
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v"))
    vectors = rows.select(F.col("part").alias("to"), F.explode(F.array_union("a_vid", "b_vid")).alias("vid")).distinct().join(e, "vid")
    return (rows.groupBy("part").cogroup(vectors.groupBy("to"))
            .applyInPandas(_rwmd, "conv_id long, ta long, tb long, rwmd double"))


def _rwmd(rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """The bound of each pair of turns of a part. Words without a vector are left out; one with
    several counts with each, and a pair that comes ``m`` times counts so often."""
    vectors = vectors.sort_values("vid", kind="stable")
    ids = vectors["vid"].to_numpy()
    known = np.stack([np.asarray(v, dtype=np.float64) for v in vectors["v"]]) if len(vectors) else np.zeros((0, 0))

    def side(vid, weight):
        low, high = np.searchsorted(ids, vid), np.searchsorted(ids, vid, "right")
        at = np.concatenate([np.arange(x, y) for x, y in zip(low, high)]).astype(np.int64)
        return known[at], np.repeat(weight, high - low)

    out = []
    for r in rows.itertuples():
        (va, wa), (vb, wb) = side(r.a_vid, r.a_weight), side(r.b_vid, r.b_weight)
        if len(wa) and len(wb):
            d = VX._distances(va, vb)
            bound = max(float((wa * d.min(1)).sum()), float((wb * d.min(0)).sum()))
            out.append((r.conv_id, r.ta, r.tb, round(bound * r.m, 6)))
    return pd.DataFrame(out, columns=["conv_id", "ta", "tb", "rwmd"])


SPLIT_NOTES = S.with_sql(S.NOTES_SQL, """split3 AS (
  SELECT *, CASE WHEN r <= n_v THEN 'valid' WHEN r <= n_s THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '41', CAST(id AS VARCHAR))), id) AS r,
               round_even(round_even(count(*) OVER () * 0.8, 0) * 0.25, 0) AS n_v,
               round_even(count(*) OVER () * 0.8, 0) AS n_s
        FROM notes WHERE severity IS NOT NULL))""")


@query("corp_encode_sentences", sql=SPLIT_NOTES.rstrip() + f""",
cta AS (SELECT id AS doc_id, split, CAST(severity - 1 AS INTEGER) AS label, {Q.tokens(Q.clean_note('IN07'))} AS tokens FROM split3),
ct AS (SELECT doc_id, tokens FROM cta WHERE split = 'train'),
{POS_SQL}, {VOCAB_SQL},
allpos AS (SELECT doc_id, unnest(tokens) AS word, unnest(generate_series(0, len(tokens) - 1)) AS p FROM cta),
enc AS (SELECT cta.doc_id, coalesce(e.ids, []) AS ids FROM cta LEFT JOIN (
          SELECT allpos.doc_id, list(coalesce(v.id, (SELECT id FROM vocab WHERE word = '<unk>')) ORDER BY allpos.p) AS ids
          FROM allpos LEFT JOIN (SELECT * FROM vocab WHERE word NOT IN ('<pad>', '<unk>')) v ON allpos.word = v.word
          GROUP BY allpos.doc_id) e ON cta.doc_id = e.doc_id)
SELECT cta.doc_id AS id, split, label, CAST(least(len(ids), 50) AS INTEGER) AS length,
       array_to_string(list_concat(ids[1:50], list_transform(generate_series(1, 50 - least(len(ids), 50)), lambda x: 0)), ' ') AS padded
FROM cta JOIN enc USING (doc_id)""")
def q_encode_sentences(spark, sf_dir):
    """End to end: clean, tokenise, vocabulary from train only, encode every
    split, pad to 50, true lengths, 0-based labels."""
    from textloom.operators.sampling import three_way_split
    n = S.notes(spark, sf_dir).where(F.col("severity").isNotNull())
    s = three_way_split(n, "id", seed=41)
    ct = evaluate_once(s.select(F.col("id").alias("doc_id"), "split", (F.col("severity") - 1).cast("int").alias("label"),
                                T.tokenize_words(T.clean_note("IN07")).alias("tokens")), "tokens")
    vocab = V.vocabulary(ct.where(F.col("split") == "train"), min_word_count=5)
    enc = V.pad_encoded(V.encode(ct, vocab), "ids", 50)
    return ct.join(enc, "doc_id").select(F.col("doc_id").alias("id"), "split", "label", "length",
                                         F.array_join("padded", " ").alias("padded"))


ENCODE_DOCUMENTS_SQL = f"""
WITH ln AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS sent
            FROM (SELECT doc_id, {Q.split_lines('text')} AS lines FROM documents)),
s AS (SELECT doc_id, sent, ({Q.tokens('lower(line)')})[1:20] AS tokens FROM ln WHERE sent <= 15),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS r FROM s WHERE len(tokens) > 0),
pos AS (SELECT doc_id, r, unnest(tokens) AS word, unnest(generate_series(1, len(tokens))) AS p FROM k),
wc AS (SELECT word, count(*) AS cnt, min((doc_id, r, p)) AS first FROM pos GROUP BY word HAVING count(*) >= 5),
vocab AS (SELECT word, row_number() OVER (ORDER BY first) AS id FROM wc),
enc AS (SELECT pos.doc_id, r, list(coalesce(id, (SELECT count(*) + 1 FROM vocab)) ORDER BY p) AS ids
        FROM pos LEFT JOIN vocab USING (word) GROUP BY pos.doc_id, r),
pad AS (SELECT doc_id, r, len(ids) AS n, list_concat(ids, list_transform(range(20 - len(ids)), lambda x: 0)) AS ids FROM enc)
SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS label, CAST(count(*) AS INTEGER) AS sentences_per_document,
       array_to_string(list(n ORDER BY r), ' ') || repeat(' 0', CAST(15 - count(*) AS INTEGER)) AS words_per_sentence,
       array_to_string(list(array_to_string(ids, ' ') ORDER BY r), '|')
         || repeat('|' || array_to_string(list_transform(range(20), lambda x: 0), ' '), CAST(15 - count(*) AS INTEGER)) AS docs
FROM pad GROUP BY doc_id"""


@query("corp_encode_documents", sql=ENCODE_DOCUMENTS_SQL)
def q_encode_documents(spark, sf_dir):
    """Documents as lines of words: the first 15 lines, 20 words each, empty ones
    dropped; vocabulary from the words inside these limits; ids nested per sentence and
    padded to 15 x 20; true sentence and word counts; the label."""
    n_sent, n_word = 15, 20
    d = S.read(spark, sf_dir, "documents")
    lines = F.transform(F.slice(T.split_lines("text"), 1, n_sent),
                        lambda x: T.tokenize_words(x, word_limit=n_word, lower=True))
    sents = evaluate_once(d.select("doc_id", F.filter(lines, lambda t: F.size(t) > 0).alias("sents")), "sents")
    flat = sents.select("doc_id", F.flatten("sents").alias("tokens"))
    enc = V.encode(flat, V.vocabulary(flat, min_word_count=5))
    j = sents.where(F.size("sents") > 0).join(enc, "doc_id")
    # each sentence takes its stretch of the document's ids
    sizes = F.transform("sents", lambda t: F.size(t))
    ends = F.transform(F.sequence(F.lit(1), F.size("sents")), lambda i: F.aggregate(
        F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x))
    j = evaluate_once(j.withColumn("sizes", sizes), "sizes")
    j = evaluate_once(j.withColumn("ends", ends), "ends")
    cut = F.zip_with("sizes", "ends", lambda n, e: F.struct(n.alias("n"), e.alias("e")))
    rows = F.transform(cut, lambda s: F.array_join(F.concat(
        F.slice("ids", s["e"] - s["n"] + 1, s["n"]), F.array_repeat(F.lit(0), n_word - s["n"])), " "))
    blank = F.array_repeat(F.lit(" ".join(["0"] * n_word)), n_sent - F.size("sizes"))
    return j.select("doc_id", F.pmod("doc_id", F.lit(4)).cast("int").alias("label"),
                    F.size("sizes").alias("sentences_per_document"),
                    F.array_join(F.concat("sizes", F.array_repeat(F.lit(0), n_sent - F.size("sizes"))), " ").alias("words_per_sentence"),
                    F.array_join(F.concat(rows, blank), "|").alias("docs"))


LM_SQL = f"WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL}, {ENC_SQL},\n"


@query("met_mlm_accuracy", sql=LM_SQL + """
x AS (SELECT ids[i] AS label, CASE WHEN i = 1 THEN 0 ELSE ids[i - 1] END AS pred
      FROM (SELECT ids, unnest(generate_series(1, len(ids))) AS i FROM enc) WHERE (i - 1) % 7 = 3)
SELECT count(*) AS n_selected, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM x""")
def q_mlm_accuracy(spark, sf_dir):
    """Share of labelled positions (every 7th, others -100) predicted right;
    predictions of a previous-token model."""
    ct = clean_tokens(spark, sf_dir)
    enc = V.encode(ct, V.vocabulary(ct, min_word_count=5))
    lab = F.transform("ids", lambda x, i: F.when(F.pmod(i, F.lit(7)) == 3, x).otherwise(F.lit(-100)))
    pred = F.transform("ids", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("ids"), i)))
    m = enc.select(lab.alias("labels"), pred.alias("preds"))
    return VX.mlm_accuracy(m, "labels", "preds")


@query("met_clm_accuracy", sql=LM_SQL + """
x AS (SELECT ids[i] AS label, ids[i - 1] AS pred FROM (SELECT ids, unnest(generate_series(2, len(ids))) AS i FROM enc))
SELECT count(*) AS n, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM x""")
def q_clm_accuracy(spark, sf_dir):
    """Next-token accuracy: labels from position 1 against predictions up to
    n-1 (a copy model predicts the current token as the next)."""
    ct = clean_tokens(spark, sf_dir)
    enc = V.encode(ct, V.vocabulary(ct, min_word_count=5))
    return VX.clm_accuracy(enc.select(F.col("ids").alias("labels"), F.col("ids").alias("preds")), "labels", "preds")


@query("beh_related_noun", sql=f"""WITH {CT_SQL},
bi AS (SELECT a, b, count(*) AS n FROM (
         SELECT unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i])) AS a,
                unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i + 1])) AS b
         FROM ct WHERE len(tokens) >= 2) GROUP BY a, b),
rel AS (SELECT * FROM (SELECT a AS word, b AS related, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM bi) WHERE r <= 5),
words AS (SELECT DISTINCT word FROM rel),
tk AS (SELECT item_id, {Q.tokens(Q.clean_note('text'))} AS tk FROM benchmark),
ps AS (SELECT item_id, unnest(tk) AS word, unnest(generate_series(1, len(tk))) AS i FROM tk),
hit AS (SELECT item_id, min(i) AS p FROM ps SEMI JOIN words USING (word) GROUP BY item_id),
one AS (SELECT item_id, tk, p, tk[p] AS word FROM hit JOIN tk USING (item_id))
SELECT one.item_id AS case_id, CAST(rel.r AS INTEGER) AS variant,
       array_to_string(list_transform(generate_series(1, len(tk)), lambda i: CASE WHEN i = p THEN rel.related ELSE tk[i] END), ' ') AS text
FROM one JOIN rel USING (word)""")
def q_related_noun(spark, sf_dir):
    """The first word of a text that has related words (its most frequent
    corpus successors) replaced by each of up to 5 of them."""
    ct = clean_tokens(spark, sf_dir)
    bi = (ct.select(F.explode(V.adjacent_pairs("tokens")).alias("p"))
          .groupBy(F.col("p.a").alias("word"), F.col("p.b").alias("related")).agg(F.count(F.lit(1)).alias("n")))
    rel = bi.withColumn("variant", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "related"))).where(
        F.col("variant") <= 5)
    b = S.read(spark, sf_dir, "benchmark").select("item_id", T.tokenize_words(T.clean_note("text")).alias("tk"))
    tok = b.select("item_id", F.posexplode("tk").alias("p", "word"))
    first = tok.join(rel.select("word").distinct(), "word").groupBy("item_id").agg(F.min("p").alias("p"))
    hit = first.join(tok, ["item_id", "p"]).join(b, "item_id")
    var = hit.join(rel, "word")
    text = F.array_join(F.transform("tk", lambda x, i: F.when(i == F.col("p"), F.col("related")).otherwise(x)), " ")
    return var.select(F.col("item_id").alias("case_id"), F.col("variant").cast("int"), text.alias("text"))


ALIGN_SQL = f"""WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL},
b AS (SELECT DISTINCT unnest({Q.tokens(Q.clean_note('text'))}) AS word FROM benchmark),
pre AS (SELECT b.word, e.embedding AS v FROM b {WV_JOIN.format(w='b.word')}),
j AS (SELECT vocab.word, vocab.id, pre.v, unnest(generate_series(1, 64)) AS i FROM vocab LEFT JOIN pre USING (word))
SELECT word, id, v IS NOT NULL AS pretrained, CAST(i - 1 AS INTEGER) AS dim,
       round(CASE WHEN v IS NOT NULL THEN CAST(v[i] AS DOUBLE)
             ELSE (CAST('0x' || substr(md5('42|' || word || '|' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * 2 - 1)
                  * sqrt(3.0 / 64) END, 6) AS value FROM j"""


@query("join_embedding_align", sql=ALIGN_SQL)
def q_embedding_align(spark, sf_dir):
    """Vocabulary aligned with a pretrained vector file (benchmark words with
    hashed vectors); words absent from it get U(-sqrt(3/d), sqrt(3/d))."""
    ct = clean_tokens(spark, sf_dir)
    vocab = V.vocabulary(ct, min_word_count=5)
    b = S.read(spark, sf_dir, "benchmark").select(F.explode(T.tokenize_words(T.clean_note("text"))).alias("word")).distinct()
    pre = word_vectors(spark, sf_dir, b)
    aligned = VX.align_vectors(vocab, pre, 64, seed=42)
    return aligned.select("word", "id", "pretrained", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("top_computation", sql="""
SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS vocab_size, round(avg(value), 6) AS seconds, count(*) AS n_runs
FROM events GROUP BY event_type, user_id % 5""")
def q_computation(spark, sf_dir):
    """Mean fit time by (model, vocabulary size) over a table of runs; the ``events``
    table stands in for the runs (type, user group, value)."""
    e = S.read(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(5)).cast("int").alias("vocab_size"),
                    F.col("value").alias("seconds"))
    return runs.groupBy("model", "vocab_size").agg(F.round(F.avg("seconds"), 6).alias("seconds"),
                                                   F.count(F.lit(1)).alias("n_runs"))
