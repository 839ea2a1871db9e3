"""Queries for training-corpus construction (inventory 2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.operators import vocab as V
from textloom.operators.common import evaluate_once
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.strings import clean_tokens
from textloom.plans.vocab import CT_SQL, ENC_SQL, POS_SQL, VOCAB_SQL
from textloom.sources import tables as S

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def ws_tokens(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    return evaluate_once(d.select("doc_id", T.tokenize_ws("text").alias("tokens")), "tokens")


BLOCK_SQL = f"""
WITH d AS (SELECT doc_id, {Q.tokens_ws('text')} AS tk FROM documents),
r AS (SELECT *, len(tk) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM d),
t AS (SELECT batch, doc_id, unnest(tk) AS tok, unnest(generate_series(1, n)) AS p FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id, p) - 1 AS o,
             count(*) OVER (PARTITION BY batch) // 512 AS full_blocks FROM t)
SELECT CAST(batch AS BIGINT) AS batch, CAST(o // 512 AS BIGINT) AS block, count(*) AS n_tokens,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc, string_agg(md5(tok)[1:4], '' ORDER BY o) AS ids, ids AS labels
FROM o WHERE o // 512 < full_blocks GROUP BY batch, o // 512"""


@query("corp_block_group", sql=BLOCK_SQL)
def q_block_group(spark, sf_dir):
    """LM blocks: 1000-document batches, 512-token blocks, batch tails dropped; the ids of
    a block (4 hex digits of each token's hash) and its labels, which are the same."""
    t = ws_tokens(spark, sf_dir).withColumn("ids", F.transform("tokens", lambda x: F.substring(F.md5(x), 1, 4)))
    layout = C.block_group(t.select("doc_id", F.size("tokens").alias("n_tokens")), batch_docs=1000, block_size=512)
    got = C.blocks(layout).join(C.block_ids(layout, t), ["batch", "block"])
    ids = F.array_join("input_ids", "")
    return got.select("batch", "block", "n_tokens", "first_doc", "last_doc", ids.alias("ids"), ids.alias("labels"))


def _u_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


MLM_SQL = f"""WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL}, {ENC_SQL},
nv AS (SELECT count(*) AS nv FROM vocab),
x AS (SELECT doc_id, unnest(ids) AS x, unnest(generate_series(0, len(ids) - 1)) AS i FROM enc),
y AS (SELECT doc_id, i, x, x <> 0 AND {_u_sql("'42'", 'doc_id::VARCHAR', 'i::VARCHAR', "'pick'")} < 0.15 AS sel,
             {_u_sql("'42'", 'doc_id::VARCHAR', 'i::VARCHAR', "'kind'")} AS u,
             CAST(floor({_u_sql("'42'", 'doc_id::VARCHAR', 'i::VARCHAR', "'id'")} * nv) AS INTEGER) AS rnd, nv FROM x, nv)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n,
       string_agg(CAST(CASE WHEN NOT sel THEN x WHEN u < 0.8 THEN nv WHEN u < 0.9 THEN rnd ELSE x END AS VARCHAR), ' ' ORDER BY i) AS inputs,
       string_agg(CASE WHEN sel THEN CAST(x AS VARCHAR) ELSE '-100' END, ' ' ORDER BY i) AS labels
FROM y GROUP BY doc_id"""


@query("corp_mlm_mask", sql=MLM_SQL)
def q_mlm_mask(spark, sf_dir):
    """Masked-LM inputs and labels over vocabulary-encoded documents."""
    ct = clean_tokens(spark, sf_dir)
    vocab = V.vocabulary(ct, min_word_count=5)
    size = vocab.agg(F.count(F.lit(1)).cast("int").alias("nv")).withColumn("_one", F.lit(1))
    enc = V.encode(ct, vocab).withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one")
    inputs, labels = C.mlm_mask("ids", "doc_id", mask_id=F.col("nv"), vocab_size=F.col("nv"), special_ids=(0,))
    return enc.where(F.size("ids") > 0).select("doc_id", F.size("ids").alias("n"), F.array_join(inputs, " ").alias("inputs"),
                                               F.array_join(labels, " ").alias("labels"))


def _spans(spark, sf_dir, strategy=None):
    return C.sample_spans(ws_tokens(spark, sf_dir), "tokens", "doc_id", num_anchors=2, num_positives=2,
                          max_span_len=16, min_span_len=8, strategy=strategy)


def _order_sql(k: int, *parts: str) -> str:
    draws = ", ".join(_u_sql(*parts, f"'{i}'") for i in range(5))
    return f"list_sort([{draws}])[{k}]"


def _span_sql(strategy: str | None, where: str = "") -> str:
    """The sampling rule in SQL for A = 2, P = 2, 8 to 16 tokens."""
    key = ("'42'", "doc_id::VARCHAR", "a::VARCHAR")
    pkey = (*key, "j::VARCHAR")
    most = {"subsuming": "a_len", "adjacent": "least(16, greatest(a_start, n - a_end))"}.get(strategy, "16")
    u = _u_sql(*pkey, "'start'")
    first, last = ("a_start", "a_end - p_len") if strategy == "subsuming" else (
        "greatest(0, a_start - p_len)", "least(a_end, n - p_len)")
    start = (f"CASE WHEN a_start >= p_len AND a_end + p_len <= n THEN CASE WHEN {u} < 0.5 THEN a_start - p_len ELSE a_end END "
             "WHEN a_start >= p_len THEN a_start - p_len WHEN a_end + p_len <= n THEN a_end END"
             if strategy == "adjacent" else f"{first} + floor({u} * ({last} - {first} + 1))")
    return f"""
WITH d AS (SELECT doc_id, tk, len(tk) AS n FROM (SELECT doc_id, {Q.tokens_ws('text')} AS tk FROM documents) WHERE len(tk) >= 64),
e AS (SELECT *, (n // 16) // 2 AS w, unnest([0, 1]) AS a FROM d),
f AS (SELECT *, floor({_order_sql(4, *key, "'len'")} * 8 + 8) AS a_len, a * w + floor({_u_sql(*key, "'slot'")} * (w - 1)) AS slot FROM e),
g AS (SELECT *, slot * 16 + floor({_u_sql(*key, "'start'")} * (16 - a_len + 1)) AS a_start FROM f),
h AS (SELECT *, a_start + a_len AS a_end FROM g),
p AS (SELECT *, unnest([1, 2]) AS j FROM h),
q AS (SELECT *, floor({_order_sql(2, *pkey, "'len'")} * ({most} - 8) + 8) AS p_len FROM p),
s AS (SELECT doc_id, a AS anchor_id, 'anchor' AS kind, 0 AS span_no, a_start AS start, a_len AS len, tk FROM h
      UNION ALL SELECT doc_id, a, 'positive', j, {start}, p_len, tk FROM q)
SELECT doc_id, CAST(anchor_id AS INTEGER) AS anchor_id, kind, CAST(span_no AS INTEGER) AS span_no, CAST(start AS INTEGER) AS start,
       CAST(len AS INTEGER) AS len, CASE WHEN start IS NOT NULL
         THEN array_to_string(tk[CAST(start + 1 AS BIGINT):CAST(start + len AS BIGINT)], ' ') END AS text
FROM s {where}"""


@query("corp_span_anchor", sql=_span_sql(None, "WHERE kind = 'anchor'"))
def q_span_anchor(spark, sf_dir):
    return _spans(spark, sf_dir).where(F.col("kind") == "anchor")


@query("corp_span_positive", sql=_span_sql(None, "WHERE kind = 'positive'"))
def q_span_positive(spark, sf_dir):
    return _spans(spark, sf_dir).where(F.col("kind") == "positive")


@query("corp_span_subsuming", sql=_span_sql("subsuming"))
def q_span_subsuming(spark, sf_dir):
    return _spans(spark, sf_dir, "subsuming")


@query("corp_span_adjacent", sql=_span_sql("adjacent"))
def q_span_adjacent(spark, sf_dir):
    return _spans(spark, sf_dir, "adjacent")


@query("corp_span_validate", sql=f"""
SELECT doc_id, CAST(n AS INTEGER) AS n_tokens,
       CASE WHEN n < 2 * 64 * 2 THEN 'too_short' WHEN 64 > n THEN 'max_gt_tokens' END AS reason
FROM (SELECT doc_id, len({Q.tokens_ws('text')}) AS n FROM documents)
WHERE n < 2 * 64 * 2 OR 64 > n""")
def q_span_validate(spark, sf_dir):
    """Documents the span sampler rejects (A=2, M=64, m=32), with the reason."""
    return C.span_quarantine(ws_tokens(spark, sf_dir), "tokens", "doc_id", 2, 64, 32)


UNPACK_SQL = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY anchor_id, kind, span_no) - 1 AS INTEGER) AS place,
       anchor_id, kind, span_no, start, len FROM ({_span_sql(None)})"""


@query("corp_unpack", sql=UNPACK_SQL)
def q_unpack(spark, sf_dir):
    """Per-document nested (anchor, positives) batch flattened to one row per span."""
    s = _spans(spark, sf_dir)
    nested = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("anchor_id", "kind", "span_no", "start", "len"))).alias("b"))
    return nested.select("doc_id", F.posexplode("b").alias("place", "span")).select("doc_id", "place", "span.*")


# Fixed task key table: task name to (first text column, second or none).
PAIR_TASKS = {"single": ("text", None), "pair": ("text", "reply")}


@query("corp_pair_labels", sql="""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply
           FROM conversations)
SELECT conv_id, turn, 'single' AS task, text AS input FROM t
UNION ALL SELECT conv_id, turn, 'pair' AS task, concat_ws(' [SEP] ', text, reply) AS input FROM t WHERE reply IS NOT NULL""")
def q_pair_labels(spark, sf_dir):
    """Model inputs per task key table: one text column, or a turn and its reply."""
    c = S.read(spark, sf_dir, "conversations")
    t = c.withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    single = t.select("conv_id", "turn", F.lit("single").alias("task"), C.pair_inputs(t, *PAIR_TASKS["single"]).alias("input"))
    pair = t.where(F.col("reply").isNotNull()).select(
        "conv_id", "turn", F.lit("pair").alias("task"), C.pair_inputs(t, *PAIR_TASKS["pair"]).alias("input"))
    return single.unionByName(pair)


def batched_emb(spark, sf_dir, batch_size=32):
    e = S.read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label",
                    F.floor(F.col("vec_id") / batch_size).cast("bigint").alias("batch"))


@query("corp_pair_mine", sql=f"""
WITH e AS (SELECT vec_id AS id, label, vec_id // 32 AS batch, embedding FROM embeddings)
SELECT a.batch, a.id AS a, b.id AS b,
       CASE WHEN a.label = b.label THEN 'positive' ELSE 'negative' END AS kind,
       round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS sim
FROM e a JOIN e b ON a.batch = b.batch AND a.id <> b.id
WHERE (a.label = b.label AND {COS.format(a='a.embedding', b='b.embedding')} < 0.5)
   OR (a.label <> b.label AND {COS.format(a='a.embedding', b='b.embedding')} > 0.2)""")
def q_pair_mine(spark, sf_dir):
    m = C.mine_pairs(batched_emb(spark, sf_dir), "batch", pos_margin=0.5, neg_margin=0.2)
    return m.withColumn("sim", F.round("sim", 6))


@query("corp_ntxent", sql=f"""
WITH e AS (SELECT vec_id AS id, label, vec_id // 32 AS batch, embedding FROM embeddings),
s AS (SELECT a.batch, a.id AS a, b.id AS b, a.label = b.label AS same,
             {COS.format(a='a.embedding', b='b.embedding')} / 0.05 AS z
      FROM e a JOIN e b ON a.batch = b.batch AND a.id <> b.id),
ns AS (SELECT a, coalesce(sum(exp(z)) FILTER (NOT same), 0) AS negsum FROM s GROUP BY a),
l AS (SELECT s.batch, ln(exp(s.z) + ns.negsum) - s.z AS loss FROM s JOIN ns USING (a) WHERE s.same)
SELECT b.batch, count(l.loss) AS n_pairs, round(coalesce(avg(l.loss), 0.0), 6) AS loss
FROM (SELECT DISTINCT batch FROM e) b LEFT JOIN l USING (batch) GROUP BY b.batch""")
def q_ntxent(spark, sf_dir):
    """NT-Xent (T = 0.05) per batch of 32 vectors, positives = same label."""
    return C.ntxent(batched_emb(spark, sf_dir), "batch", temperature=0.05).withColumn("loss", F.round("loss", 6))
