"""Queries for behavioural tests (2.11), template joins (2.3 / 2.5) and
attribution measures (2.12). Base cases are the texts of ``documents`` and of
``benchmark`` (ids -1, -2, ...); the scorer is the lexicon fitted on ``documents`` x ``labels.toxic``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import attribution as A
from textloom.operators import behave as B
from textloom.operators.common import evaluate_once
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.sources import tables as S

LEX_SQL = f"""lex AS (SELECT word, ln((pos + 1) / (neg + 1)) AS weight FROM (
  SELECT word, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg
  FROM (SELECT doc_id, y, unnest(list_distinct(tk)) AS word
        FROM (SELECT d.doc_id, l.toxic AS y, {Q.tokens('lower(d.text)')} AS tk
              FROM documents d JOIN labels l USING (doc_id)))
  GROUP BY word))"""

CASES_SQL = """(SELECT doc_id AS item_id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT -1 - item_id AS item_id, text FROM benchmark WHERE text IS NOT NULL)"""


def score_sql(src: str, keys: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN n = 0 THEN 0.5 ELSE 1 / (1 + exp(-(s / n))) END AS p1,
       CAST(CASE WHEN n = 0 THEN 0.5 ELSE 1 / (1 + exp(-(s / n))) END > 0.5 AS INTEGER) AS prediction
  FROM (SELECT {keys}, sum(coalesce(weight, 0)) AS s, count(word) AS n
        FROM (SELECT {keys}, unnest({Q.tokens('lower(text)')}) AS word FROM {src}) LEFT JOIN lex USING (word)
        GROUP BY {keys}))"""


def lexicon(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    docs = evaluate_once(d.select("doc_id", T.tokenize_words("text", lower=True).alias("tokens")), "tokens")
    lab = S.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return B.fit_lexicon(docs, lab)


def bench_cases(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    b = S.read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text")
    return d.unionByName(b).where(F.col("text").isNotNull())


def _swap_sql(words) -> str:
    parts = []
    for p in words:
        for q in words:
            if p != q:
                parts.append(f"CASE WHEN regexp_matches(text, '\\b{p}\\b') THEN regexp_replace(text, '\\b{p}\\b', '{q}', 'g') END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _variants_sql(arr: str, src: str = CASES_SQL) -> str:
    return f"""SELECT item_id AS case_id, CAST(i AS INTEGER) AS variant, v[i] AS text FROM (
  SELECT item_id, v, unnest(generate_series(1, len(v))) AS i FROM (SELECT item_id, {arr} AS v FROM {src}))"""


def _variants(df, perturb):
    return df.select(F.col("item_id").alias("case_id"), F.posexplode(perturb).alias("variant", "text")).withColumn(
        "variant", (F.col("variant") + 1).cast("int"))


@query("beh_swap_gender", sql=_variants_sql(_swap_sql(B.GENDER_PRONOUNS)))
def q_swap_gender(spark, sf_dir):
    return _variants(bench_cases(spark, sf_dir), B.swap_words("text", B.GENDER_PRONOUNS))


SEEN_SQL = f"(SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'The patient was seen. ' ELSE 'Saw pt and p1. ' END || text AS text FROM {CASES_SQL})"


@query("beh_swap_patient_noun", sql=_variants_sql(_swap_sql(B.PATIENT_NOUNS), SEEN_SQL))
def q_swap_patient(spark, sf_dir):
    """The supplied texts name no patients, so each gets a sentence that does."""
    head = F.when(F.col("item_id") % 2 == 0, "The patient was seen. ").otherwise("Saw pt and p1. ")
    seen = bench_cases(spark, sf_dir).select("item_id", F.concat(head, F.col("text")).alias("text"))
    return _variants(seen, B.swap_words("text", B.PATIENT_NOUNS))


PUNCT_SQL = ("[CASE WHEN regexp_replace(text, '[.!?]+$', '') <> text THEN regexp_replace(text, '[.!?]+$', '') "
             "ELSE text || '.' END]")


@query("beh_punctuation", sql=_variants_sql(PUNCT_SQL))
def q_punctuation(spark, sf_dir):
    return _variants(bench_cases(spark, sf_dir), B.punctuation_variants("text"))


TYPO_SQL = """[CASE WHEN length(text) >= 2 THEN substr(text, 1, i - 1) || substr(text, i + 1, 1) || substr(text, i, 1) || substr(text, i + 2) END]"""


@query("beh_typos", sql=f"""SELECT item_id AS case_id, 1 AS variant, {TYPO_SQL}[1] AS text FROM (
  SELECT item_id, text, CAST('0x' || substr(md5('42|' || CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % greatest(length(text) - 1, 1) + 1 AS i
  FROM {CASES_SQL})""")
def q_typos(spark, sf_dir):
    b = bench_cases(spark, sf_dir)
    return _variants(b, B.typo("text", "item_id"))


NEG_SQL = ("list_filter([CASE WHEN regexp_matches(text, '\\b(was|did|had)\\b') THEN "
           "regexp_replace(text, '(?s)^(.*?)\\b(was|did|had)\\b', '\\1\\2 not') END], lambda x: x IS NOT NULL)")


@query("beh_add_negation", sql=_variants_sql(NEG_SQL))
def q_add_negation(spark, sf_dir):
    return _variants(bench_cases(spark, sf_dir), F.filter(B.add_negation("text"), lambda x: x.isNotNull()))


@query("beh_change_location", sql=f"""
WITH c AS (SELECT b.item_id, 'Seen in ' || n.n_name || '. ' || b.text AS text FROM {CASES_SQL} b
           JOIN nation n ON n.n_nationkey = abs(b.item_id) % 25),
w AS (SELECT DISTINCT item_id, text, unnest({Q.tokens('text')}) AS w FROM c),
f AS (SELECT w.item_id, w.text, w.w FROM w JOIN nation ON nation.n_name = w.w)
SELECT 'change_location' AS test, f.item_id AS case_id, regexp_replace(f.text, '\\b' || f.w || '\\b', o.n_name, 'g') AS text,
       f.w, o.n_name AS other
FROM f JOIN nation o ON o.n_name <> f.w""")
def q_change_location(spark, sf_dir):
    """Place names (the ``nation`` table as lexicon) replaced by each other place. The
    supplied texts name no places, so each gets a sentence that does."""
    nation = S.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    b = bench_cases(spark, sf_dir).withColumn("n_nationkey", F.abs("item_id") % 25).join(nation, "n_nationkey")
    seen = b.select("item_id", F.concat(F.lit("Seen in "), F.col("place"), F.lit(". "), F.col("text")).alias("text"))
    return B.place_variants(seen, "item_id", "text", nation.select("place"))


def _pairs(spark, sf_dir, test, perturb):
    b = bench_cases(spark, sf_dir)
    c = B.cases(b, "item_id", "text", test, perturb)
    sc = B.lexicon_score(c, ["test", "case_id", "variant"], "text", lexicon(spark, sf_dir))
    return B.test_vs_original(sc)


def _pairs_sql(arr: str, test: str) -> str:
    return f"""WITH {LEX_SQL},
v AS ({_variants_sql(arr)}),
c AS (SELECT '{test}' AS test, item_id AS case_id, 0 AS variant, text FROM {CASES_SQL} WHERE item_id IN (SELECT case_id FROM v)
      UNION ALL SELECT '{test}' AS test, case_id, variant, text FROM v),
sc AS {score_sql('c', 'test, case_id, variant')},
pairs AS (SELECT v.test, v.case_id, v.variant, v.p1, v.prediction, o.prediction AS pred0, o.p1 AS p1_orig
          FROM sc v JOIN sc o ON o.test = v.test AND o.case_id = v.case_id AND o.variant = 0 WHERE v.variant > 0)
"""


@query("join_test_vs_original", sql=_pairs_sql(PUNCT_SQL, "punctuation") + """
SELECT test, case_id, variant, round(p1, 6) AS p1, prediction, pred0, round(p1_orig, 6) AS p1_orig FROM pairs""")
def q_test_vs_original(spark, sf_dir):
    p = _pairs(spark, sf_dir, "punctuation", B.punctuation_variants("text"))
    return p.select("test", "case_id", F.col("variant").cast("int"), F.round("p1", 6).alias("p1"), "prediction",
                    "pred0", F.round("p1_orig", 6).alias("p1_orig"))


@query("beh_inv", sql=_pairs_sql(PUNCT_SQL, "punctuation") + """
SELECT test, count(*) AS n_cases, CAST(sum(fail) AS BIGINT) AS n_fail, round(avg(fail), 6) AS fail_rate FROM (
  SELECT test, case_id, max(CAST(prediction <> pred0 AS INTEGER)) AS fail FROM pairs GROUP BY test, case_id)
GROUP BY test""")
def q_inv(spark, sf_dir):
    r = B.inv_results(_pairs(spark, sf_dir, "punctuation", B.punctuation_variants("text")))
    return r.groupBy("test").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("fail").alias("n_fail"),
                                 F.round(F.avg("fail"), 6).alias("fail_rate"))


@query("beh_dir_monotonic", sql=_pairs_sql(NEG_SQL, "negation") + """
SELECT test, count(*) AS n_cases, CAST(sum(fail) AS BIGINT) AS n_fail FROM (
  SELECT test, case_id, max(CAST(p1 - p1_orig > 0.1 AS INTEGER)) AS fail FROM pairs GROUP BY test, case_id)
GROUP BY test""")
def q_dir(spark, sf_dir):
    neg = F.filter(B.add_negation("text"), lambda x: x.isNotNull())
    r = B.dir_monotonic(_pairs(spark, sf_dir, "negation", neg), 0.1)
    return r.groupBy("test").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("fail").alias("n_fail"))


TOP_NOUNS_SQL = f"""nouns AS (SELECT word FROM (SELECT unnest({Q.tokens('lower(text)')}) AS word FROM benchmark)
  WHERE regexp_matches(word, '^[a-z]{{4,}}$') GROUP BY word)"""


def _template_sql() -> str:
    vals = ", ".join(f"('{a}', 1)" for a in B.NOT_SEVERE_TAGS) + ", " + ", ".join(f"('{a}', 0)" for a in B.SEVERE_TAGS)
    return f"""{TOP_NOUNS_SQL},
adj AS (SELECT * FROM (VALUES {vals}) t(adj, label)),
tpl AS (SELECT n.word AS noun, a.adj, CAST(a.label AS INTEGER) AS label,
               'This is not ' || CASE WHEN left(a.adj, 1) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END
               || ' ' || a.adj || ' ' || n.word || '.' AS text FROM nouns n, adj a)"""


def templates(spark, sf_dir):
    b = S.read(spark, sf_dir, "benchmark")
    words = b.select(F.explode(T.tokenize_words("text", lower=True)).alias("word")).where(F.col("word").rlike("^[a-z]{4,}$"))
    return B.template_cases(words.distinct())


@query("join_template_product", sql=f"WITH {_template_sql()} SELECT noun, adj, label, text FROM tpl")
def q_template_product(spark, sf_dir):
    """Template slots: the benchmark words x 17 adjectives."""
    return templates(spark, sf_dir)


@query("union_templates", sql=f"""WITH {_template_sql()}
SELECT label, count(*) AS n FROM (SELECT text, label FROM tpl WHERE label = 1 UNION ALL SELECT text, label FROM tpl WHERE label = 0)
GROUP BY label""")
def q_union_templates(spark, sf_dir):
    t = templates(spark, sf_dir)
    u = t.where(F.col("label") == 1).unionByName(t.where(F.col("label") == 0))
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _mft(spark, sf_dir):
    t = templates(spark, sf_dir).withColumn("case_id", F.concat_ws("|", "noun", "adj")).withColumn("test", F.lit("not_negation"))
    sc = B.lexicon_score(t, ["test", "case_id", "label"], "text", lexicon(spark, sf_dir))
    return B.mft_results(sc.withColumnRenamed("label", "expected"))


MFT_SQL = f"""WITH {LEX_SQL}, {_template_sql()},
c AS (SELECT 'not_negation' AS test, noun || '|' || adj AS case_id, label, text FROM tpl),
sc AS {score_sql('c', 'test, case_id, label')},
mft AS (SELECT test, case_id, CAST(prediction <> label AS INTEGER) AS fail FROM sc)
"""


@query("beh_mft", sql=MFT_SQL + """
SELECT test, count(*) AS n_cases, CAST(sum(fail) AS BIGINT) AS n_fail, round(avg(fail), 6) AS fail_rate FROM mft GROUP BY test""")
def q_mft(spark, sf_dir):
    r = _mft(spark, sf_dir)
    return r.groupBy("test").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("fail").alias("n_fail"),
                                 F.round(F.avg("fail"), 6).alias("fail_rate"))


def _suite_pairs_sql(arr: str, test: str) -> str:
    """The CTEs of ``_pairs_sql`` after the lexicon, named for one test."""
    body = _pairs_sql(arr, test).split(f"{LEX_SQL},", 1)[1]
    for name in ("pairs", "sc", "v", "c"):
        body = body.replace(f"\n{name} AS (", f"\n{name}_{test} AS (").replace(f"FROM {name} ", f"FROM {name}_{test} ").replace(
            f"FROM {name})", f"FROM {name}_{test})").replace(f"JOIN {name} ", f"JOIN {name}_{test} ")
    return body.rstrip()


@query("beh_suite_summary", sql=MFT_SQL.rstrip() + "," + _suite_pairs_sql(PUNCT_SQL, "punctuation") + "," + _suite_pairs_sql(NEG_SQL, "negation") + """,
results AS (SELECT 'vocabulary' AS capability, test, case_id, fail FROM mft
  UNION ALL SELECT 'robustness', test, CAST(case_id AS VARCHAR), max(CAST(prediction <> pred0 AS INTEGER)) FROM pairs_punctuation GROUP BY test, case_id
  UNION ALL SELECT 'negation', test, CAST(case_id AS VARCHAR), max(CAST(p1 - p1_orig > 0.1 AS INTEGER)) FROM pairs_negation GROUP BY test, case_id)
SELECT capability, test, count(*) AS n_cases, CAST(sum(fail) AS BIGINT) AS n_fail, round(avg(fail), 6) AS fail_rate,
       min(CASE WHEN fail = 1 THEN case_id END) AS example_case
FROM results GROUP BY capability, test""")
def q_suite_summary(spark, sf_dir):
    """A minimum functionality, an invariance and a directional test in one table."""
    neg = F.filter(B.add_negation("text"), lambda x: x.isNotNull())
    inv = B.inv_results(_pairs(spark, sf_dir, "punctuation", B.punctuation_variants("text")))
    dir_ = B.dir_monotonic(_pairs(spark, sf_dir, "negation", neg), 0.1)
    row = lambda df, c: df.select(F.lit(c).alias("capability"), "test", F.col("case_id").cast("string").alias("case_id"), "fail")
    return B.summary(row(_mft(spark, sf_dir), "vocabulary").unionByName(row(inv, "robustness")).unionByName(row(dir_, "negation")))


@query("beh_confident_examples", sql=f"""WITH {LEX_SQL},
sc AS {score_sql(CASES_SQL, 'item_id')}
SELECT item_id, kind, round(p1, 6) AS p1, round(1 - p1, 6) AS p0 FROM (
  SELECT item_id, p1, 'surest' AS kind, row_number() OVER (ORDER BY abs(p1 - 0.5) DESC, item_id) AS r FROM sc
  UNION ALL SELECT item_id, p1, 'least_sure' AS kind, row_number() OVER (ORDER BY abs(p1 - 0.5), item_id) AS r FROM sc)
WHERE r <= 5""")
def q_confident(spark, sf_dir):
    """Predictions with both class probabilities: 5 surest and 5 least sure."""
    sc = B.lexicon_score(bench_cases(spark, sf_dir), ["item_id"], "text", lexicon(spark, sf_dir))
    d = F.abs(F.col("p1") - 0.5)
    sure = sc.orderBy(d.desc(), "item_id").limit(5).withColumn("kind", F.lit("surest"))
    unsure = sc.orderBy(d.asc(), "item_id").limit(5).withColumn("kind", F.lit("least_sure"))
    u = sure.unionByName(unsure)
    return u.select("item_id", "kind", F.round("p1", 6).alias("p1"), F.round(1 - F.col("p1"), 6).alias("p0"))


# --- attribution --------------------------------------------------------------

TW_SQL = f"""tw AS (SELECT t.case_id, t.pos, t.word, coalesce(l.weight, 0.0) AS weight,
                    sum(coalesce(l.weight, 0.0)) OVER (PARTITION BY t.case_id) AS S,
                    count(*) OVER (PARTITION BY t.case_id) AS n
             FROM (SELECT item_id AS case_id, unnest(tk) AS word, unnest(generate_series(0, len(tk) - 1)) AS pos
                   FROM (SELECT item_id, {Q.tokens('lower(text)')} AS tk FROM {CASES_SQL})) t
             LEFT JOIN lex l USING (word))"""


def _tw(spark, sf_dir):
    return A.token_weights(bench_cases(spark, sf_dir), "item_id", "text", lexicon(spark, sf_dir))


def _psql(s: str, n: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN 0.5 ELSE 1 / (1 + exp(-(({s}) / ({n})))) END)"


@query("att_leave_one_out", sql=f"""WITH {LEX_SQL}, {TW_SQL}
SELECT case_id, CAST(pos AS INTEGER) AS pos, word, round({_psql('S', 'n')} - {_psql('S - weight', 'n - 1')}, 6) AS loo FROM tw""")
def q_loo(spark, sf_dir):
    r = A.leave_one_out(_tw(spark, sf_dir))
    return r.select("case_id", "pos", "word", F.round("loo", 6).alias("loo"))


AOPC_SQL = f"""WITH {LEX_SQL}, {TW_SQL},
r AS (SELECT *, row_number() OVER w AS k, sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk
      FROM tw WINDOW w AS (PARTITION BY case_id ORDER BY weight DESC, pos))"""


@query("att_aopc_comprehensiveness", sql=AOPC_SQL + f"""
SELECT case_id, round(avg({_psql('S', 'n')} - {_psql('S - pk', 'n - k')}), 6) AS comprehensiveness FROM r GROUP BY case_id""")
def q_aopc_comp(spark, sf_dir):
    return A.aopc(_tw(spark, sf_dir)).select("case_id", "comprehensiveness")


@query("att_aopc_sufficiency", sql=AOPC_SQL + f"""
SELECT case_id, round(avg({_psql('S', 'n')} - {_psql('pk', 'k')}), 6) AS sufficiency FROM r GROUP BY case_id""")
def q_aopc_suff(spark, sf_dir):
    return A.aopc(_tw(spark, sf_dir)).select("case_id", "sufficiency")


LOO_CTE = f"l AS (SELECT *, {_psql('S', 'n')} - {_psql('S - weight', 'n - 1')} AS loo, CAST(weight > 0 AS INTEGER) AS y FROM tw)"


@query("att_loo_correlation", sql=f"""WITH {LEX_SQL}, {TW_SQL}, {LOO_CTE},
rk AS (SELECT case_id, rank() OVER (PARTITION BY case_id ORDER BY weight) + (count(*) OVER (PARTITION BY case_id, weight) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY case_id ORDER BY loo) + (count(*) OVER (PARTITION BY case_id, loo) - 1) / 2.0 AS ry FROM l)
SELECT case_id, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) END AS spearman FROM rk GROUP BY case_id""")
def q_loo_corr(spark, sf_dir):
    """Spearman of attributions (weights) and leave-one-out scores per text; null where
    one of them is constant."""
    return A.rank_agreement(A.leave_one_out(_tw(spark, sf_dir)))


@query("att_rationale_f1_iou", sql=f"""WITH {LEX_SQL}, {TW_SQL},
l AS (SELECT *, {_psql('S', 'n')} - {_psql('S - weight', 'n - 1')} AS loo, CAST(weight > 0 AS INTEGER) AS r FROM tw),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY loo DESC, pos) <= sum(r) OVER (PARTITION BY case_id) AS INTEGER) AS top FROM l),
a AS (SELECT case_id, sum(top * r) AS inter, sum(top) AS n_top, sum(r) AS n_rat, sum(greatest(top, r)) AS uni FROM t GROUP BY case_id)
SELECT case_id, round(CASE WHEN n_top + n_rat = 0 THEN 0.0 ELSE 2 * inter / (n_top + n_rat) END, 6) AS f1,
       round(CASE WHEN uni = 0 THEN 0.0 ELSE inter / uni END, 6) AS iou FROM a""")
def q_rationale(spark, sf_dir):
    """Top-k tokens by leave-one-out score against the rationale (tokens of
    positive weight), k = rationale size: token F1 and IoU."""
    return A.rationale_overlap(A.leave_one_out(_tw(spark, sf_dir)))


@query("att_rationale_auprc", sql=f"""WITH {LEX_SQL}, {TW_SQL}, {LOO_CTE},
per AS (SELECT case_id, loo, sum(y) AS tp_at, sum(1 - y) AS fp_at FROM l GROUP BY case_id, loo),
c AS (SELECT *, sum(tp_at) OVER w AS tp, sum(fp_at) OVER w AS fp, sum(tp_at) OVER (PARTITION BY case_id) AS p
      FROM per WINDOW w AS (PARTITION BY case_id ORDER BY loo DESC))
SELECT case_id, round(sum(CASE WHEN p = 0 THEN NULL ELSE tp_at / p * (tp / (tp + fp)
         + CASE WHEN tp + fp = tp_at + fp_at THEN 1.0 ELSE (tp - tp_at) / (tp + fp - tp_at - fp_at) END) / 2 END), 6) AS pr_auc
FROM c GROUP BY case_id""")
def q_rationale_auprc(spark, sf_dir):
    """Area under precision-recall of leave-one-out scores against the rationale, per text."""
    return A.rationale_pr_auc(A.leave_one_out(_tw(spark, sf_dir)))


@query("att_token_sum", sql="""
SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS attribution FROM embeddings""")
def q_token_sum(spark, sf_dir):
    """Per-dimension attributions (vector rows) summed to one number per token."""
    e = S.read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("attribution"))
