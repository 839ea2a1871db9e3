"""Queries for class statistics (2.4), label joins (2.3), numeric transforms
(2.7) and dedup / union / batching rows (2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classes as C
from textloom.operators import datasets as D
from textloom.operators import joins as J
from textloom.operators import sampling as SM
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.sources import tables as S

NOTES = S.with_sql(S.NOTES_SQL)
P = S.with_sql(S.PREDS_SQL)
PM = S.with_sql(S.PREDS_MULTI_SQL)


def _split3(spark, sf_dir):
    n = S.notes(spark, sf_dir).where(F.col("severity").isNotNull())
    return SM.three_way_split(n, "id", seed=41)


SPLIT3 = """split3 AS (
  SELECT *, CASE WHEN r <= n_v THEN 'valid' WHEN r <= n_s THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '41', CAST(id AS VARCHAR))), id) AS r,
               round_even(round_even(count(*) OVER () * 0.8, 0) * 0.25, 0) AS n_v,
               round_even(count(*) OVER () * 0.8, 0) AS n_s
        FROM notes WHERE severity IS NOT NULL))"""


@query("agg_row_counts", sql=S.with_sql(S.NOTES_SQL, SPLIT3) + """
SELECT split, count(*) AS n_rows, 5 AS n_cols FROM split3 GROUP BY split""")
def q_row_counts(spark, sf_dir):
    s = _split3(spark, sf_dir)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(5))


@query("agg_null_counts", sql=NOTES + """
SELECT count(*) FILTER (id IS NULL) AS id, count(*) FILTER (IN07 IS NULL) AS IN07,
       count(*) FILTER (severity IS NULL) AS severity, count(*) FILTER (type IS NULL) AS type,
       count(*) FILTER (location IS NULL) AS location FROM notes""")
def q_null_counts(spark, sf_dir):
    return C.null_counts(S.notes(spark, sf_dir))


@query("agg_class_counts", sql=P + "SELECT split, label, count(*) AS n FROM preds GROUP BY split, label")
def q_class_counts(spark, sf_dir):
    return C.class_counts(S.preds(spark, sf_dir), ["split"])


@query("agg_class_prevalence", sql=P + """
SELECT split, round(avg(CAST(label = 1 AS DOUBLE)), 6) AS prevalence FROM preds GROUP BY split""")
def q_class_prevalence(spark, sf_dir):
    return C.prevalence(S.preds(spark, sf_dir), ["split"])


@query("agg_class_weights", sql=NOTES + """
SELECT type AS label, round(1 - count(*) / sum(count(*)) OVER (), 6) AS weight FROM notes GROUP BY type""")
def q_class_weights(spark, sf_dir):
    lab = S.notes(spark, sf_dir).select(F.col("type").alias("label"))
    return C.class_weights(lab)


@query("agg_class_index", sql=NOTES + """
SELECT type AS label, CAST(row_number() OVER (ORDER BY type) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT type FROM notes)""")
def q_class_index(spark, sf_dir):
    return J.class_index(S.notes(spark, sf_dir).select(F.col("type").alias("label")))


@query("agg_label_range", sql=PM + """
SELECT min(label) AS min_label, max(label) AS max_label, 3 AS split_value,
       min(label) <= 3 AND 3 <= max(label) AS in_range FROM preds_multi""")
def q_label_range(spark, sf_dir):
    return C.label_range(S.preds_multi(spark, sf_dir), 3)


@query("agg_running_mean", sql=P + """
SELECT model, batch, n, round(acc, 6) AS acc,
       round(sum(acc * n) OVER w / sum(n) OVER w, 6) AS running_mean
FROM (SELECT model, id // 50 AS batch, count(*) AS n, avg(CAST(label = prediction AS DOUBLE)) AS acc
      FROM preds GROUP BY model, id // 50)
WINDOW w AS (PARTITION BY model ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_mean(spark, sf_dir):
    """Sample-weighted running mean of batch accuracy (batches of 50 ids)."""
    p = S.preds(spark, sf_dir)
    b = p.groupBy("model", F.floor(F.col("id") / 50).cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc"))
    r = C.running_weighted_mean(b, "acc", "n", ["model"], "batch")
    return r.select("model", "batch", "n", F.round("acc", 6).alias("acc"), F.round("running_mean", 6).alias("running_mean"))


@query("num_softmax_argmax", sql=PM + """
SELECT id, prediction, round(list_max(probs), 6) AS score, round(list_sum(probs), 6) AS total FROM preds_multi""")
def q_softmax(spark, sf_dir):
    pm = S.preds_multi(spark, sf_dir)
    return pm.select("id", "prediction", F.round(F.array_max("probs"), 6).alias("score"),
                     F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("num_logit", sql=P + "SELECT id, round(ln(score / (1 - score)), 6) AS logit FROM preds WHERE score > 0 AND score < 1")
def q_logit(spark, sf_dir):
    p = S.preds(spark, sf_dir).where((F.col("score") > 0) & (F.col("score") < 1))
    return p.select("id", F.round(C.logit("score"), 6).alias("logit"))


@query("num_binary_transform", sql=NOTES + """
SELECT id, CASE WHEN severity - 1 < 3 THEN 0 ELSE 1 END AS label FROM notes WHERE severity IS NOT NULL""")
def q_binary(spark, sf_dir):
    n = S.notes(spark, sf_dir).where(F.col("severity").isNotNull())
    lab = D.label_shift(n.select("id", F.col("severity").alias("label")), "label", 1)
    return D.binary_transform(lab, 3, "label")


@query("num_label_shift", sql=NOTES + "SELECT id, CAST(severity - 1 AS INTEGER) AS label FROM notes WHERE severity IS NOT NULL")
def q_label_shift(spark, sf_dir):
    n = S.notes(spark, sf_dir).where(F.col("severity").isNotNull())
    return D.label_shift(D.text_label(n, "IN07", "severity"), "label", 1).select("id", "label")


@query("num_neutral_band", sql=P + """
SELECT id, cls, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM (
  SELECT id, p0, p1, p2,
         CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS cls FROM (
    SELECT id,
      CASE WHEN score < 0.5 - 1.0 / 6 OR score > 0.5 + 1.0 / 6 THEN 1 - score
           WHEN score < 0.5 AND score > 0.5 - 1.0 / 6 THEN 3 * abs(score - 0.5) ELSE 0.0 END AS p0,
      CASE WHEN (score >= 0.5 AND score < 0.5 + 1.0 / 6) OR (score < 0.5 AND score > 0.5 - 1.0 / 6)
           THEN 1 - 3 * abs(score - 0.5) ELSE 0.0 END AS p1,
      CASE WHEN score < 0.5 - 1.0 / 6 OR score > 0.5 + 1.0 / 6 THEN score
           WHEN score >= 0.5 AND score < 0.5 + 1.0 / 6 THEN 3 * abs(score - 0.5) ELSE 0.0 END AS p2
    FROM preds))""")
def q_neutral_band(spark, sf_dir):
    p = C.neutral_band(S.preds(spark, sf_dir), "score")
    return p.select("id", "cls", *[F.round(F.element_at("pp", i + 1), 6).alias(f"p{i}") for i in range(3)])


@query("num_pred_conf", sql=P + """
SELECT id, CAST(right(lbl, 1) AS INTEGER) AS cls,
       round(CASE WHEN right(lbl, 1) = '1' THEN 1 - conf ELSE conf END, 6) AS p0,
       round(CASE WHEN right(lbl, 1) = '1' THEN conf ELSE 1 - conf END, 6) AS p1
FROM (SELECT id, 'LABEL_' || CAST(prediction AS VARCHAR) AS lbl, greatest(score, 1 - score) AS conf FROM preds)""")
def q_pred_conf(spark, sf_dir):
    """Pipeline-style output (``LABEL_k``, confidence) to (class, [p0, p1])."""
    p = S.preds(spark, sf_dir).select("id", F.concat(F.lit("LABEL_"), F.col("prediction").cast("string")).alias("lbl"),
                                      F.greatest("score", 1 - F.col("score")).alias("conf"))
    r = C.pred_conf(p, "lbl", "conf")
    return r.select("id", "cls", F.round(F.element_at("probs", 1), 6).alias("p0"),
                    F.round(F.element_at("probs", 2), 6).alias("p1"))


@query("join_label_remap", sql=S.with_sql(S.NOTES_SQL, SPLIT3) + """,
idx AS (SELECT severity, CAST(row_number() OVER (ORDER BY severity) - 1 AS INTEGER) AS label_idx
        FROM (SELECT DISTINCT severity FROM split3 WHERE split = 'train' AND severity < 6))
SELECT s.id, s.split, s.severity, i.label_idx FROM split3 s LEFT JOIN idx i USING (severity)
WHERE s.split <> 'train' OR s.severity < 6""")
def q_label_remap(spark, sf_dir):
    """Dense index fitted on train (label 6 removed there); valid/test rows of
    an unseen class get a null index."""
    s = D.drop_train_label(_split3(spark, sf_dir), "severity", 6)
    idx = J.class_index(s.where(F.col("split") == "train"), "severity")
    return J.label_remap(s.select("id", "split", "severity"), idx, "severity")


@query("join_label_names", sql=P + """
SELECT p.id, p.label, n.name FROM preds p LEFT JOIN (VALUES (0, 'low'), (1, 'high')) n(label, name) USING (label)""")
def q_label_names(spark, sf_dir):
    return J.label_names(S.preds(spark, sf_dir).select("id", "label"), spark, "instance_severity")


@query("join_anti_split", sql=NOTES + """
SELECT id, 'test' AS split FROM notes WHERE id NOT IN (
  SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '41', CAST(id AS VARCHAR))), id) AS r,
                         count(*) OVER () AS n FROM notes) WHERE r <= round_even(n * 0.8, 0))""")
def q_anti_split(spark, sf_dir):
    """Test = every row not sampled into the 80 % sample (left anti join)."""
    n = S.notes(spark, sf_dir).select("id")
    sample = SM.hash_top_n(n, round(n.count() * 0.8), "id", 41)
    return J.anti_split(n, sample).withColumn("split", F.lit("test"))


@query("dedup_exact", sql=f"""
SELECT clean, min(doc_id) AS doc_id, count(*) AS copies FROM (
  SELECT doc_id, {Q.sanitize("lower(regexp_replace(text, '[^A-Za-z'']+', ' ', 'g'))")} AS clean FROM documents)
WHERE clean IS NOT NULL GROUP BY clean""")
def q_dedup(spark, sf_dir):
    """Drop nulls and exact duplicate cleaned texts, keeping the first id.
    A group-by with partial aggregation: a text repeated in a third of all
    rows is combined map-side before the shuffle (no per-text window)."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", T.sanitize(T.alpha_only("text")).alias("clean"))
    return C.dedup_first(d, "clean", "doc_id")


@query("union_anchor_positive", sql="""
WITH a AS (SELECT label, min(vec_id) AS qid FROM embeddings GROUP BY label)
SELECT a.label AS pair_id, a.qid AS id, 'anchor' AS role FROM a
UNION ALL SELECT e.label AS pair_id, e.vec_id AS id, 'positive' AS role FROM embeddings e JOIN a USING (label) WHERE e.vec_id <> a.qid""")
def q_union_anchor_positive(spark, sf_dir):
    """Anchors stacked over positives; each pair shares one label (pair_id)."""
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a = e.groupBy("label").agg(F.min("id").alias("qid"))
    anchors_ = a.select(F.col("label").alias("pair_id"), F.col("qid").alias("id"), F.lit("anchor").alias("role"))
    pos = (e.join(a, "label").where(F.col("id") != F.col("qid"))
           .select(F.col("label").alias("pair_id"), "id", F.lit("positive").alias("role")))
    return anchors_.unionByName(pos)


@query("sort_for_batching", sql="""
SELECT doc_id, CAST(length(text) AS INTEGER) AS len, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 32 AS batch FROM documents""")
def q_sort_for_batching(spark, sf_dir):
    """Batches of 32 texts of similar length (less padding), by rank of (length, id)."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len"))
    return C.sort_for_batching(d, "doc_id", "len", batch_size=32)
