"""Queries for class statistics (2.4) and classification metrics (2.10) over the
deterministic predictions tables ``preds`` / ``preds_multi``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.plans.registry import query
from textloom.sources import tables as S

P = S.with_sql(S.PREDS_SQL)
PM = S.with_sql(S.PREDS_MULTI_SQL)
G = ["split", "model"]


@query("met_threshold", sql=P + """
SELECT split, model,
  round(CASE WHEN count(*) = 0 THEN NULL ELSE (count(*) FILTER (score > 0.5 AND label = 1) + count(*) FILTER (score < 0.5 AND label = 0)) / count(*) END, 6) AS accuracy,
  round(CASE WHEN count(*) FILTER (label = 1) = 0 THEN NULL ELSE count(*) FILTER (score > 0.5 AND label = 1) / count(*) FILTER (label = 1) END, 6) AS recall,
  round(CASE WHEN count(*) FILTER (score > 0.5) = 0 THEN NULL ELSE count(*) FILTER (score > 0.5 AND label = 1) / count(*) FILTER (score > 0.5) END, 6) AS precision,
  round(CASE WHEN count(*) FILTER (label = 0) = 0 THEN NULL ELSE count(*) FILTER (score < 0.5 AND label = 0) / count(*) FILTER (label = 0) END, 6) AS specificity,
  round(count(*) FILTER (label = 1) / count(*), 6) AS prevalence
FROM preds GROUP BY split, model""")
def q_threshold(spark, sf_dir):
    return M.threshold_metrics(S.preds(spark, sf_dir), G, 0.5)


CM_SQL = """cls AS (SELECT split, model, c FROM (SELECT split, model, label AS c FROM preds
                    UNION SELECT split, model, prediction AS c FROM preds)),
grid AS (SELECT a.split, a.model, a.c AS label, b.c AS prediction FROM cls a JOIN cls b USING (split, model)),
cnt AS (SELECT split, model, label, prediction, count(*) AS n FROM preds GROUP BY ALL),
cm AS (SELECT g.split, g.model, g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c USING (split, model, label, prediction))"""


@query("met_confusion", sql=P.rstrip() + ",\n" + CM_SQL + """
SELECT split, model, label, prediction, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY split, model, label) = 0 THEN 0.0
                  ELSE n / sum(n) OVER (PARTITION BY split, model, label) END, 2) AS n_norm
FROM cm""")
def q_confusion(spark, sf_dir):
    return M.confusion(S.preds(spark, sf_dir), G)


PC_SQL = CM_SQL + """,
pc AS (SELECT split, model, cls, support, precision, recall,
              CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
       FROM (SELECT split, model, label AS cls,
                    sum(n) AS support,
                    CASE WHEN (SELECT sum(n) FROM cm x WHERE x.split = cm.split AND x.model = cm.model AND x.prediction = cm.label) = 0 THEN 0.0
                         ELSE sum(n) FILTER (label = prediction) / (SELECT sum(n) FROM cm x WHERE x.split = cm.split AND x.model = cm.model AND x.prediction = cm.label) END AS precision,
                    CASE WHEN sum(n) = 0 THEN 0.0 ELSE sum(n) FILTER (label = prediction) / sum(n) END AS recall
             FROM cm GROUP BY split, model, label))"""


@query("met_prf", sql=P.rstrip() + ",\n" + PC_SQL + """
SELECT split, model, cls, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc""")
def q_prf(spark, sf_dir):
    pc = M.per_class(S.preds(spark, sf_dir), G)
    return pc.select(*G, "cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SUMMARY_SQL = """
SELECT s.split, s.model, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
       round(macro_f1, 6) AS macro_f1, round(weighted_precision, 6) AS weighted_precision,
       round(weighted_recall, 6) AS weighted_recall, round(weighted_f1, 6) AS weighted_f1,
       round(balanced_accuracy, 6) AS balanced_accuracy, round(a.accuracy, 6) AS accuracy
FROM (SELECT split, model, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
             sum(precision * support) / sum(support) AS weighted_precision,
             sum(recall * support) / sum(support) AS weighted_recall,
             sum(f1 * support) / sum(support) AS weighted_f1,
             avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy
      FROM pc GROUP BY split, model) s
JOIN (SELECT split, model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM preds GROUP BY ALL) a
USING (split, model)"""


@query("met_report", sql=P.rstrip() + ",\n" + PC_SQL + SUMMARY_SQL)
def q_report(spark, sf_dir):
    """Summary rows of the classification report (per-class rows: met_prf)."""
    return M.prf_summary(S.preds(spark, sf_dir), G)


@query("met_balanced_accuracy", sql=P.rstrip() + ",\n" + PC_SQL + """
SELECT split, model, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy
FROM pc GROUP BY split, model""")
def q_balanced_accuracy(spark, sf_dir):
    return M.prf_summary(S.preds(spark, sf_dir), G).select(*G, "balanced_accuracy")


@query("met_accuracy", sql=P + """
SELECT split, model, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy, count(*) AS n
FROM preds GROUP BY split, model""")
def q_accuracy(spark, sf_dir):
    return M.accuracy(S.preds(spark, sf_dir), G)


AUC_SQL = """
SELECT split, model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
                  ELSE sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split, model ORDER BY s
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT split, model, score AS s, count(*) FILTER (label = 1) AS pos,
                   count(*) FILTER (label <> 1) AS neg FROM preds GROUP BY ALL))
GROUP BY split, model"""


@query("met_roc_auc", sql=P + AUC_SQL)
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(S.preds(spark, sf_dir), G)


@query("met_roc_auc_ovr", sql=PM + """
SELECT round(avg(auc), 6) AS auc_macro, round(sum(auc * n_pos) / sum(n_pos), 6) AS auc_weighted,
       count(*) AS n_classes
FROM (SELECT cls, sum(pos) AS n_pos,
             CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
                  ELSE round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) END AS auc
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY p
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
            FROM (SELECT cls, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
                  FROM (SELECT CAST(i - 1 AS INTEGER) AS cls, probs[i] AS p, CAST(label = i - 1 AS INTEGER) AS y
                        FROM (SELECT label, probs, unnest(generate_series(1, len(probs))) AS i FROM preds_multi))
                  GROUP BY cls, p))
      GROUP BY cls)""")
def q_roc_auc_ovr(spark, sf_dir):
    return M.roc_auc_ovr(S.preds_multi(spark, sf_dir))


CURVE_SQL = """curve AS (
  SELECT split, model, threshold, k, tp, fp,
         CASE WHEN N = 0 THEN NULL ELSE fp / N END AS fpr, CASE WHEN P = 0 THEN NULL ELSE tp / P END AS tpr,
         CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN P = 0 THEN NULL ELSE tp / P END AS recall,
         CASE WHEN P = 0 THEN 0.0 ELSE tpb / P END AS prev_recall,
         CASE WHEN tpb + fpb = 0 THEN 1.0 ELSE tpb / (tpb + fpb) END AS prev_precision
  FROM (SELECT *, sum(tp_at) OVER w AS tp, sum(fp_at) OVER w AS fp,
               coalesce(sum(tp_at) OVER wb, 0) AS tpb, coalesce(sum(fp_at) OVER wb, 0) AS fpb,
               row_number() OVER (PARTITION BY split, model ORDER BY threshold DESC) AS k,
               sum(tp_at) OVER (PARTITION BY split, model) AS P, sum(fp_at) OVER (PARTITION BY split, model) AS N
        FROM (SELECT split, model, score AS threshold, count(*) FILTER (label = 1) AS tp_at,
                     count(*) FILTER (label <> 1) AS fp_at FROM preds GROUP BY ALL)
        WINDOW w AS (PARTITION BY split, model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               wb AS (PARTITION BY split, model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("met_roc_curve", sql=P.rstrip() + ",\n" + CURVE_SQL + """
SELECT split, model, threshold, k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve""")
def q_roc_curve(spark, sf_dir):
    pts = M.roc_points(S.preds(spark, sf_dir), G)
    return pts.select(*G, "threshold", "k", "tp", "fp", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("met_pr_curve", sql=P.rstrip() + ",\n" + CURVE_SQL + """
SELECT split, model, round(sum((recall - prev_recall) * (precision + prev_precision) / 2), 6) AS pr_auc
FROM curve GROUP BY split, model""")
def q_pr_curve(spark, sf_dir):
    return M.pr_auc(M.roc_points(S.preds(spark, sf_dir), G), G)


MCC_SQL = """cnt AS (SELECT split, model,
  CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND prediction = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (label = 0 AND prediction = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND prediction = 0) AS DOUBLE) AS fn
  FROM preds GROUP BY split, model)"""


@query("met_matthews", sql=P.rstrip() + ",\n" + MCC_SQL + """
SELECT split, model, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
       ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM cnt""")
def q_matthews(spark, sf_dir):
    return M.matthews(S.preds(spark, sf_dir), G)


@query("met_f1_binary", sql=P.rstrip() + ",\n" + MCC_SQL + """
SELECT split, model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM cnt""")
def q_f1_binary(spark, sf_dir):
    return M.f1_binary(S.preds(spark, sf_dir), G)


@query("met_pearson_spearman", sql=PM + """
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (
  SELECT x, y, (rank() OVER (ORDER BY x) - 1) + (count(*) OVER (PARTITION BY x) + 1) / 2.0 AS rx,
               (rank() OVER (ORDER BY y) - 1) + (count(*) OVER (PARTITION BY y) + 1) / 2.0 AS ry
  FROM (SELECT probs[1] AS x, probs[2] AS y FROM preds_multi))""")
def q_pearson_spearman(spark, sf_dir):
    pm = S.preds_multi(spark, sf_dir).select(F.element_at("probs", 1).alias("x"), F.element_at("probs", 2).alias("y"))
    return M.pearson_spearman(pm, "x", "y")


EPOCH_SQL = """log AS (SELECT model, CAST(id % 12 AS INTEGER) AS epoch, avg(CAST(label = prediction AS DOUBLE)) AS acc
                FROM preds GROUP BY ALL)"""


@query("met_best_epoch", sql=P.rstrip() + ",\n" + EPOCH_SQL + """,
run AS (SELECT *, max(acc) OVER w AS earlier FROM log WINDOW w AS (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
be AS (SELECT *, max(CASE WHEN earlier IS NULL OR acc > earlier THEN epoch END) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_ep FROM run)
SELECT b.model, b.best_epoch, coalesce(s.stop_epoch, b.last_epoch) AS stop_epoch
FROM (SELECT model, arg_max(epoch, (acc, -epoch)) AS best_epoch, max(epoch) AS last_epoch FROM log GROUP BY model) b
LEFT JOIN (SELECT model, min(epoch) AS stop_epoch FROM be WHERE epoch - best_ep >= 4 GROUP BY model) s USING (model)""")
def q_best_epoch(spark, sf_dir):
    """Best epoch and early stop (patience 4) over an epoch log derived from
    the predictions (epoch = id mod 12, metric = accuracy)."""
    p = S.preds(spark, sf_dir)
    log = p.groupBy("model", F.pmod("id", F.lit(12)).cast("int").alias("epoch")).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc"))
    return M.best_epoch(log, "acc", ["model"], patience=4)
