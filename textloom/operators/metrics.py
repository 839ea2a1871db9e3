"""Classification metrics over a predictions table ``(group..., label,
prediction, score)``; everything is an aggregate of counts.

Curves and AUC first aggregate rows to one row per distinct score, then use
the distributed ``ordered_prefix`` for cumulative counts, so no step puts all
rows (or all distinct scores) of a group into one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordering import ordered_prefix


def _div(a: Column, b: Column, zero=None) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


def _join_single(big: DataFrame, one_row: DataFrame, how: str = "inner") -> DataFrame:
    """Attach a one-row aggregate (no grouping) through a constant join key."""
    k = "_one"
    return big.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k, how).drop(k)


def threshold_metrics(df: DataFrame, group_cols: Sequence[str] = (), threshold: float = 0.5,
                      label: str = "label", score: str = "score") -> DataFrame:
    """Accuracy, recall, precision, specificity, prevalence at a threshold with
    strict ``>`` / ``<`` (a score equal to the threshold counts in neither)."""
    y, s = F.col(label), F.col(score)
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((s > threshold) & (y == 1)).alias("tp"),
        F.count_if((s < threshold) & (y == 0)).alias("tn"),
        F.count_if(s > threshold).alias("pred_pos"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(y == 0).alias("neg"))
    r6 = lambda c: F.round(c, 6)
    return agg.select(
        *group_cols,
        r6(_div(F.col("tp") + F.col("tn"), F.col("n"))).alias("accuracy"),
        r6(_div(F.col("tp"), F.col("pos"))).alias("recall"),
        r6(_div(F.col("tp"), F.col("pred_pos"))).alias("precision"),
        r6(_div(F.col("tn"), F.col("neg"))).alias("specificity"),
        r6(_div(F.col("pos"), F.col("n"))).alias("prevalence"))


def confusion(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Dense confusion table ``(group, label, prediction, n, n_norm)`` over the
    classes seen in labels or predictions; n_norm is normalised by true class
    (rounded to 2 places, 0 for an unseen true class)."""
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    cls = (df.select(*g, F.col(label).alias("c")).unionByName(df.select(*g, F.col(prediction).alias("c")))
           .groupBy(*g).agg(F.array_sort(F.collect_set("c")).alias("cls")))
    grid = (cls.select(*g, F.explode("cls").alias("label"), "cls")
            .select(*g, "label", F.explode("cls").alias("prediction")))
    dense = grid.join(counts, [*g, "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tot = dense.groupBy(*g, "label").agg(F.sum("n").alias("_row"))
    return (dense.join(tot, [*g, "label"])
            .withColumn("n_norm", F.round(_div(F.col("n"), F.col("_row"), 0.0), 2)).drop("_row"))


def per_class(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support (zero division gives 0)."""
    g = list(group_cols)
    cm = confusion(df, g, label, prediction)
    tp = cm.where(F.col("label") == F.col("prediction")).select(*g, F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(*g, F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(*g, F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = tp.join(sup, [*g, "cls"]).join(prd, [*g, "cls"])
    p = _div(F.col("tp"), F.col("predicted"), 0.0)
    r = _div(F.col("tp"), F.col("support"), 0.0)
    return j.select(*g, "cls", "support", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def prf_summary(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Macro and support-weighted precision / recall / F1, accuracy and
    balanced accuracy (mean recall over classes present in the labels)."""
    g = list(group_cols)
    pc = per_class(df, g, label, prediction)
    tot = F.sum("support")
    agg = pc.groupBy(*g).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    acc = df.groupBy(*g).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
    out = agg.join(acc, g) if g else _join_single(agg, acc)
    return out.select(*g, *[F.round(c, 6).alias(c) for c in out.columns if c not in g])


def roc_auc(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
            score: str = "score") -> DataFrame:
    """Binary ROC AUC with tied scores counted half (Mann-Whitney); 0 when a
    group has a single class."""
    g = list(group_cols)
    per = df.groupBy(*g, F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    pre = ordered_prefix(per, ["s"], {"neg": F.col("neg")}, group_cols=g, rank_col=None)
    agg = pre.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(0.0)).otherwise(
        F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*g, "n_pos", "n_neg", F.round(auc, 6).alias("auc"))


def roc_auc_ovr(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
                probs: str = "probs") -> DataFrame:
    """Multi-class one-vs-rest AUC: per class, macro mean and prevalence-weighted mean."""
    g = list(group_cols)
    long = df.select(*g, F.col(label).alias("_y"), F.posexplode(probs).alias("cls", "p")).select(
        *g, "cls", "p", (F.col("_y") == F.col("cls")).cast("int").alias("y"))
    per = roc_auc(long, [*g, "cls"], "y", "p")
    return per.groupBy(*g).agg(
        F.round(F.avg("auc"), 6).alias("auc_macro"),
        F.round(F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos"), 6).alias("auc_weighted"),
        F.count(F.lit(1)).alias("n_classes"))


def roc_points(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
               score: str = "score") -> DataFrame:
    """Per distinct threshold (descending): cumulative tp/fp of scores >= it,
    fpr, tpr, precision, recall, and the previous point's recall/precision."""
    g = list(group_cols)
    per = df.groupBy(*g, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("tp_at"), F.count_if(F.col(label) != 1).alias("fp_at"))
    pre = ordered_prefix(per, ["threshold"], {"tp": F.col("tp_at"), "fp": F.col("fp_at")},
                         group_cols=g, rank_col="k", descending=True)
    tot = per.groupBy(*g).agg(F.sum("tp_at").alias("P"), F.sum("fp_at").alias("N"))
    j = pre.join(tot, g) if g else _join_single(pre, tot)
    tp = F.col("tp_before") + F.col("tp_at")
    fp = F.col("fp_before") + F.col("fp_at")
    return j.select(
        *g, "threshold", "k", tp.alias("tp"), fp.alias("fp"),
        _div(fp, F.col("N")).alias("fpr"), _div(tp, F.col("P")).alias("tpr"),
        _div(tp, tp + fp, 1.0).alias("precision"), _div(tp, F.col("P")).alias("recall"),
        _div(F.col("tp_before"), F.col("P"), 0.0).alias("prev_recall"),
        _div(F.col("tp_before"), F.col("tp_before") + F.col("fp_before"), 1.0).alias("prev_precision"))


def pr_auc(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under precision-recall, starting at (recall 0, precision 1)."""
    area = (F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2
    return points.groupBy(*group_cols).agg(F.round(F.sum(area), 6).alias("pr_auc"))


def binary_counts(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
                  prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def matthews(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """Matthews correlation from the 2x2 counts (0 when undefined)."""
    c = binary_counts(df, group_cols, label, prediction)
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*group_cols, F.round(_div(tp * tn - fp * fn, den, 0.0), 6).alias("mcc"))


def f1_binary(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Accuracy and F1 of the positive class."""
    c = binary_counts(df, group_cols, label, prediction)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(*group_cols,
                    F.round((tp + tn) / (tp + tn + fp + fn), 6).alias("accuracy"),
                    F.round(_div(2 * tp, 2 * tp + fp + fn, 0.0), 6).alias("f1"))


def average_ranks(df: DataFrame, col: str, out_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Average (tie-mean) ranks of ``col`` per group, via per-value counts and
    distributed prefix counts."""
    g = list(group_cols)
    per = df.groupBy(*g, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    pre = ordered_prefix(per, ["_v"], {"c": F.col("_c")}, group_cols=g, rank_col=None)
    ranks = pre.select(*g, F.col("_v").alias(col), (F.col("c_before") + (F.col("_c") + 1) / 2.0).alias(out_col))
    return df.join(ranks, [*g, col])


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where one side is constant (``corr`` raises
    a division by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_spearman(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation and Spearman (Pearson of average ranks)."""
    g = list(group_cols)
    r = average_ranks(average_ranks(df, x, "_rx", g), y, "_ry", g)
    return r.groupBy(*g).agg(F.round(correlation(x, y), 6).alias("pearson"),
                             F.round(correlation("_rx", "_ry"), 6).alias("spearman"))


def accuracy(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.round(F.avg((F.col(label) == F.col(prediction)).cast("double")), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def best_epoch(log: DataFrame, metric: str, group_cols: Sequence[str] = (), epoch: str = "epoch",
               patience: int = 4, mode: str = "max") -> DataFrame:
    """Best epoch by a monitored metric (running best, not the previous epoch)
    and the early-stop epoch: the first epoch ``patience`` epochs after the
    running best. The log is small (one row per epoch)."""
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    m = F.col(metric) if mode == "max" else -F.col(metric)
    earlier = Window.partitionBy(*g).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    run = log.withColumn("_m", m).withColumn("_before", F.max("_m").over(earlier))
    # an epoch improves only if it beats all before it, so a tie doesn't reset patience
    better = F.col("_before").isNull() | (F.col("_m") > F.col("_before"))
    run = run.withColumn("_best_epoch", F.max(F.when(better, F.col(epoch))).over(w))
    stop = run.where(F.col(epoch) - F.col("_best_epoch") >= patience).groupBy(*g).agg(
        F.min(epoch).alias("stop_epoch"))
    best = log.groupBy(*g).agg(
        F.max_by(epoch, F.struct(m, -F.col(epoch))).alias("best_epoch"),
        F.max(F.col(metric) if mode == "max" else -F.col(metric)).alias("_bm"),
        F.max(epoch).alias("last_epoch"))
    out = best.join(stop, g, "left") if g else _join_single(best, stop, "left")
    return out.select(*g, "best_epoch", F.coalesce("stop_epoch", "last_epoch").alias("stop_epoch"))
