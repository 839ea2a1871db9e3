"""Attribution measures over token scores of an additive scorer.

For a scorer p = f(sum of token weights, token count) (such as the lexicon
scorer), leave-one-out and AOPC variants are closed-form per token from the
document totals and per-document prefix sums, so no text is rebuilt and the
work stays linear in the number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.metrics import correlation


def _sig(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _p(s: Column, n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.5)).otherwise(_sig(s / n))


def token_weights(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``(key, pos, word, weight)`` with unknown words weighing 0, and the
    document totals S (sum of weights) and n (token count)."""
    tok = df.select(F.col(key).alias("case_id"), F.posexplode(T.tokenize_words(text, lower=True)).alias("pos", "word"))
    j = tok.join(lexicon, "word", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    tot = j.groupBy("case_id").agg(F.sum("weight").alias("S"), F.count(F.lit(1)).alias("n"))
    return j.join(tot, "case_id")


def leave_one_out(tw: DataFrame) -> DataFrame:
    """Score change p(full) - p(text without token i), per token."""
    full = _p(F.col("S"), F.col("n"))
    wo = _p(F.col("S") - F.col("weight"), F.col("n") - 1)
    return tw.withColumn("p_full", full).withColumn("loo", full - wo)


def aopc(tw: DataFrame) -> DataFrame:
    """AOPC comprehensiveness mean_k [p(full) - p(without top-k)] and
    sufficiency mean_k [p(full) - p(only top-k)], tokens ranked by weight
    (desc, then position); k = 1..n."""
    w = Window.partitionBy("case_id").orderBy(F.desc("weight"), "pos")
    r = tw.withColumn("k", F.row_number().over(w)).withColumn(
        "pk", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    full = _p(F.col("S"), F.col("n"))
    comp = full - _p(F.col("S") - F.col("pk"), F.col("n") - F.col("k"))
    suff = full - _p(F.col("pk"), F.col("k"))
    return r.groupBy("case_id").agg(F.round(F.avg(comp), 6).alias("comprehensiveness"),
                                    F.round(F.avg(suff), 6).alias("sufficiency"))


def rationale_overlap(tw: DataFrame, score: str = "loo", rationale: Column | None = None) -> DataFrame:
    """Top-k tokens by ``score`` (k = rationale size) against a 0/1 rationale:
    token F1 and IoU of the position sets."""
    rat = rationale if rationale is not None else (F.col("weight") > 0)
    t = tw.withColumn("r", rat.cast("int"))
    k = t.groupBy("case_id").agg(F.sum("r").alias("_k"))
    w = Window.partitionBy("case_id").orderBy(F.desc(score), "pos")
    t = t.join(k, "case_id").withColumn("_rank", F.row_number().over(w)).withColumn(
        "top", (F.col("_rank") <= F.col("_k")).cast("int"))
    agg = t.groupBy("case_id").agg(F.sum(F.col("top") * F.col("r")).alias("inter"),
                                   F.sum("top").alias("n_top"), F.sum("r").alias("n_rat"),
                                   F.sum(F.greatest("top", "r")).alias("union"))
    f1 = F.when(F.col("n_top") + F.col("n_rat") == 0, F.lit(0.0)).otherwise(2 * F.col("inter") / (F.col("n_top") + F.col("n_rat")))
    iou = F.when(F.col("union") == 0, F.lit(0.0)).otherwise(F.col("inter") / F.col("union"))
    return agg.select("case_id", F.round(f1, 6).alias("f1"), F.round(iou, 6).alias("iou"))


def _mean_rank(of: str) -> Column:
    """Rank of a token's value among those of its text, tied values at their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy("case_id", of))
    return F.rank().over(Window.partitionBy("case_id").orderBy(of)) + (ties - 1) / 2.0


def rank_agreement(tw: DataFrame, x: str = "weight", y: str = "loo") -> DataFrame:
    """Spearman of two token scores per text; null where one of them is constant. Ranks are
    windows over the tokens of one text, which is one row of the source."""
    ranks = tw.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        "case_id", _mean_rank(x).alias("_rx"), _mean_rank(y).alias("_ry"))
    return ranks.groupBy("case_id").agg(F.round(correlation("_rx", "_ry"), 6).alias("spearman"))


def rationale_pr_auc(tw: DataFrame, score: str = "loo", rationale: Column | None = None) -> DataFrame:
    """Trapezoid area under precision-recall of a token score against a 0/1 rationale, per
    text, from (recall 0, precision 1); null for a text without rationale. Tied scores are one
    threshold; cumulative counts are windows over the thresholds of one text."""
    rat = rationale if rationale is not None else (F.col("weight") > 0)
    per = tw.groupBy("case_id", F.col(score).alias("_s")).agg(
        F.count_if(rat).alias("tp_at"), F.count_if(~F.coalesce(rat, F.lit(False))).alias("fp_at"))
    w = Window.partitionBy("case_id")
    upto = w.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    c = per.select("case_id", "tp_at", "fp_at", F.sum("tp_at").over(upto).alias("tp"), F.sum("fp_at").over(upto).alias("fp"),
                   F.sum("tp_at").over(w).alias("P"))
    tp, fp = F.col("tp") - F.col("tp_at"), F.col("fp") - F.col("fp_at")
    before = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    step = F.when(F.col("P") > 0, F.col("tp_at") / F.col("P"))
    area = step * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2
    return c.groupBy("case_id").agg(F.round(F.sum(area), 6).alias("pr_auc"))
