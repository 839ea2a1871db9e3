"""Class statistics, numeric label transforms, dedup and batching helpers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import ordered_prefix


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column (one aggregate pass)."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def class_counts(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).alias("n"))


def prevalence(df: DataFrame, group_cols: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Share of positives."""
    return df.groupBy(*group_cols).agg(F.round(F.avg((F.col(label) == 1).cast("double")), 6).alias("prevalence"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight per class = 1 - n_c / N, keyed by label (not first-appearance order)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return counts.select(label, F.round(1 - F.col("_n") / F.lit(total), 6).alias("weight"))


def label_range(df: DataFrame, split_value: int, label: str = "label", strict: bool = False) -> DataFrame:
    """Min / max label and whether ``split_value`` lies inside; ``strict`` raises."""
    out = df.agg(F.min(label).alias("min_label"), F.max(label).alias("max_label")).select(
        "min_label", "max_label", F.lit(split_value).alias("split_value"),
        ((F.col("min_label") <= split_value) & (F.lit(split_value) <= F.col("max_label"))).alias("in_range"))
    if strict:
        row = out.first()
        if not row["in_range"]:
            raise ValueError(f"split value {split_value} is outside the label range "
                             f"[{row['min_label']}, {row['max_label']}]")
    return out


def running_weighted_mean(df: DataFrame, value: str, weight: str, group_cols: Sequence[str],
                          order_col: str, out_col: str = "running_mean") -> DataFrame:
    """Sample-weighted running mean sum(v*n)/sum(n) up to each row (distributed prefix sums)."""
    pre = ordered_prefix(df, [order_col], {"vw": F.col(value) * F.col(weight), "w": F.col(weight)},
                         group_cols=group_cols, rank_col=None)
    return pre.withColumn(out_col, (F.col("vw_before") + F.col(value) * F.col(weight))
                          / (F.col("w_before") + F.col(weight))).drop("vw_before", "w_before")


def logit(p) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.log(c / (1 - c))


def neutral_band(df: DataFrame, score: str = "score", margin: float = 1 / 3.0) -> DataFrame:
    """Binary probability to 3 classes (negative, neutral, positive).

    Within ``margin / 2`` of 0.5 the neutral class falls linearly from 1 with the
    distance (1 / margin per unit) and the nearer side takes the rest; beyond it the
    two outer classes keep 1 - p and p. Exactly on the edge all three are 0. Adds
    ``pp`` = [p0, p1, p2] and ``cls`` (first arg-max)."""
    p = F.col(score).cast("double")
    low_edge, high_edge = 0.5 - margin / 2.0, 0.5 + margin / 2.0
    share = F.abs(p - 0.5) / margin
    inside, beyond = (p > low_edge) & (p < high_edge), (p < low_edge) | (p > high_edge)
    low = F.when(beyond, 1 - p).when(inside & (p < 0.5), share).otherwise(0.0)
    high = F.when(beyond, p).when(inside & (p >= 0.5), share).otherwise(0.0)
    out = df.withColumn("pp", F.array(low, F.when(inside, 1 - share).otherwise(0.0), high))
    return out.withColumn("cls", (F.array_position("pp", F.array_max("pp")) - 1).cast("int"))


def pred_conf(df: DataFrame, label_text: str = "label", score: str = "score") -> DataFrame:
    """Pipeline output (``LABEL_k``, confidence of k) to class k and [p0, p1]."""
    cls = F.regexp_extract(F.col(label_text), "([0-9]+)$", 1).cast("int")
    p1 = F.when(cls == 1, F.col(score)).otherwise(1 - F.col(score))
    return df.withColumn("cls", cls).withColumn("probs", F.array(1 - p1, p1))


def dedup_first(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Drop null keys and duplicates, keeping the smallest id per key (a
    partial-aggregation group-by, robust to one very frequent key)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def sort_for_batching(df: DataFrame, id_col: str, length_col: str, batch_size: int = 32) -> DataFrame:
    """Rows of similar length in one batch: ``batch`` is the 0-based rank by (length, id)
    divided by ``batch_size``. Ranks are distributed prefix counts, so batches do not
    depend on the partitioning; the rows keep their id to restore the order."""
    ranked = ordered_prefix(df.select(id_col, length_col), [length_col, id_col], rank_col="_pos")
    batch = F.floor((F.col("_pos") - 1) / batch_size).cast("bigint")
    return df.join(ranked.select(id_col, batch.alias("batch")), id_col)
