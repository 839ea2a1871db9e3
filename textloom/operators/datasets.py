"""Labelled-set preparation: projections, task reshaping and label rules."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raw code columns and the task each one holds.
TASK_COLUMNS: dict[str, str] = {
    "Key.PD09": "severity",
    "Key.IN05": "type",
    "Key.RP02": "location",
}


def text_label(df: DataFrame, text_col: str = "text", label_col: str = "label",
               id_col: str | None = "id") -> DataFrame:
    """Keep ``(id, text, label)``; label cast to int. Output text column is
    always ``text`` whatever the input column is called."""
    cols = ([F.col(id_col)] if id_col else []) + [
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")]
    return df.select(*cols)


def rename_tasks(df: DataFrame, mapping: dict[str, str] = TASK_COLUMNS) -> DataFrame:
    """Rename raw code columns (dotted names) to task names."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def multi_task(df: DataFrame, tasks: Sequence[str] = ("severity", "type", "location"),
               text_col: str = "text", id_col: str = "id") -> DataFrame:
    """One long ``(id, text, task, label)`` table over all tasks, label nulls dropped
    (instead of one pass per task)."""
    long = df.select(id_col, F.col(text_col).alias("text"),
                     *[F.col(t).cast("int").alias(t) for t in tasks]).unpivot(
        [id_col, "text"], list(tasks), "task", "label")
    return long.where(F.col("label").isNotNull())


def drop_train_label(df: DataFrame, label_col: str = "label", bad_label: int = 6,
                     split_col: str = "split") -> DataFrame:
    """Remove a meaningless label from the train split only."""
    return df.where((F.col(split_col) != "train") | (F.col(label_col) < bad_label))


def binary_transform(df: DataFrame, split_value: int = 3, label_col: str = "label",
                     check_range: bool = True) -> DataFrame:
    """Labels below ``split_value`` become 0, the others 1 (one ``when``).
    The range check raises with the full message when the split is outside."""
    if check_range:
        lo, hi = df.agg(F.min(label_col), F.max(label_col)).first()
        if lo is not None and not (lo <= split_value <= hi):
            raise ValueError(f"split value {split_value} is outside the label range [{lo}, {hi}]")
    return df.withColumn(label_col, F.when(F.col(label_col) < split_value, 0).otherwise(1))


def label_shift(df: DataFrame, label_col: str = "label", offset: int = 1) -> DataFrame:
    """1-based to 0-based labels (``label_offset`` parameter)."""
    return df.withColumn(label_col, F.col(label_col) - offset)
