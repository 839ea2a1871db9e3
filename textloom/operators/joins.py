"""Lookup joins: label names, class index remap, anti-join splits.

Lookup tables here are keyed by class (bounded by the number of classes);
they are marked for broadcast only through AQE's runtime size check
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), never unconditionally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.lexicon import LABEL_NAMES


def label_name_table(spark: SparkSession, dataset: str) -> DataFrame:
    names = LABEL_NAMES[dataset]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "label int, name string")


def label_names(df: DataFrame, spark: SparkSession, dataset: str, label_col: str = "label") -> DataFrame:
    """Index to class name for readable output (unknown index gives null)."""
    names = label_name_table(spark, dataset).withColumnRenamed("label", label_col)
    return df.join(F.broadcast(names), label_col, "left")  # fixed-size table (class names)


def class_index(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Sorted distinct classes to a dense index 0..K-1: ``(label, idx)``.
    The window runs over the distinct classes only (aggregate first)."""
    classes = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return classes.withColumn("idx", (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int"))


def label_remap(df: DataFrame, index: DataFrame, label_col: str = "label",
                out_col: str = "label_idx") -> DataFrame:
    """Map raw class to the train index; a class unseen in train gives null."""
    return df.join(index.withColumnRenamed("idx", out_col), label_col, "left")


def anti_split(df: DataFrame, taken: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows not in ``taken`` (e.g. test = all rows not sampled into train)."""
    return df.join(taken.select(id_col), id_col, "left_anti")
