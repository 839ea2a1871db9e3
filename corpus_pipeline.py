"""The training-data pipeline: quality rules, near-duplicate join, secret scan, mixture
and packing, each stage over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, ngram_join, packing, rules, secrets
from textloom.llm.common import table
from textloom.llm.queries import MIX_WEIGHTS, SPECIAL_TOKENS, mix_levels, tokenizer_ranks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced by their kind; ``n_chars`` follows a
    text that changed."""
    clean = docs.withColumn("__new", secrets.redact_column()(F.col("text")))
    length = F.when(F.col("__new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__new"))
    return clean.withColumn("n_chars", length.cast("long")).withColumn("text", F.col("__new")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; one that is taken in several epochs is repeated."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pack_documents(docs, tokenizer_ranks(), special=SPECIAL_TOKENS)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", redact_secrets),
          ("mixture", mixture), ("packing", pack)]
#: Tokenizing and learned rules have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
