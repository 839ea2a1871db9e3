"""Word counts and top-k over token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(df: DataFrame, tokens: str = "tokens", word: str = "word",
                count: str = "cnt") -> DataFrame:
    """Corpus word counts: explode + group; partial (map-side) aggregation keeps
    the shuffle at one row per (partition, word)."""
    return (df.select(F.explode(tokens).alias(word))
            .groupBy(word).agg(F.count(F.lit(1)).alias(count)))


def top_words(counts: DataFrame, k: int = 10, word: str = "word", count: str = "cnt") -> DataFrame:
    """k most frequent words, ties by word; planned as TakeOrderedAndProject
    (per-partition top-k, then a k-row merge)."""
    return counts.orderBy(F.desc(count), F.asc(word)).limit(k)


def digit_token_stats(vocab: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary tokens holding a digit and not containing ``unused``: count and share."""
    is_digit = F.col(word).rlike(r"\p{Nd}") & ~F.col(word).contains("unused")
    return vocab.agg(F.count_if(is_digit).alias("n_digit"), F.count(F.lit(1)).alias("n_vocab")).select(
        "n_digit", "n_vocab", F.round(F.col("n_digit") / F.col("n_vocab"), 6).alias("share"))


def in_vocabulary(terms: DataFrame, vocab: DataFrame, term: str = "term", word: str = "word") -> DataFrame:
    """Flag each term by vocabulary membership (left join on the word key; the
    vocabulary side is distinct so no row multiplies)."""
    v = vocab.select(F.col(word).alias(term)).distinct().withColumn("in_vocab", F.lit(True))
    return terms.join(v, term, "left").select(term, F.coalesce("in_vocab", F.lit(False)).alias("in_vocab"))


def vocab_overlap(a: DataFrame, b: DataFrame, word: str = "word") -> DataFrame:
    """Overlap of two vocabularies: sizes, intersection, union, both/union.
    One full-outer join of the distinct words, then a single aggregate."""
    va = a.select(word).distinct().withColumn("_a", F.lit(1))
    vb = b.select(word).distinct().withColumn("_b", F.lit(1))
    j = va.join(vb, word, "full_outer")
    return j.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                 F.count(F.lit(1)).alias("n_union")).withColumn(
        "overlap", F.round(F.col("n_both") / F.col("n_union"), 6))
