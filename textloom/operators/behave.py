"""Behavioural tests: perturb texts, score them, compare with the original.

Cases are rows ``(test, case_id, variant, text)`` (variant 0 = original).
Perturbations are array-valued Column functions (``explode`` gives the
variants); the scorer is any DataFrame function. A transparent lexicon
scorer (log-odds word weights fitted on labelled documents, logistic of the
mean weight) is provided so every step is a Spark join / aggregate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Template slots and perturbation word lists.
NOT_SEVERE_TAGS = ["good", "enjoyable", "exciting", "excellent", "amazing", "great", "engaging",
                   "healthy", "appropriate"]
SEVERE_TAGS = ["bad", "terrible", "awful", "horrible", "risky", "breach", "dangerous", "unhealthy"]
GENDER_PRONOUNS = ["she", "he"]
PATIENT_NOUNS = ["patient", "p1", "p2", "pt"]
NEGATION_VERBS = ["was", "did", "had"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_pattern(w: str) -> str:
    return r"\b" + w + r"\b"


def swap_words(text, words: Sequence[str]) -> Column:
    """For each listed word present as a whole word, one variant per other word
    with every occurrence replaced (e.g. she <-> he). None present: no variant."""
    t = _c(text)
    variants = []
    for p in words:
        for q in words:
            if p != q:
                variants.append(F.when(t.rlike(word_pattern(p)), F.regexp_replace(t, word_pattern(p), q)))
    return F.filter(F.array(*variants), lambda x: x.isNotNull())


def punctuation_variants(text) -> Column:
    """Strip the final punctuation, or add a full stop when there is none."""
    t = _c(text)
    stripped = F.regexp_replace(t, r"[.!?]+$", "")
    return F.array(F.when(stripped != t, stripped).otherwise(F.concat(t, F.lit("."))))


def typo(text, key, seed: int = 42) -> Column:
    """Swap two neighbouring characters at a hash-chosen place."""
    t = _c(text)
    n = F.length(t)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"))), 1, 8), 16, 10)
    i = (F.pmod(h.cast("long"), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    swapped = F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, 1), F.substring(t, i, 1),
                       F.substring(t, i + 2, n))
    return F.array(F.when(n >= 2, swapped))


def add_negation(text) -> Column:
    """Negate the first was / did / had: ``was`` -> ``was not`` (first match only)."""
    t = _c(text)
    pat = r"(?s)^(.*?)\b(" + "|".join(NEGATION_VERBS) + r")\b"
    return F.array(F.when(t.rlike(r"\b(" + "|".join(NEGATION_VERBS) + r")\b"),
                          F.regexp_replace(t, pat, "$1$2 not")))


def cases(df: DataFrame, key: str, text: str, test: str, perturb: Column) -> DataFrame:
    """Original (variant 0) plus one row per perturbed variant (1..k)."""
    orig = df.select(F.lit(test).alias("test"), F.col(key).alias("case_id"), F.lit(0).alias("variant"),
                     F.col(text).alias("text"))
    var = df.select(F.lit(test).alias("test"), F.col(key).alias("case_id"),
                    F.posexplode(perturb).alias("variant", "text")).withColumn("variant", F.col("variant") + 1)
    keep = var.select("case_id").distinct()
    return orig.join(keep, "case_id", "left_semi").unionByName(var.select("test", "case_id", "variant", "text"))


def place_variants(df: DataFrame, key: str, text: str, places: DataFrame, place_col: str = "place",
                   test: str = "change_location") -> DataFrame:
    """Replace a place name found in the text by each other place of the
    lexicon (lexicon joined by a whole-word match on the exploded words)."""
    words = df.select(F.col(key).alias("case_id"), F.col(text).alias("text"),
                      F.explode(F.array_distinct(T.tokenize_words(text))).alias("w"))
    lex = places.select(F.col(place_col).alias("w"))
    found = words.join(lex, "w")  # equi-join on the word
    # the lexicon as one array row (a bounded word list), attached by a constant key
    others = places.agg(F.collect_set(place_col).alias("others")).withColumn("_k", F.lit(1))
    var = found.withColumn("_k", F.lit(1)).join(F.broadcast(others), "_k").drop("_k")
    var = var.select("case_id", "text", "w", F.explode(F.filter("others", lambda o: o != F.col("w"))).alias("other"))
    return var.select(F.lit(test).alias("test"), "case_id",
                      F.regexp_replace("text", F.concat(F.lit(r"\b\Q"), F.col("w"), F.lit(r"\E\b")), F.col("other")).alias("text"),
                      "w", "other")


def fit_lexicon(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", tokens: str = "tokens",
                label: str = "label", min_df: int = 1) -> DataFrame:
    """Word weights = ln((df_pos + 1) / (df_neg + 1)) over labelled documents."""
    lab = docs.join(labels.select(doc_col, F.col(label).alias("_y")), doc_col)
    w = lab.select(doc_col, "_y", F.explode(F.array_distinct(tokens)).alias("word"))
    agg = w.groupBy("word").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    return agg.where(F.col("pos") + F.col("neg") >= min_df).select(
        "word", F.log((F.col("pos") + 1) / (F.col("neg") + 1)).alias("weight"))


def lexicon_score(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """p1 = logistic(mean word weight of the lower-cased word tokens);
    unknown words weigh 0; empty text scores 0.5. Adds p1, p0, prediction."""
    k = list(keys)
    tok = df.select(*k, F.explode_outer(T.tokenize_words(text, lower=True)).alias("word"))
    j = tok.join(lexicon, "word", "left")
    agg = j.groupBy(*k).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("_s"), F.count("word").alias("_n"))
    z = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_s") / F.col("_n"))
    p1 = 1 / (1 + F.exp(-z))
    return agg.select(*k, p1.alias("p1")).withColumn("p0", 1 - F.col("p1")).withColumn(
        "prediction", (F.col("p1") > 0.5).cast("int"))


def test_vs_original(scored: DataFrame) -> DataFrame:
    """Each variant's prediction next to its original's (variant 0)."""
    o = scored.where(F.col("variant") == 0).select("test", "case_id", F.col("prediction").alias("pred0"),
                                                   F.col("p1").alias("p1_orig"))
    v = scored.where(F.col("variant") > 0)
    return v.join(o, ["test", "case_id"])


def inv_results(pairs: DataFrame) -> DataFrame:
    """Invariance: a case fails when any variant's prediction differs."""
    return pairs.groupBy("test", "case_id").agg(F.max((F.col("prediction") != F.col("pred0")).cast("int")).alias("fail"))


def dir_monotonic(pairs: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Directional, p(label 1) must not increase by more than ``tolerance``."""
    return pairs.groupBy("test", "case_id").agg(
        F.max((F.col("p1") - F.col("p1_orig") > tolerance).cast("int")).alias("fail"))


def mft_results(scored: DataFrame, expected: str = "expected") -> DataFrame:
    """Minimum functionality: fail when prediction != expected label."""
    return scored.select("test", "case_id", (F.col("prediction") != F.col(expected)).cast("int").alias("fail"))


def summary(results: DataFrame, capability_col: str = "capability") -> DataFrame:
    """Suite table by capability and test: cases, fails, fail rate, one example failure."""
    return results.groupBy(capability_col, "test").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("fail").alias("n_fail"),
        F.round(F.avg("fail"), 6).alias("fail_rate"),
        F.min(F.when(F.col("fail") == 1, F.col("case_id"))).alias("example_case"))


def template_cases(nouns: DataFrame, noun_col: str = "word") -> DataFrame:
    """"This is not {a/an adjective} {noun}." for every noun x adjective slot,
    labelled 1 for not-severe adjectives and 0 for severe ones. The adjective
    lists are attached as array literals and exploded (no join)."""
    slots = F.array(*[F.struct(F.lit(a).alias("adj"), F.lit(1).alias("label")) for a in NOT_SEVERE_TAGS],
                    *[F.struct(F.lit(a).alias("adj"), F.lit(0).alias("label")) for a in SEVERE_TAGS])
    x = nouns.select(F.col(noun_col).alias("noun"), F.explode(slots).alias("s"))
    art = F.when(F.substring("s.adj", 1, 1).isin("a", "e", "i", "o", "u"), "an").otherwise("a")
    return x.select("noun", F.col("s.adj").alias("adj"), F.col("s.label").alias("label"),
                    F.concat(F.lit("This is not "), art, F.lit(" "), F.col("s.adj"), F.lit(" "), F.col("noun"),
                             F.lit(".")).alias("text"))
