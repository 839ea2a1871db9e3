"""Sentences by abbreviations that are learned from the corpus.

A full stop after a word ends a sentence unless the word is an abbreviation. Whether it is
one is told by counts over the whole corpus (Kiss and Strunk, 2006): the likelihood ratio of
"the word nearly always has its stop" against "it has one as often as any word", scaled by
its length, its inner stops and its occurrences without a stop. The counts are group-bys
on the words, and pieces meet the abbreviations in an equi-join, so neither has a limit."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.common import evaluate_once, materialize, small_side, with_one_row

#: Marks around a word that are not part of it; a full stop is.
BEFORE, AFTER = "\"'([{«“‘", "\"')]}»”’,;:!?"


def _words(c: Column) -> Column:
    return F.split(c, r"[ \t]+")


def _core(word: Column) -> Column:
    return F.lower(F.rtrim(F.ltrim(word, F.lit(BEFORE)), F.lit(AFTER)))


def _kind(core: Column) -> Column:
    """The word without its last full stop; null for what is not letters and inner stops."""
    w = F.when(core.endswith("."), core.substr(F.lit(1), F.length(core) - 1)).otherwise(core)
    return F.when((w != "") & ~w.endswith(".") & ~w.startswith(".") & ~w.rlike(r"[^\p{L}.]"), w)


def abbreviations(paragraphs: DataFrame, text: str, threshold: float = 0.3) -> DataFrame:
    """(word, score) of every word type that is an abbreviation, without its last stop."""
    forms = paragraphs.select(F.explode(_words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    cores = forms.groupBy(_core(F.col("w")).alias("c")).agg(F.sum("m").alias("m"))    # each form is read once
    counts = materialize(
        cores.select(_kind(F.col("c")).alias("word"), F.col("c").endswith(".").cast("int").alias("dot"), "m")
        .where("word IS NOT NULL").groupBy("word")
        .agg(F.sum("m").alias("n"), F.sum(F.col("dot") * F.col("m")).alias("k")))
    all_ = counts.agg((F.sum("k") / F.sum("n")).alias("p"))
    rest, size = F.col("n") - F.col("k"), F.length(F.replace("word", F.lit("."), F.lit("")))
    ratio = 2 * (F.col("k") * (F.lit(log(0.99)) - F.log("p")) + rest * (F.lit(log(0.01)) - F.log(1 - F.col("p"))))
    score = (ratio * F.exp(-size.cast("double")) * (F.length("word") - size + 1)
             * F.pow(size.cast("double"), -rest.cast("double")))
    return (with_one_row(counts.where("k > 0"), all_).where("p < 1").select("word", score.alias("score"))
            .where(F.col("score") >= threshold))


def split_sentences(paragraphs: DataFrame, keys: list[str], text: str, threshold: float = 0.3) -> DataFrame:
    """``keys``, ``sent`` (from 0) and ``sentence``: every paragraph of ``text`` cut after
    ``.``, ``!`` or ``?`` and white space, but not after an abbreviation. ``keys`` name a
    paragraph; empty ones and nulls give no rows."""
    cut = F.split(F.regexp_replace(F.btrim(F.col(text), F.lit(" \t")), r"([.!?])[ \t]+", "$1\n"), "\n")
    whole = paragraphs.select(*keys, text).repartition(*keys)    # a paragraph moves once, its pieces don't
    pieces = whole.select(*keys, F.posexplode(cut).alias("_i", "_piece")).where("_piece <> ''")
    last = F.substring_index(F.translate("_piece", "\t", " "), " ", -1)
    pieces = evaluate_once(pieces.withColumn("_c", F.when(F.col("_piece").endswith("."), _core(last))), "_c")
    pieces = pieces.withColumn("_w", _kind(F.col("_c"))).drop("_c")
    known = small_side(materialize(
        abbreviations(paragraphs, text, threshold).select(F.col("word").alias("_w"), F.lit(True).alias("_abbr"))))
    w = Window.partitionBy(*keys).orderBy("_i")
    opens = F.when(F.lag(F.coalesce("_abbr", F.lit(False)), 1, False).over(w), 0).otherwise(1)
    numbered = (pieces.join(known, "_w", "left").withColumn("_opens", opens)
                .withColumn("sent", (F.sum("_opens").over(w) - F.first("_opens").over(w)).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_piece"))), lambda x: x["_piece"]), " ")
    return numbered.groupBy(*keys, "sent").agg(joined.alias("sentence"))
