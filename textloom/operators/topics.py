"""Topic evaluation: top words per topic, NPMI coherence, diversity,
class-based TF-IDF, and result-table aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.common import materialize, small_side, with_one_row


def top_words_per_topic(df: DataFrame, topic: str, tokens: str, k: int = 10) -> DataFrame:
    """``(topic, word, cnt, rank)``: the k most frequent words per topic (ties
    by word); the per-topic rank filter plans as a partial WindowGroupLimit."""
    c = df.select(topic, F.explode(tokens).alias("word")).groupBy(topic, "word").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(topic).orderBy(F.desc("cnt"), "word")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def npmi(docs: DataFrame, topic_words: DataFrame, doc_col: str = "doc_id", tokens: str = "tokens",
         topic: str = "topic", n_docs: DataFrame | None = None) -> DataFrame:
    """Mean NPMI of the word pairs of each topic over document co-occurrence:
    NPMI = ln(p_ij / (p_i p_j)) / -ln(p_ij), -1 when a pair never co-occurs.
    Only topic words are kept before the per-document pairing, so a document
    contributes at most (words per topic)^2 pairs. The topic words are found once, and where
    they are few they go to the documents; so the texts are read once more, and only
    topic words move. ``n_docs`` is the number of documents as one row ``_nd``, if it can
    be had without their tokens."""
    n_docs = n_docs if n_docs is not None else docs.agg(F.count(F.lit(1)).alias("_nd"))
    tw = materialize(topic_words.select(topic, "word"))
    pres = materialize(docs.select(doc_col, F.explode(F.array_distinct(tokens)).alias("word")).join(
        small_side(tw.select("word").distinct()), "word"))
    df_w = pres.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    a = pres.join(tw, "word").select(doc_col, topic, F.col("word").alias("wi"))
    b = a.select(doc_col, topic, F.col("wi").alias("wj"))
    co = a.join(b, [doc_col, topic]).where(F.col("wi") < F.col("wj")).groupBy(topic, "wi", "wj").agg(
        F.count(F.lit(1)).alias("dij"))
    pairs = (tw.select(topic, F.col("word").alias("wi")).join(tw.select(topic, F.col("word").alias("wj")), topic)
             .where(F.col("wi") < F.col("wj")))
    j = (pairs.join(co, [topic, "wi", "wj"], "left")
         .join(df_w.select(F.col("word").alias("wi"), F.col("df").alias("di")), "wi", "left")
         .join(df_w.select(F.col("word").alias("wj"), F.col("df").alias("dj")), "wj", "left"))
    j = with_one_row(j, n_docs)
    pij = F.coalesce("dij", F.lit(0)) / F.col("_nd")
    pi = F.coalesce("di", F.lit(0)) / F.col("_nd")
    pj = F.coalesce("dj", F.lit(0)) / F.col("_nd")
    v = F.when(pij == 0, F.lit(-1.0)).when(pij == 1, F.lit(1.0)).otherwise(
        F.log(pij / (pi * pj)) / (-F.log(pij)))
    return j.groupBy(topic).agg(F.round(F.avg(v), 6).alias("npmi"), F.count(F.lit(1)).alias("n_pairs"))


def diversity(topic_words: DataFrame) -> DataFrame:
    """Share of unique words over the top words of all topics."""
    return topic_words.agg(F.round(F.countDistinct("word") / F.count(F.lit(1)), 6).alias("diversity"))


def class_tfidf(df: DataFrame, cls: str, tokens: str, k: int = 10) -> DataFrame:
    """c-TF-IDF per class: w = tf_{t,c} * ln(1 + A / f_t), A = mean words per
    class, f_t = frequency of t over all classes. Top k words per class."""
    tf = df.select(cls, F.explode(tokens).alias("word")).groupBy(cls, "word").agg(F.count(F.lit(1)).alias("tf"))
    ft = tf.groupBy("word").agg(F.sum("tf").alias("ft"))
    tot = tf.groupBy(cls).agg(F.sum("tf").alias("words"))
    w = with_one_row(tf.join(ft, "word"), tot.agg(F.avg("words").alias("_avg"))).withColumn(
        "ctfidf", F.col("tf") * F.log(1 + F.col("_avg") / F.col("ft")))
    win = Window.partitionBy(cls).orderBy(F.desc("ctfidf"), "word")
    return (w.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)
            .select(cls, "word", "rank", F.round("ctfidf", 6).alias("ctfidf")))


def results_table(results: DataFrame, keys=("dataset", "model", "nr_topics"), metric: str = "npmi") -> DataFrame:
    """Mean, standard deviation, count and 95 % half-width per result group."""
    g = results.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev(metric).alias("sd"),
                                   F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n",
                    F.round(1.96 * F.col("sd") / F.sqrt("n"), 6).alias("ci95"))
