"""Queries for topic evaluation (2.13): topics are the document languages,
topic words the 10 most frequent non-stop words of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicon import stop_words
from textloom.operators import topics as TP
from textloom.operators.common import drop_stopwords, evaluate_once
from textloom.operators.density import density_clusters
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.sources import tables as S

ST_SQL = f"st AS (SELECT doc_id, lang AS topic, {Q.remove_stopwords(Q.tokens('text'))} AS tokens FROM documents)"
TW_SQL = """tw AS (SELECT topic, word FROM (
  SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, word) AS r FROM (
    SELECT topic, word, count(*) AS cnt FROM (SELECT topic, unnest(tokens) AS word FROM st) GROUP BY topic, word))
  WHERE r <= 10)"""
NPMI_SQL = f"""WITH {ST_SQL}, {TW_SQL},
pres AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(tokens) AS word FROM st) WHERE word IN (SELECT word FROM tw)),
dfw AS (SELECT word, count(*) AS df FROM pres GROUP BY word),
a AS (SELECT p.doc_id, tw.topic, p.word AS wi FROM pres p JOIN tw USING (word)),
co AS (SELECT a.topic, a.wi, b.wi AS wj, count(*) AS dij FROM a JOIN a b ON a.doc_id = b.doc_id AND a.topic = b.topic AND a.wi < b.wi
       GROUP BY a.topic, a.wi, b.wi),
pairs AS (SELECT x.topic, x.word AS wi, y.word AS wj FROM tw x JOIN tw y ON x.topic = y.topic AND x.word < y.word),
nd AS (SELECT count(*) AS n FROM st),
pm AS (SELECT p.topic, coalesce(co.dij, 0) / nd.n AS pij, coalesce(di.df, 0) / nd.n AS pi, coalesce(dj.df, 0) / nd.n AS pj
       FROM pairs p LEFT JOIN co USING (topic, wi, wj) LEFT JOIN dfw di ON di.word = p.wi
       LEFT JOIN dfw dj ON dj.word = p.wj CROSS JOIN nd),
npmi AS (SELECT topic, round(avg(CASE WHEN pij = 0 THEN -1.0 WHEN pij = 1 THEN 1.0 ELSE ln(pij / (pi * pj)) / (-ln(pij)) END), 6) AS npmi,
                count(*) AS n_pairs FROM pm GROUP BY topic)
"""


def stop_docs(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    t = d.select("doc_id", F.col("lang").alias("topic"), T.tokenize_words("text").alias("raw"))
    return drop_stopwords(t, "raw", "tokens", stop_words()).select("doc_id", "topic", "tokens")


def _npmi(spark, sf_dir):
    docs = stop_docs(spark, sf_dir)
    tw = TP.top_words_per_topic(docs, "topic", "tokens", 10)
    return TP.npmi(docs, tw, n_docs=S.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("_nd")))


@query("top_npmi", sql=NPMI_SQL + "SELECT * FROM npmi")
def q_npmi(spark, sf_dir):
    return _npmi(spark, sf_dir)


@query("top_diversity", sql=f"WITH {ST_SQL}, {TW_SQL} SELECT round(count(DISTINCT word) / count(*), 6) AS diversity FROM tw")
def q_diversity(spark, sf_dir):
    docs = stop_docs(spark, sf_dir)
    return TP.diversity(TP.top_words_per_topic(docs, "topic", "tokens", 10))


CTFIDF_SQL = """tf AS (SELECT topic, word, count(*) AS tf FROM (SELECT topic, unnest(tokens) AS word FROM st) GROUP BY topic, word),
ft AS (SELECT word, sum(tf) AS ft FROM tf GROUP BY word),
av AS (SELECT avg(w) AS a FROM (SELECT topic, sum(tf) AS w FROM tf GROUP BY topic)),
w AS (SELECT tf.topic, tf.word, tf.tf * ln(1 + av.a / ft.ft) AS c FROM tf JOIN ft USING (word) CROSS JOIN av)
SELECT topic, word, rank, round(c, 6) AS ctfidf FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, word) AS rank FROM w) WHERE rank <= 10"""
#: Density clusters of the embeddings (5 neighbours, cut at the first decile of the core distances, 5
#: vectors or more): the components of the graph of edges up to the cut.
CLUSTERS_SQL = """nd AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS r FROM nd) WHERE r <= 5),
core AS (SELECT id, max(d) AS core FROM kn GROUP BY id),
eg AS (SELECT DISTINCT least(id, nbr) AS a, greatest(id, nbr) AS b, d FROM kn),
ew AS (SELECT eg.a, eg.b, greatest(d, ca.core, cb.core) AS w FROM eg JOIN core ca ON ca.id = eg.a JOIN core cb ON cb.id = eg.b),
near AS (SELECT * FROM ew WHERE w <= (SELECT quantile_cont(core, 0.1) FROM core)),
st2 AS (SELECT a AS x, b AS y FROM near UNION SELECT b, a FROM near),
reach AS (SELECT x, y FROM st2 UNION SELECT reach.x, st2.y FROM reach JOIN st2 ON reach.y = st2.x),
part AS (SELECT x AS id, least(x, min(y)) AS cluster FROM reach GROUP BY x),
clusters AS (SELECT id, cluster FROM part WHERE cluster IN (SELECT cluster FROM part GROUP BY cluster HAVING count(*) >= 5))"""


def found_clusters(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return density_clusters(e, k=5, cut=F.percentile("core", 0.1), min_size=5)


@query("top_cluster_topics", sql=f"""WITH RECURSIVE {CLUSTERS_SQL},
st AS (SELECT cluster AS topic, tokens FROM clusters JOIN (
  SELECT doc_id, {Q.remove_stopwords(Q.tokens('text'))} AS tokens FROM documents) d ON d.doc_id = clusters.id), {CTFIDF_SQL}""")
def q_cluster_topics(spark, sf_dir):
    """Words of each density cluster of document vectors by class-based TF-IDF; the vector
    of a document is the embedding with its id, where there is one."""
    docs = stop_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "tokens")
    found = found_clusters(spark, sf_dir).where("cluster is not null").withColumnRenamed("cluster", "topic")
    return TP.class_tfidf(docs.join(found, "id"), "topic", "tokens", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("top_cluster_sizes", sql=f"""WITH RECURSIVE {CLUSTERS_SQL}
SELECT cluster, count(*) AS n, count(DISTINCT label) AS n_labels
FROM embeddings LEFT JOIN clusters ON clusters.id = vec_id GROUP BY cluster""")
def q_cluster_sizes(spark, sf_dir):
    """Vectors and labels of each density cluster; null is noise."""
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return found_clusters(spark, sf_dir).join(e, "id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"))


@query("top_class_topics", sql=f"WITH {ST_SQL}, {CTFIDF_SQL}")
def q_class_topics(spark, sf_dir):
    """Words per given class (language) by class-based TF-IDF."""
    return TP.class_tfidf(stop_docs(spark, sf_dir), "topic", "tokens", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("top_results_table", sql=NPMI_SQL + """
SELECT 'documents' AS dataset, 'frequency' AS model, CAST(count(*) AS BIGINT) AS nr_topics,
       round(avg(npmi), 6) AS mean, round(stddev_samp(npmi), 6) AS sd, count(*) AS n,
       round(1.96 * stddev_samp(npmi) / sqrt(count(*)), 6) AS ci95 FROM npmi""")
def q_results_table(spark, sf_dir):
    """Mean NPMI with 95 % interval per (dataset, model, number of topics)."""
    runs = _npmi(spark, sf_dir).select(F.lit("documents").alias("dataset"), F.lit("frequency").alias("model"), "npmi")
    table = TP.results_table(runs, keys=("dataset", "model"))
    return table.withColumn("nr_topics", F.col("n"))     # one row per topic
