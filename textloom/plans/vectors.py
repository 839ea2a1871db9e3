"""Queries for vector operators, similarity search and pooling (2.3 pairwise /
anchor joins, 2.4 pooling rows, 2.5 rank rows, 2.7) over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import vectors as V
from textloom.operators.common import materialize
from textloom.plans.registry import query
from textloom.sources import tables as S

# anchors: the first vector (lowest id) of each label
ANCHORS_SQL = """anchors AS (SELECT label, min(vec_id) AS qid FROM embeddings GROUP BY label),
av AS (SELECT a.label, a.qid, e.embedding AS qvec FROM anchors a JOIN embeddings e ON e.vec_id = a.qid)"""
COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
DIST = "list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


#: Edge threshold. The supplied vectors have few pairs above 0.6, so the query takes 0.3.
EDGE_ABOVE = 0.3


def emb(spark, sf_dir):
    return S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
                                                     "label")


def anchors(spark, sf_dir):
    e = emb(spark, sf_dir)
    first = e.groupBy("label").agg(F.min("id").alias("qid"))
    return first.join(e.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")


@query("join_pairwise_similarity", sql=f"""
SELECT id, nbr, rank, round(sim, 6) AS sim FROM (
  SELECT a.vec_id AS id, b.vec_id AS nbr, {COS.format(a='a.embedding', b='b.embedding')} AS sim,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
WHERE rank <= 10""")
def q_pairwise(spark, sf_dir):
    """Top-10 cosine neighbours of every vector (exact; blocks that are too far apart are skipped)."""
    nn = V.top_k_neighbours(emb(spark, sf_dir), k=10)
    return nn.withColumn("rank", F.col("rank").cast("bigint")).withColumn("sim", F.round("sim", 6))


RANKED_SQL = f"""WITH {ANCHORS_SQL},
sc AS (SELECT av.qid, e.vec_id AS id, {COS.format(a='e.embedding', b='av.qvec')} AS sim,
              {DIST.format(a='e.embedding', b='av.qvec')} AS dist
       FROM av JOIN embeddings e ON e.vec_id <> av.qid),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank_cos,
              row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank_euc,
              row_number() OVER (PARTITION BY qid ORDER BY sim, id) AS rank_far FROM sc)
"""


def _scored(spark, sf_dir):
    return V.rank_against(anchors(spark, sf_dir), emb(spark, sf_dir))


@query("rank_most_similar", sql=RANKED_SQL + """
SELECT qid, id, rank_cos, rank_euc, round(sim, 6) AS sim, round(dist, 6) AS dist FROM rk""")
def q_most_similar(spark, sf_dir):
    """Every other vector ranked for each anchor, by cosine (desc) and by
    euclidean distance (asc); ranks are distributed prefix counts."""
    sc = _scored(spark, sf_dir)
    r = V.ranked(V.ranked(sc, "sim", True, "rank_cos"), "dist", False, "rank_euc")
    return r.select("qid", "id", "rank_cos", "rank_euc", F.round("sim", 6).alias("sim"),
                    F.round("dist", 6).alias("dist"))


@query("rank_slice", sql=RANKED_SQL + """
SELECT qid, id, 'near_11_20' AS kind, rank_cos AS rank FROM rk WHERE rank_cos BETWEEN 11 AND 20
UNION ALL SELECT qid, id, 'farthest' AS kind, rank_far AS rank FROM rk WHERE rank_far <= 10""")
def q_rank_slice(spark, sf_dir):
    """Ranks 11-20 of the nearest list, and the 10 most dissimilar (nearest to
    the negated vector = lowest cosine)."""
    sc = _scored(spark, sf_dir)
    w_near = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    w_far = Window.partitionBy("qid").orderBy(F.asc("sim"), "id")
    near = (sc.withColumn("rank", F.row_number().over(w_near)).where(F.col("rank") <= 20)
            .where(F.col("rank") >= 11).select("qid", "id", F.lit("near_11_20").alias("kind"), "rank"))
    far = (sc.withColumn("rank", F.row_number().over(w_far)).where(F.col("rank") <= 10)
           .select("qid", "id", F.lit("farthest").alias("kind"), "rank"))
    return near.unionByName(far).withColumn("rank", F.col("rank").cast("bigint"))


PAIR_SQL = f"WITH {ANCHORS_SQL}\n"


def _with_anchor(spark, sf_dir):
    return emb(spark, sf_dir).join(anchors(spark, sf_dir), "label")


@query("vec_cosine", sql=PAIR_SQL + f"""
SELECT e.vec_id AS id, av.qid, round({COS.format(a='e.embedding', b='av.qvec')}, 6) AS sim,
       round(1 - {COS.format(a='e.embedding', b='av.qvec')}, 6) AS cos_dist
FROM embeddings e JOIN av USING (label)""")
def q_cosine(spark, sf_dir):
    """Cosine similarity / distance of each vector to its label's anchor."""
    j = _with_anchor(spark, sf_dir)
    c = V.cosine("vec", "qvec")
    return j.select("id", "qid", F.round(c, 6).alias("sim"), F.round(1 - c, 6).alias("cos_dist"))


@query("vec_euclidean", sql=PAIR_SQL + f"""
SELECT e.vec_id AS id, av.qid, round({DIST.format(a='e.embedding', b='av.qvec')}, 6) AS dist
FROM embeddings e JOIN av USING (label)""")
def q_euclidean(spark, sf_dir):
    j = _with_anchor(spark, sf_dir)
    return j.select("id", "qid", F.round(V.euclidean("vec", "qvec"), 6).alias("dist"))


@query("join_anchor_queries", sql=PAIR_SQL + f""",
centre AS (SELECT list(m ORDER BY i) AS c FROM (
  SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)),
ev AS (SELECT vec_id, label, embedding, list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda z: z[1] - z[2]) AS cv
       FROM embeddings CROSS JOIN centre)
SELECT e.vec_id AS id, label, round({COS.format(a='e.embedding', b='a.embedding')}, 6) AS sim_raw,
       round(list_cosine_similarity(e.cv, a.cv), 6) AS sim_sphered
FROM ev e JOIN av USING (label) JOIN ev a ON a.vec_id = av.qid WHERE e.vec_id <> av.qid""")
def q_anchor_queries(spark, sf_dir):
    """Similarity of each query to its anchor in two representations, the given vectors
    ('raw') and the vectors about the corpus centroid ('sphered'): one table of anchors and
    queries for each, put together and pivoted."""
    e = emb(spark, sf_dir)

    def of(model, vectors):
        a = vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
        first = vectors.groupBy("label").agg(F.min("id").alias("qid")).join(a, "qid")
        j = vectors.join(first, "label").where(F.col("id") != F.col("qid"))
        return j.select("id", "label", F.lit(model).alias("model"), F.round(V.cosine("vec", "qvec"), 6).alias("sim"))
    long = of("sim_raw", e).unionByName(of("sim_sphered", V.sphereize(e, "vec")))
    return long.groupBy("id", "label").pivot("model", ["sim_raw", "sim_sphered"]).agg(F.first("sim"))


@query("vec_similarity_edges", sql=f"""
SELECT src, dst, round(weight, 6) AS weight, round(weight * 100, 4) AS weight_x100,
       CAST(weight = min(weight) OVER () AS BOOLEAN) AS is_min_edge FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, {COS.format(a='a.embedding', b='b.embedding')} AS weight
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
WHERE weight > 0.3""")
def q_similarity_edges(spark, sf_dir):
    """Graph edge list of pairs with cosine > 0.3, weight x 100, and the minimum edge."""
    e = materialize(V.similarity_edges(emb(spark, sf_dir), EDGE_ABOVE))
    least = e.agg(F.min("weight").alias("_least")).withColumn("_one", F.lit(1))
    e = e.withColumn("_one", F.lit(1)).join(F.broadcast(least), "_one")
    return e.select("src", "dst", F.round("weight", 6).alias("weight"),
                    F.round(F.col("weight") * 100, 4).alias("weight_x100"),
                    (F.col("weight") == F.col("_least")).alias("is_min_edge"))


@query("vec_pair_similarity", sql=PAIR_SQL + f"""
SELECT a.label, a.qid AS a, b.qid AS b, round({COS.format(a='a.qvec', b='b.qvec')}, 6) AS sim
FROM av a JOIN av b ON b.label = (a.label + 1) % 10""")
def q_pair_similarity(spark, sf_dir):
    """Similarity of two named items: each label's anchor and the next label's."""
    a = anchors(spark, sf_dir)
    b = a.select(F.col("label").alias("blabel"), F.col("qid").alias("b"), F.col("qvec").alias("bvec"))
    j = a.join(b, F.col("blabel") == F.pmod(F.col("label") + 1, F.lit(10)))
    return j.select("label", F.col("qid").alias("a"), "b", F.round(V.cosine("qvec", "bvec"), 6).alias("sim"))


@query("vec_odd_one_out", sql="""
WITH unit AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]),
               lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings),
dims AS (SELECT label, i, avg(u[i]) AS m FROM (SELECT label, u, unnest(generate_series(1, len(u))) AS i FROM unit) GROUP BY label, i),
mean AS (SELECT label, list(m ORDER BY i) AS mv FROM dims GROUP BY label)
SELECT label, arg_min(vec_id, (s, vec_id)) AS odd_id, round(min(s), 6) AS sim FROM (
  SELECT unit.label, vec_id, list_cosine_similarity(u, mv) AS s FROM unit JOIN mean USING (label))
GROUP BY label""")
def q_odd_one_out(spark, sf_dir):
    """Per label, the vector farthest from the mean of the label's unit vectors."""
    unit = V.l2_normalize(emb(spark, sf_dir), "vec", "u")
    mean = V.mean_vector(unit, ["label"], "u", out_col="mv")
    j = unit.join(mean, "label").withColumn("s", V.cosine("u", "mv"))
    return j.groupBy("label").agg(F.min_by("id", F.struct("s", "id")).alias("odd_id"),
                                  F.round(F.min("s"), 6).alias("sim"))


@query("vec_analogy", sql=f"""WITH {ANCHORS_SQL},
unit AS (SELECT label, qid, list_transform(CAST(qvec AS DOUBLE[]),
               lambda x: x / sqrt(list_sum(list_transform(CAST(qvec AS DOUBLE[]), lambda y: y * y)))) AS u FROM av),
q AS (SELECT p1.label, p1.qid AS i1, p2.qid AS i2, n1.qid AS i3,
             list_transform(generate_series(1, len(p1.u)), lambda i: (p1.u[i] + p2.u[i] - n1.u[i]) / 3) AS t
      FROM unit p1 JOIN unit p2 ON p2.label = (p1.label + 1) % 10 JOIN unit n1 ON n1.label = (p1.label + 2) % 10)
SELECT label, rank, id, round(sim, 6) AS sim FROM (
  SELECT q.label, e.vec_id AS id, {COS.format(a='e.embedding', b='q.t')} AS sim,
         row_number() OVER (PARTITION BY q.label ORDER BY {COS.format(a='e.embedding', b='q.t')} DESC, e.vec_id) AS rank
  FROM q JOIN embeddings e ON e.vec_id NOT IN (q.i1, q.i2, q.i3))
WHERE rank <= 3""")
def q_analogy(spark, sf_dir):
    """Top 3 nearest to mean(unit(a_L), unit(a_L+1), -unit(a_L+2)) per label,
    the three inputs excluded (a_L = anchor of label L)."""
    a = V.l2_normalize(anchors(spark, sf_dir), "qvec", "u").select("label", "qid", "u")
    p2 = a.select(F.col("label").alias("l2"), F.col("qid").alias("i2"), F.col("u").alias("u2"))
    n1 = a.select(F.col("label").alias("l3"), F.col("qid").alias("i3"), F.col("u").alias("u3"))
    q = (a.join(p2, F.col("l2") == F.pmod(F.col("label") + 1, F.lit(10)))
         .join(n1, F.col("l3") == F.pmod(F.col("label") + 2, F.lit(10))))
    q = q.select(F.col("label").alias("qid"), F.array("qid", "i2", "i3").alias("inputs"),
                 F.zip_with(F.zip_with("u", "u2", lambda x, y: x + y), "u3", lambda x, y: (x - y) / 3).alias("qvec"))
    sc = V.rank_against(q.select("qid", "qvec"), emb(spark, sf_dir), exclude_self=False)
    sc = sc.join(q.select("qid", "inputs"), "qid").where(~F.array_contains("inputs", F.col("id")))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    top = sc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    return top.select(F.col("qid").cast("int").alias("label"), F.col("rank").cast("bigint"), "id",
                      F.round("sim", 6).alias("sim"))


@query("vec_l1_normalise", sql="""
SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS dim,
       round(CASE WHEN s = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) / s END, 6) AS value
FROM (SELECT vec_id, embedding, list_sum(CAST(embedding AS DOUBLE[])) AS s,
             unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""")
def q_l1(spark, sf_dir):
    n = V.l1_normalize(emb(spark, sf_dir), "vec", "n")
    return n.select("id", F.posexplode("n").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("vec_static_lookup", sql="""
SELECT e.vec_id AS id, e.label, i AS dim, round(CAST(e.embedding[i + 1] AS DOUBLE), 6) AS value
FROM (SELECT *, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i FROM embeddings) e WHERE e.vec_id IN (SELECT doc_id FROM labels)""")
def q_static_lookup(spark, sf_dir):
    """Vectors of a listed id set (the labelled documents): semi join."""
    ids = S.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    e = emb(spark, sf_dir).join(ids, "id", "left_semi")
    return e.select("id", "label", F.posexplode(V.to_double("vec")).alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("agg_mean_pool", sql="""
SELECT label, CAST(i - 1 AS INTEGER) AS dim,
       round(sum(CAST(embedding[i] AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS value
FROM (SELECT label, embedding, CASE WHEN vec_id % 4 <> 0 THEN 1.0 ELSE 0.0 END AS m,
             unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
GROUP BY label, i""")
def q_mean_pool(spark, sf_dir):
    """Masked mean of vectors per group (mask drops ids divisible by 4)."""
    e = emb(spark, sf_dir)
    m = V.mean_vector(e, ["label"], "vec", F.when(F.pmod("id", F.lit(4)) != 0, 1.0).otherwise(0.0))
    return m.select("label", F.posexplode("mean").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("agg_positive_mean", sql=f"""WITH {ANCHORS_SQL}
SELECT e.label AS anchor_label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(e.embedding[i] AS DOUBLE)), 6) AS value
FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) e
JOIN anchors a ON a.label = e.label AND e.vec_id <> a.qid
GROUP BY e.label, i""")
def q_positive_mean(spark, sf_dir):
    """Positives (same label, not the anchor) represented by their mean per anchor."""
    e = emb(spark, sf_dir)
    a = e.groupBy("label").agg(F.min("id").alias("qid"))
    pos = e.join(a, "label").where(F.col("id") != F.col("qid"))
    m = V.mean_vector(pos, ["label"], "vec")
    return m.select(F.col("label").alias("anchor_label"), F.posexplode("mean").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("agg_centroid_sphereize", sql="""
WITH c AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m
           FROM (SELECT embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY i),
x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) - c.m AS v
      FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) JOIN c USING (i))
SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM x""")
def q_sphereize(spark, sf_dir):
    """Subtract the corpus centroid, then L2-normalise (the centroid is one
    vector of d doubles; it is joined back by dimension)."""
    s = V.sphereize(emb(spark, sf_dir), "vec")
    return s.select("id", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))
