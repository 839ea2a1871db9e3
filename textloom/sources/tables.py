"""Readers for the supplied parquet tables and the derived views every
operator test uses. Each derived view is defined twice, once as a Spark
DataFrame and once as a SQL CTE for the DuckDB oracle, with identical
semantics (``pmod`` in Spark is ``%`` in DuckDB: all operands are >= 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.common import evaluate_once

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


#: Row key of the text tables.
TEXT_KEYS: dict[str, str] = {"documents": "doc_id", "pages": "page_id",
                             "conversations": "conv_id", "benchmark": "item_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one supplied table; Catalyst prunes columns and pushes filters to the scan.

    The session setting ``textloom.scan.partitions`` spreads text tables by their
    key over that many partitions, for files of one row group that Spark can't
    split (a local session sets it). It is unset on a cluster."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("textloom.scan.partitions", "")
    if n and name in TEXT_KEYS:
        return df.repartition(int(n), TEXT_KEYS[name])
    return df


def documents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) partitioned by doc_id: texts move once, and group-bys and windows over a
    document's tokens find them in place."""
    return read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


# --- notes: the raw report table stand-in ----------------------------------

def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("IN07"),
        F.when(F.pmod("doc_id", F.lit(17)) == 0, F.lit(None).cast("bigint"))
        .otherwise(1 + F.pmod("doc_id", F.lit(6))).alias("severity"),
        (1 + F.pmod("doc_id", F.lit(15))).alias("type"),
        F.col("lang").alias("location"),
    )


NOTES_SQL = """notes AS (
  SELECT doc_id AS id, text AS IN07,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1 + doc_id % 6 END AS severity,
         1 + doc_id % 15 AS type, lang AS location
  FROM documents)"""


def notes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report layout with the dotted code columns."""
    n = notes(spark, sf_dir)
    return n.select("id", "IN07", F.col("severity").alias("Key.PD09"),
                    F.col("type").alias("Key.IN05"), F.col("location").alias("Key.RP02"))


NOTES_RAW_SQL = NOTES_SQL + """,
notes_raw AS (
  SELECT id, IN07, severity AS "Key.PD09", type AS "Key.IN05", location AS "Key.RP02" FROM notes)"""


DIRTY_PREFIX_PARTS = ("[ref ", "] Date/Time w/ pt_1  - \"x\" \\s ")


def notes_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``notes`` with a prefix that makes every cleaning rule fire."""
    n = notes(spark, sf_dir)
    return n.withColumn("IN07", F.concat(F.lit(DIRTY_PREFIX_PARTS[0]), F.col("id").cast("string"),
                                         F.lit(DIRTY_PREFIX_PARTS[1]), F.col("IN07")))


NOTES_DIRTY_SQL = NOTES_SQL + """,
notes_dirty AS (
  SELECT id, '[ref ' || CAST(id AS VARCHAR) || '] Date/Time w/ pt_1  - "x" \\s ' || IN07 AS IN07,
         severity, type, location
  FROM notes)"""


# --- preds: a deterministic pseudo-prediction table ------------------------

def _score(doc_id: Column) -> Column:
    return F.pmod(doc_id * 7919 + 13, F.lit(100)).cast("double") / 100.0


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels")
    score = _score(F.col("doc_id"))
    return lab.select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("label"),
        score.alias("score"),
        (score > 0.5).cast("int").alias("prediction"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "test")
        .when(F.pmod("doc_id", F.lit(5)) == 1, "valid").otherwise("train").alias("split"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "a").otherwise("b").alias("model"),
    )


PREDS_SQL = """preds AS (
  SELECT doc_id AS id, quality AS label,
         CAST((doc_id * 7919 + 13) % 100 AS DOUBLE) / 100.0 AS score,
         CAST(CAST((doc_id * 7919 + 13) % 100 AS DOUBLE) / 100.0 > 0.5 AS INTEGER) AS prediction,
         CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'valid' ELSE 'train' END AS split,
         CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model
  FROM labels)"""


def preds_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class predictions from ``embeddings``: probs = softmax of the cosines of the
    whole vector to each label's centroid, in label order; prediction = first arg-max.
    The centroids (one vector per label) are one broadcast row."""
    from textloom.operators import vectors as V
    e = read(spark, sf_dir, "embeddings")
    mean = V.mean_vector(e, ["label"], "embedding").where("label is not null")
    cents = mean.agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("cs")).withColumn("_one", F.lit(1))
    j = e.withColumn("_one", F.lit(1)).join(F.broadcast(cents), "_one")
    logits = F.transform("cs", lambda c: V.cosine(F.col("embedding"), c["mean"]))
    j = evaluate_once(j.select("vec_id", "label", logits.alias("lg")), "lg")
    ex = F.transform("lg", lambda x: F.exp(x - F.array_max("lg")))
    j = evaluate_once(j.withColumn("ex", ex), "ex")
    tot = F.aggregate("ex", F.lit(0.0), lambda a, x: a + x)
    j = evaluate_once(j.withColumn("tot", tot), "tot")
    return j.select(
        F.col("vec_id").alias("id"), F.col("label"), F.transform("ex", lambda x: x / F.col("tot")).alias("probs"),
    ).withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


PREDS_MULTI_SQL = """centroids AS (
  SELECT label, list(m ORDER BY i) AS c FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
    FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL)
    GROUP BY label, i) GROUP BY label),
preds_multi AS (
  SELECT id, label, probs,
         CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS prediction
  FROM (
    SELECT id, label, list_transform(ex, lambda x: x / list_sum(ex)) AS probs
    FROM (
      SELECT id, label, list_transform(lg, lambda x: exp(x - list_max(lg))) AS ex
      FROM (SELECT e.vec_id AS id, e.label, list(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), k.c) ORDER BY k.label) AS lg
            FROM embeddings e CROSS JOIN centroids k GROUP BY e.vec_id, e.label))))"""


def with_sql(*ctes: str) -> str:
    """Join CTE definitions into one ``WITH`` prefix (duplicates removed, order kept)."""
    seen: list[str] = []
    for block in ctes:
        for part in _split_ctes(block):
            if part not in seen:
                seen.append(part)
    return "WITH " + ",\n".join(seen) + "\n"


def _split_ctes(block: str) -> list[str]:
    # CTE blocks are written as "name AS (...)" joined by ",\n" at depth 0.
    parts, depth, cur = [], 0, []
    i = 0
    while i < len(block):
        ch = block[i]
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append("".join(cur).strip())
            cur = []
        else:
            cur.append(ch)
        i += 1
    if "".join(cur).strip():
        parts.append("".join(cur).strip())
    return parts
