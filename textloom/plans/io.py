"""Queries for sources and sinks (inventory 2.1): each writes data derived
from the supplied tables to a scratch folder in the shared checkpoint
directory and reads it back through the matching reader."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from textloom.functions import text as T
from textloom.operators import sampling as SM
from textloom.operators.common import evaluate_once
from textloom.operators import vocab as V
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.strings import clean_tokens
from textloom.plans.vocab import CT_SQL, ENC_SQL, POS_SQL, VOCAB_SQL
from textloom.sources import io as IO
from textloom.sources import tables as S


@query("src_csv", sql=S.with_sql(S.NOTES_RAW_SQL) + """
SELECT id, IN07, CAST("Key.PD09" AS DOUBLE) AS "Key.PD09", CAST("Key.IN05" AS DOUBLE) AS "Key.IN05", "Key.RP02" FROM notes_raw""")
def q_src_csv(spark, sf_dir):
    """Raw reports round-tripped through a headered, quoted, multi-line CSV."""
    path = IO.scratch_path(spark, "reports-csv")
    IO.write_csv(S.notes_raw(spark, sf_dir), path)
    return IO.read_csv(spark, path)


HEADERLESS_SQL = f"""
SELECT label, CAST(len(parts) AS INTEGER) AS n_parts, array_to_string(parts, '|') AS parts FROM (
  SELECT CAST(doc_id % 4 + 1 AS INTEGER) AS label,
         list_filter([l[1], l[2], array_to_string(l[3:], chr(10))], lambda x: x IS NOT NULL AND x <> '') AS parts
  FROM (SELECT doc_id, {Q.split_lines('text')} AS l FROM documents))"""


@query("src_csv_headerless", sql=HEADERLESS_SQL)
def q_src_csv_headerless(spark, sf_dir):
    """``label, part1, part2, part3``: first line, second line and all the rest."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", T.split_lines("text").alias("l"))
    rest = F.array_join(F.slice("l", 3, F.size("l")), "\n")
    cols = [F.try_element_at("l", F.lit(i)).alias(f"p{i}") for i in (1, 2)]
    src = d.select((F.pmod("doc_id", F.lit(4)) + 1).cast("int").alias("label"), *cols, rest.alias("p3"))
    path = IO.scratch_path(spark, "headerless-csv")
    (src.write.mode("overwrite").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    back = IO.read_csv_headerless(spark, path, 4)
    return back.select("label", F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("parts"))


@query("src_text_lines", sql=S.with_sql(S.NOTES_DIRTY_SQL) + f"""
SELECT value FROM (SELECT {Q.clean_note('IN07')} AS value FROM notes_dirty) WHERE value IS NOT NULL""")
def q_src_text_lines(spark, sf_dir):
    """Cleaned reports written one per line, read back as a corpus."""
    path = IO.scratch_path(spark, "corpus")
    n = evaluate_once(S.notes_dirty(spark, sf_dir).select(T.clean_note("IN07").alias("text")), "text").where(
        F.col("text").isNotNull())
    IO.write_text_corpus(n, "text", path)
    return IO.read_text_lines(spark, path)


@query("src_word_vectors", sql="""
SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""")
def q_src_word_vectors(spark, sf_dir):
    """Vectors written as ``word v1 .. vd`` text lines and parsed back."""
    e = S.read(spark, sf_dir, "embeddings").withColumn("word", F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    path = IO.scratch_path(spark, "vectors")
    IO.write_word_vectors(e, "word", "embedding", path)
    v = IO.read_word_vectors(spark, path)
    return v.select("word", F.size("vector").alias("dim"),
                    F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("sink_text_corpus", sql=S.with_sql(S.NOTES_DIRTY_SQL).rstrip() + f""",
n AS (SELECT id, {Q.clean_note('IN07')} AS text FROM notes_dirty),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS r,
             count(*) OVER () AS n, ceil(count(*) OVER () * 0.1) AS n_h FROM n WHERE text IS NOT NULL)
SELECT CASE WHEN r <= n_h THEN 'heldout' WHEN r <= n_h + ceil((n - n_h) * 0.1) THEN 'lm_test' ELSE 'lm_train' END AS split,
       text AS value FROM r""")
def q_sink_text_corpus(spark, sf_dir):
    """Train / held-out corpora written as text, one cleaned report per line, and read back."""
    n = evaluate_once(S.notes_dirty(spark, sf_dir).select("id", T.clean_note("IN07").alias("text")), "text").where(
        F.col("text").isNotNull())
    s = SM.holdout_split(n, "id", 0.10)
    path = IO.scratch_path(spark, "corpus-split")
    s.select("split", F.col("text").alias("value")).write.mode("overwrite").partitionBy("split").text(path)
    return spark.read.text(path).select("split", "value")


@query("sink_split_csv", sql=S.with_sql(S.NOTES_SQL) + """
SELECT id, text, CAST(label AS INTEGER) AS label, task, split FROM (
  SELECT id, text, label, task, CASE WHEN r <= n_v THEN 'valid' WHEN r <= n_s THEN 'train' ELSE 'test' END AS split
  FROM (SELECT id, text, label, task, row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', '41', CAST(id AS VARCHAR))), id) AS r,
               round_even(count(*) OVER (PARTITION BY task) * 0.8, 0) AS n_s,
               round_even(round_even(count(*) OVER (PARTITION BY task) * 0.8, 0) * 0.25, 0) AS n_v
        FROM (SELECT id, IN07 AS text, severity AS label, 'severity' AS task FROM notes WHERE severity IS NOT NULL
              UNION ALL SELECT id, IN07, type, 'type' AS task FROM notes)))""")
def q_sink_split_csv(spark, sf_dir):
    """Train/valid/test per task written as CSV folders partitioned by (task, split)."""
    from textloom.operators.datasets import multi_task
    long = multi_task(S.notes(spark, sf_dir), tasks=("severity", "type"), text_col="IN07")
    s = SM.three_way_split(long, "id", group_cols=["task"], seed=41)
    path = IO.scratch_path(spark, "splits")
    IO.write_partitioned(s.select("id", "text", "label", "task", "split"), path, ["task", "split"], fmt="csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(
        TY.StructType([TY.StructField("id", TY.LongType()), TY.StructField("text", TY.StringType()),
                       TY.StructField("label", TY.IntegerType()), TY.StructField("task", TY.StringType()),
                       TY.StructField("split", TY.StringType())])).csv(path)
    return back.select("id", "text", "label", "task", "split")


def _encoded(spark, sf_dir):
    ct = clean_tokens(spark, sf_dir)
    vocab = V.vocabulary(ct, min_word_count=5)
    return vocab, V.pad_encoded(V.encode(ct, vocab), "ids", 50)


VOC = f"WITH {CT_SQL}, {POS_SQL}, {VOCAB_SQL}"


@query("sink_encoded", sql=f"""{VOC}, {ENC_SQL}
SELECT doc_id, CAST(1 + doc_id % 15 AS BIGINT) AS label, CAST(least(len(ids), 50) AS INTEGER) AS length,
       array_to_string(list_concat(ids[1:50], list_transform(generate_series(1, 50 - least(len(ids), 50)), lambda x: 0)), ' ') AS padded
FROM enc""")
def q_sink_encoded(spark, sf_dir):
    """Encoded, padded id arrays with true lengths and labels persisted as parquet."""
    _, enc = _encoded(spark, sf_dir)
    path = IO.scratch_path(spark, "encoded")
    label = (1 + F.pmod("doc_id", F.lit(15))).cast("bigint").alias("label")
    IO.write_parquet(enc.select("doc_id", label, "length", "padded"), path)
    return spark.read.parquet(path).select("doc_id", "label", "length", F.array_join("padded", " ").alias("padded"))


def _vocab(spark, sf_dir):
    return V.vocabulary(clean_tokens(spark, sf_dir), min_word_count=5)


@query("sink_word_map", sql=f"{VOC} SELECT * FROM vocab")
def q_sink_word_map(spark, sf_dir):
    """Vocabulary (word, id, cnt) persisted and re-read for encoding."""
    path = IO.scratch_path(spark, "word-map")
    IO.write_parquet(_vocab(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("sink_vocab_dump", sql=f"{VOC} SELECT word AS value FROM vocab")
def q_sink_vocab_dump(spark, sf_dir):
    """Vocabulary dumped to text, one token per line."""
    path = IO.scratch_path(spark, "vocab-txt")
    _vocab(spark, sf_dir).select(F.col("word").alias("value")).write.mode("overwrite").text(path)
    return spark.read.text(path)


@query("sink_embeddings_jsonl", sql="""
SELECT vec_id AS doc_id, CAST(i AS INTEGER) AS dim, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings)""")
def q_sink_embeddings_jsonl(spark, sf_dir):
    """Document vectors written as JSON lines with an ``embeddings`` field."""
    e = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("embeddings"))
    path = IO.scratch_path(spark, "emb-jsonl")
    IO.write_json(e, path)
    back = spark.read.schema("doc_id long, embeddings array<float>").json(path)
    return back.select("doc_id", F.posexplode("embeddings").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6))


@query("sink_results_table", sql=S.with_sql(S.PREDS_SQL) + "SELECT * FROM preds")
def q_sink_results_table(spark, sf_dir):
    """A per-prediction results table persisted as parquet."""
    p = S.preds(spark, sf_dir)
    path = IO.scratch_path(spark, "results")
    IO.write_parquet(p, path)
    return spark.read.parquet(path)
