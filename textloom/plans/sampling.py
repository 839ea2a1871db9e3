"""Queries for sampling, splitting and balancing (inventory 2.8) and the
shuffle / dedup / union rows of 2.5."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.lexicon import LABEL_NAMES
from textloom.operators import sampling as SM
from textloom.plans import sqlfrag as Q
from textloom.plans.registry import query
from textloom.plans.vocab import CT_SQL
from textloom.sources import tables as S

NOTES = S.with_sql(S.NOTES_SQL)


def labelled(spark, sf_dir):
    """``(id, label)`` with label = report type (15 classes)."""
    return S.notes(spark, sf_dir).select("id", F.col("type").alias("label"))


LABELLED_SQL = NOTES_LABELLED = S.with_sql(S.NOTES_SQL, "labelled AS (SELECT id, type AS label FROM notes)")


def _rank_sql(seed, partition="") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({part}ORDER BY {Q.hkey(seed, 'id')}, id)"


@query("smp_holdout_split", sql=NOTES + f"""
SELECT id, CASE WHEN r <= n_h THEN 'heldout' WHEN r <= n_h + ceil((n - n_h) * 0.1) THEN 'lm_test'
                ELSE 'lm_train' END AS split
FROM (SELECT id, {_rank_sql(42)} AS r, count(*) OVER () AS n, ceil(count(*) OVER () * 0.1) AS n_h FROM notes)""")
def q_holdout(spark, sf_dir):
    return SM.holdout_split(S.notes(spark, sf_dir).select("id"), "id", 0.10, seed=42)


@query("smp_three_way", sql=NOTES + f"""
SELECT id, task, CASE WHEN r <= n_v THEN 'valid' WHEN r <= n_s THEN 'train' ELSE 'test' END AS split
FROM (SELECT id, task, {_rank_sql(41, 'task')} AS r,
             round_even(count(*) OVER (PARTITION BY task) * 0.8, 0) AS n_s,
             round_even(round_even(count(*) OVER (PARTITION BY task) * 0.8, 0) * 0.25, 0) AS n_v
      FROM (SELECT id, 'severity' AS task FROM notes WHERE severity IS NOT NULL
            UNION ALL SELECT id, 'type' AS task FROM notes))""")
def q_three_way(spark, sf_dir):
    from textloom.operators.datasets import multi_task
    long = multi_task(S.notes(spark, sf_dir), tasks=("severity", "type"), text_col="IN07")
    return SM.three_way_split(long.select("id", "task"), "id", group_cols=["task"], seed=41)


@query("smp_fewshot_total", sql=LABELLED_SQL + f"""
SELECT id, label FROM (SELECT *, {_rank_sql(42)} AS r FROM labelled) WHERE r <= 100""")
def q_fewshot_total(spark, sf_dir):
    return SM.fewshot(labelled(spark, sf_dir), num_examples_total=100)


@query("smp_fewshot_per_label", sql=LABELLED_SQL + f"""
SELECT id, label FROM (SELECT *, {_rank_sql(42, 'label')} AS r FROM labelled) WHERE r <= 20""")
def q_fewshot_per_label(spark, sf_dir):
    return SM.fewshot(labelled(spark, sf_dir), num_examples_per_label=20)


@query("smp_fewshot_dev", sql=LABELLED_SQL + f"""
SELECT id, label, CASE WHEN r <= 20 THEN 'train' ELSE 'dev' END AS part
FROM (SELECT *, {_rank_sql(42, 'label')} AS r FROM labelled) WHERE r <= 30""")
def q_fewshot_dev(spark, sf_dir):
    train, dev = SM.fewshot(labelled(spark, sf_dir), num_examples_per_label=20,
                            also_sample_dev=True, dev_per_label=10)
    return train.withColumn("part", F.lit("train")).unionByName(dev.withColumn("part", F.lit("dev")))


@query("smp_balance_min", sql=LABELLED_SQL + f"""
SELECT id, label FROM (SELECT *, {_rank_sql(42, 'label')} AS r FROM labelled)
WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labelled GROUP BY label))""")
def q_balance_min(spark, sf_dir):
    return SM.balance_min(labelled(spark, sf_dir))


def _names_sql() -> str:
    names = LABEL_NAMES["instance_severity"]
    rows = ", ".join(f"({i}, {Q.lit(n)})" for i, n in enumerate(names))
    return f"names AS (SELECT * FROM (VALUES {rows}) t(label, name))"


@query("smp_show_random", sql=S.with_sql(S.PREDS_SQL, _names_sql()) + f"""
SELECT p.id, p.label, n.name FROM (SELECT *, {_rank_sql(42)} AS r FROM preds) p
LEFT JOIN names n ON p.label = n.label WHERE r <= 10""")
def q_show_random(spark, sf_dir):
    """k random rows with class names (binary severity names)."""
    from textloom.operators.joins import label_names
    p = S.preds(spark, sf_dir).select("id", "label")
    return label_names(SM.fewshot(p, num_examples_total=10), spark, "instance_severity")


@query("smp_vocab_examples", sql=f"""WITH {CT_SQL}
SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(tokens) AS word FROM ct)
WHERE regexp_matches(word, '\\p{{Nd}}') AND CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 11 = 1 GROUP BY word""")
def q_vocab_examples(spark, sf_dir):
    """Vocabulary tokens holding a digit, about one in eleven of them (hash-picked)."""
    from textloom.operators import counting
    from textloom.plans.strings import clean_tokens
    v = counting.word_counts(clean_tokens(spark, sf_dir))
    return SM.vocab_examples(v.where(F.col("word").rlike(r"\p{Nd}")), "word", modulus=11)


@query("shuffle_rows", sql=NOTES + f"SELECT id, {_rank_sql(42)} AS shuffle_rank FROM notes")
def q_shuffle_rows(spark, sf_dir):
    return SM.shuffle_rows(S.notes(spark, sf_dir).select("id"), "id", 42)
