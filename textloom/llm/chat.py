"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of both conversations is rendered once as the
prompt; what follows on each side is that side's completion. A completion carries the
spans that are trained on: the contents of its assistant turns. All else, the prompt
included, is masked.

Defined cases: turns are ordered by ``turn`` and compared by place, so gaps don't
matter; null texts are empty, null roles are ``unknown``; repeated rows count once, and
several rows with one turn number follow each other by role and text; a side without
turns has an empty completion; equal conversations are all prompt; rows without
pair_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(turns: DataFrame) -> DataFrame:
    rows = (turns.where(F.col("pair_id").isNotNull())
            .select("pair_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")).distinct())
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id").orderBy("turn", "role", "text")))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans; inputs
    have pair_id, turn, role and text. Spans are ``start:end`` in code points of the
    completion, comma-joined."""
    a = _placed(chosen).select("pair_id", "pos", F.struct("role", "text").alias("a"))
    b = _placed(rejected).select("pair_id", "pos", F.struct("role", "text").alias("b"))
    both = a.join(b, ["pair_id", "pos"], "full")
    upto = Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("common", F.min(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("int")).over(upto))
    head = lambda s: F.concat(F.lit("<|"), F.col(s)["role"], F.lit("|>\n"))
    shown = both
    for s in ("a", "b"):
        shown = shown.withColumn(f"{s}_line", F.concat(head(s), F.col(s)["text"], F.lit("<|end|>\n")))
    for s in ("a", "b"):
        tail = F.when(F.col("common") == 0, F.length(f"{s}_line")).otherwise(0)
        end = F.coalesce(F.sum(tail).over(upto), F.lit(0))
        start = end - F.length(f"{s}_line") + F.length(head(s))
        shown = shown.withColumn(f"{s}_span", F.when(
            (F.col("common") == 0) & (F.col(s)["role"] == "assistant"),
            F.concat_ws(":", start.cast("string"), (start + F.length(F.col(s)["text"])).cast("string"))))

    def joined(value, when, by: str = ""):
        rows = F.sort_array(F.collect_list(F.when(when & value.isNotNull(), F.struct("pos", value.alias("v")))))
        return F.array_join(F.transform(rows, lambda x: x["v"]), by)
    in_prompt, in_tail = F.col("common") == 1, F.col("common") == 0
    return shown.groupBy("pair_id").agg(
        F.sum("common").cast("long").alias("n_common"), joined(F.col("a_line"), in_prompt).alias("prompt"),
        joined(F.col("a_line"), in_tail).alias("chosen"), joined(F.col("a_span"), in_tail, ",").alias("chosen_spans"),
        joined(F.col("b_line"), in_tail).alias("rejected"), joined(F.col("b_span"), in_tail, ",").alias("rejected_spans"))
