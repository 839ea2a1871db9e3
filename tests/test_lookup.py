"""Token lookup by parts of documents: rows, plan and accuracies."""

import re

from pyspark.sql import functions as F

from textloom.operators import vectors as VX
from textloom.operators import vocab as V


def _docs(spark):
    rows = [(1, ["a", "b", "a", "zz"]), (2, []), (3, None), (4, ["b", None]), (5, ["a", "c"]), (5, ["c"]), (None, ["a"]), (None, ["b"])]
    rows += [(100 + i, ["a", f"w{i % 7}"] * (i % 5)) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_lookup_takes_rows_of_a_document_together(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")       # documents cross batches
    try:
        table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, id int")
        got = {r["doc_id"]: r["v"] for r in V.lookup(_docs(spark), table, "id", out_col="v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1] == [1, 2, 1, None] and got[4] == [2, None] and got[None] in ([1, 2], [2, 1])
    assert got[5][:2] in ([1, 3], [3, 1]) and len(got[5]) == 3
    assert 2 not in got and 3 not in got
    assert got[101] == [1, None] and len(got) == 5 - 1 + 240


def test_encode_keeps_every_row(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 1), ("b", 2), ("<unk>", 3)], "word string, id int")
    d = _docs(spark).where("doc_id is null or doc_id < 100")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in V.encode(d, vocab).collect())
    assert got == [(0, []), (0, []), (1, [1, 2, 1, 3]), (2, []), (3, []), (4, [2, 3])] + 2 * [got[-1]]
    assert len(got[-1][1]) == 3


def test_tokens_move_inside_their_document(spark):
    table = spark.createDataFrame([("a", 1)], "word string, id int")
    plan = V.lookup(_docs(spark), table, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
    assert len(re.findall(r"\bexplode\(", plan)) == 1 and "array_distinct" in plan


def test_accuracies_are_counted_in_the_row(spark):
    d = spark.createDataFrame([([1, 2, 2, None], [1, 2, 9, 9]), ([-100, 5], [0, 5]), ([], []), (None, None)],
                              "l array<int>, p array<int>")
    m = VX.mlm_accuracy(d, "l", "p").first()
    assert (m["n_selected"], m["accuracy"]) == (4, 0.75)
    c = VX.clm_accuracy(d, "l", "l").first()
    assert (c["n"], c["accuracy"]) == (4, round(1 / 3, 6))
    plan = VX.clm_accuracy(d, "l", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    none = VX.mlm_accuracy(d.limit(0), "l", "p").first()
    assert none["n_selected"] == 0 and none["accuracy"] is None
