"""Term counts, topic words, sentences and phrases move only what they must."""

import re

from pyspark.sql import functions as F

from textloom.operators import topics as TP
from textloom.operators import vectors as VX
from textloom.operators import vocab as V
from textloom.operators.sentences import split_sentences


def _plan(df, spark):
    """The physical plan for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().sparkPlan().toString(), df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _docs(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["b"]), (3, []), (None, ["a"])] + [(9 + i, ["a", "b", f"w{i}"]) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_terms_are_counted_where_their_document_is(spark):
    d = _docs(spark)
    w = VX.nbow(V.term_frequencies(d.repartition("doc_id"), "doc_id", "tokens"), "doc_id")
    _, plan = _plan(w, spark)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    got = {(r["doc_id"], r["term"]): (r["tf"], round(r["weight"], 6)) for r in w.collect()}
    assert got[(2, "b")][0] == 2 and all(k[0] is not None for k in got)
    for doc in (1, 2, 9):
        assert abs(sum(x[1] for k, x in got.items() if k[0] == doc) - 1) < 1e-5


def test_only_topic_words_move(spark):
    d = _docs(spark).where("doc_id is not null and doc_id <> 2")
    words = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a"), ("u", "w3")], "topic string, word string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = TP.npmi(d.withColumn("topic", F.lit("x")), words, n_docs=d.agg(F.count(F.lit(1)).alias("_nd")))
    got = {r["topic"]: (r["npmi"], r["n_pairs"]) for r in plain.collect()}
    same = {r["topic"]: (r["npmi"], r["n_pairs"]) for r in TP.npmi(d, words).collect()}
    assert got == same and got["t"][1] == 1 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    # the texts are not part of the last plan: their topic words are kept
    assert "array_distinct" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_a_paragraph_stay_together(spark):
    p = spark.createDataFrame([(1, 0, "One! Two! Three?"), (1, 1, ""), (2, 0, None), (None, 0, "Aye! Bee!")],
                              "doc_id long, para int, ptext string")
    s = split_sentences(p, ["doc_id", "para"], "ptext")
    _, plan = _plan(s, spark)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    got = sorted((r["doc_id"] or 0, r["sent"], r["sentence"]) for r in s.collect())
    assert got == [(0, 0, "Aye!"), (0, 1, "Bee!"), (1, 0, "One!"), (1, 1, "Two!"), (1, 2, "Three?")]


def test_few_phrases_go_to_the_pairs(spark):
    d = _docs(spark).where("doc_id >= 9")
    m = V.merge_phrases(d, spark.createDataFrame([("a", "b")], "a string, b string"))
    plan, _ = _plan(m, spark)
    assert "BroadcastHashJoin" in plan
    assert all(r["merged"][0] == "a_b" and len(r["merged"]) == 2 for r in m.collect())


def test_phrase_counts_are_kept_a_row_a_word(spark, monkeypatch):
    """Every pair is counted, but only what can be a phrase is stored."""
    kept = []
    monkeypatch.setattr(V, "materialize", lambda df, f=V.materialize: kept.append(f(df)) or kept[-1])
    rows = [(i, ["a", "b", f"w{i}", None, "a", f"x{i % 3}"]) for i in range(30)] + [(31, []), (32, None), (33, ["a"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    one, two = {}, {}
    for _, t in rows:
        for i, x in enumerate(t or []):
            one[x] = one.get(x, 0) + 1
            if i + 1 < len(t) and t[i + 1] is not None:
                two[x, t[i + 1]] = two.get((x, t[i + 1]), 0) + 1
    for least, threshold in ((5, 0.0), (5, 0.5), (2, -10.0)):
        got = {(r.a, r.b): (r.n_ab, r.score) for r in V.phrase_scores(docs, min_count=least, threshold=threshold).collect()}
        size = len(one) + len(two)
        want = {(a, b): (n, (n - least) / (one[a] * one[b]) * size) for (a, b), n in two.items() if a is not None}
        want = {k: x for k, x in want.items() if x[1] > threshold}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
        assert kept[-1].count() == len(one)


def test_hashes_of_more_phrases_go_to_the_pairs(spark, monkeypatch):
    d = spark.createDataFrame([(i, ["a", "b", "c", "a", None, "b", f"w{i}"]) for i in range(9)] + [(20, None)], "doc_id long, tokens array<string>")
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "w3"), ("x", None)], "a string, b string")
    few = sorted((r.doc_id, r.merged) for r in V.merge_phrases(d, p).where("doc_id < 20").collect())
    monkeypatch.setattr(V, "SMALL_ROWS", 2)
    m = V.merge_phrases(d, p)
    plan, _ = _plan(m, spark)
    assert "xxhash64" in plan and "BroadcastHashJoin" in plan
    assert sorted((r.doc_id, r.merged) for r in m.where("doc_id < 20").collect()) == few and few[3][1] == ["a_b", "c_a", None, "b_w3"]
