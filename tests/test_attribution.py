"""Attribution measures per text against the plain group-wide measures."""

from pyspark.sql import functions as F

from textloom.operators import attribution as A
from textloom.operators import metrics as M


def _tokens(spark):
    rows = [(c, p, float((c * 7 + p * p) % 5 - 2)) for c in range(6) for p in range(3 + 4 * c)] + [(9, p, 0.0) for p in range(4)]
    t = spark.createDataFrame(rows, "case_id long, pos int, weight double")
    tot = t.groupBy("case_id").agg(F.sum("weight").alias("S"), F.count(F.lit(1)).alias("n"))
    return A.leave_one_out(t.join(tot, "case_id"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rank_agreement_is_the_spearman_of_each_text(spark):
    r = _tokens(spark)
    found = A.rank_agreement(r)
    plain = {x["case_id"]: x["spearman"] for x in M.pearson_spearman(r, "weight", "loo", ["case_id"]).collect()}
    got = {x["case_id"]: x["spearman"] for x in found.collect()}
    assert got.keys() == plain.keys() and got[9] is None
    assert all(got[c] == plain[c] for c in range(6))
    # one text is one group: no histogram of buckets, no join of ranks back to tokens
    assert _plan(found).count("Join") == _plan(r).count("Join")


def test_rationale_area_is_that_of_the_curve(spark):
    r = _tokens(spark)
    y = r.withColumn("y", (F.col("weight") > 0).cast("int"))
    found = A.rationale_pr_auc(r)
    plain = {x["case_id"]: x["pr_auc"] for x in M.pr_auc(M.roc_points(y, ["case_id"], "y", "loo"), ["case_id"]).collect()}
    got = {x["case_id"]: x["pr_auc"] for x in found.collect()}
    assert got == plain and got[9] is None
    assert _plan(found).count("Join") == _plan(r).count("Join")
