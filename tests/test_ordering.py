"""The distributed rank / prefix helpers equal a brute-force sort."""

import hashlib

from pyspark.sql import functions as F

from textloom.operators.ordering import hash_rank, hash_top_n, ordered_prefix, range_bucket


def _md5(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_hash_rank_matches_python(spark):
    # one hot group holding a third of the rows
    rows = [(i, 0 if i % 3 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int")
    got = {r.id: r.hrank for r in hash_rank(df, "id", 42, group_cols=["g"]).collect()}
    for g in {g for _, g in rows}:
        ids = sorted((i for i, gg in rows if gg == g), key=lambda i: (_md5(42, i), i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_hash_top_n_window(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "id long")
    ids = sorted(range(500), key=lambda i: (_md5(7, i), i))
    got = sorted(r.id for r in hash_top_n(df, 40, "id", 7, offset=25).collect())
    assert got == sorted(ids[25:65])


def test_ordered_prefix_with_ties_and_descending(spark):
    vals = [(i, float(i % 11), i % 3) for i in range(400)]
    df = spark.createDataFrame(vals, "id long, s double, w int")
    out = ordered_prefix(df, ["s", "id"], {"w": F.col("w")}, n_buckets=8, descending=True).collect()
    order = sorted(vals, key=lambda r: (-r[1], r[0]))
    want_rank = {r[0]: k + 1 for k, r in enumerate(order)}
    before, acc = {}, 0
    for r in order:
        before[r[0]] = acc
        acc += r[2]
    for r in out:
        assert r["rank"] == want_rank[r.id]
        assert r["w_before"] == before[r.id]


def test_ordered_prefix_keeps_large_ids_apart(spark):
    """Ids above 2**53 differ only below the precision of a double."""
    base = 2 ** 55
    df = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(20_000)) + base).alias("id"))
    wrong = ordered_prefix(df, ["id"]).where(F.col("rank") != F.col("id") - base + 1)
    assert wrong.count() == 0


def test_ties_of_the_first_key_are_split(spark):
    df = spark.range(60_000).select(F.when(F.pmod("id", F.lit(10)) < 6, 1).otherwise(F.col("id")).alias("cnt"),
                                    F.md5(F.col("id").cast("string")).alias("word"))
    sizes = [r["count"] for r in range_bucket(df, F.struct("cnt", "word"), 32).groupBy("_b").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 2 * 60_000 / 32


def test_ordered_prefix_strings_and_groups(spark):
    rows = [(i, "hot" if i % 3 else "cold", f"k{i * 37 % 1000:04d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, name string")
    got = {r.id: r["rank"] for r in ordered_prefix(df, ["name"], group_cols=["g"], n_buckets=16).collect()}
    for g in ("hot", "cold"):
        want = [i for i, gg, n in sorted(rows, key=lambda r: r[2]) if gg == g]
        assert [got[i] for i in want] == list(range(1, len(want) + 1))


def test_merge_phrases_takes_every_second_of_a_run(spark):
    from textloom.operators import vocab as V
    rows = [(1, list("aaaab")), (2, list("xabab")), (3, []), (4, ["a"] * 50_001), (5, list("xyz"))]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    phrases = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "a string, b string")
    got = {r.doc_id: r.merged for r in V.merge_phrases(docs, phrases).collect()}
    assert got[1] == ["a_a", "a_a", "b"] and got[2] == ["x", "a_b", "a_b"] and got[3] == [] and got[5] == list("xyz")
    assert got[4] == ["a_a"] * 25_000 + ["a"]


def test_a_common_key_does_not_fill_the_sample(spark):
    """Half of all rows share one key, whatever its hash; the others still get many buckets."""
    for common in range(6):
        df = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(common)).otherwise(F.col("id")).alias("v"))
        rows = range_bucket(df, F.struct("v"), 8).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                                                    F.max("v").alias("hi")).orderBy("_b").collect()
        assert len(rows) >= 7 and all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
        assert max(r.n for r in rows if r.lo >= 2000) < 600
