"""Joins, search, packing, mixture, sharding, fixity and chat pairs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, chat, mixing, ngram_join, packing, queries, sharding, warc
from textloom.llm.graph import components

SF = "/root/testdata/sf0.001"


def frame(spark, rows, extra="label"):
    return spark.createDataFrame([(*r, "e") for r in rows], f"doc_id long, text string, {extra} string")


# --- components and the join ---------------------------------------------------

def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    up = list(range(400))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_one_partition_join_nothing(spark, monkeypatch):
    """Edges of one partition are contracted there; with more partitions the rounds agree."""
    from textloom.llm import graph
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, 1000 + i) for i in range(1, 150)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    want = {r.node: r.component for r in components(df).collect()}
    stars = graph._stars(df.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").coalesce(1), 10 ** 6)
    assert {r.u: r.v for r in stars.collect()} == {n: c for n, c in want.items() if n != c}
    rounds = []
    cut = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda d: rounds.append(1) or cut(d))
    assert {r.node: r.component for r in components(df).collect()} == want and len(rounds) == 2
    monkeypatch.setattr(graph, "ROWS", 40)
    assert {r.node: r.component for r in components(df).collect()} == want


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [] if d is None else [d]
    return sets, [find(i) for i in range(len(rows))], least


def near_copies():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(40)]
    for base in range(3):                                          # groups that drift apart step by step
        text = rng.choices(words, k=120)
        for _ in range(22):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
            if rng.random() < .3:
                rows.append((len(rows), " ".join(text).upper()))
    passage = " ".join(rng.choices(words, k=30))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choices(words, k=90))) for i in range(12)]
    short = " ".join(words[:10])
    rows += [(len(rows) + 20 + i, t) for i, t in enumerate([short, short + " x", short + " x y", "a b", "A  B", "a b c", None, "", " \n"])]
    return rows + [(3, "a b"), (None, "a b c"), (None, "only here in null"), rows[0], (7000, "word " * 50_000)]


@pytest.mark.parametrize("block", [1500, 6])
def test_join_equals_all_pairs(spark, block):
    rows = near_copies()
    sets, part, least = brute_components(rows)
    got = ngram_join.component_ids(ngram_join.near_duplicates(frame(spark, rows, "part"), block))
    want = [(d, len(s), min(least[p], default=None) if s else d) for (d, _), s, p in zip(rows, sets, part)]
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [1500, 6])
def test_join_counts_every_link(spark, block):
    """Whole links between rows, members of one part included."""
    rows = near_copies()
    sets, part, least = brute_components(rows)
    links = [sum(i != j and bool(s) and 100 * len(s & t) >= 85 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]
    got = ngram_join.component_ids(ngram_join.linked(frame(spark, rows, "links"), block)).collect()
    want = [(d, len(s), min(least[p], default=None) if s else d, n) for (d, _), s, p, n in zip(rows, sets, part, links)]
    assert sorted(((r.doc_id, r.n, r.component_id, r.links) for r in got), key=str) == sorted(want, key=str)
    assert max(links) > 5
    pairs = [(r.a, r.b) for r in ngram_join.class_links(frame(spark, rows, "links"), block).collect()]
    different = {frozenset((s, t)) for s, t in combinations({frozenset(s) for s in sets if s}, 2) if 100 * len(s & t) >= 85 * len(s | t)}
    assert len(pairs) == len(set(pairs)) == len(different) and all(a < b for a, b in pairs)


def test_join_keeps_one_of_each_group(spark):
    rows = near_copies()
    sets, part, _ = brute_components(rows)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_first(frame(spark, rows, "s")).collect()]
    place = defaultdict(list)
    for row, s, p in zip(rows, sets, part):
        place[row].append(p if s else None)
    groups = [place[k][0] for k in kept]
    assert sorted(g for g in groups if g is not None) == sorted({p for s, p in zip(sets, part) if s})
    assert sum(g is None for g in groups) == sum(not s for s in sets)


def test_join_of_nothing(spark):
    assert ngram_join.component_ids(ngram_join.near_duplicates(frame(spark, []))).count() == 0
    assert ngram_join.linked(frame(spark, [])).count() == 0


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(6, 120))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        a = int(rng.integers(0, len(base) * 15 // 100 + 1))
        room = (100 * (len(base) - a) - 85 * len(base)) // 85
        other = np.unique(np.concatenate([rng.permutation(base)[a:], rng.integers(0, 2**63, int(rng.integers(0, room + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        assert 100 * both >= 85 * (len(base) + len(other) - both)
        assert len(np.intersect1d(ngram_join.signatures(base), ngram_join.signatures(other))) or np.array_equal(base, other)


def test_batches_join_nodes_that_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(40):
        nodes, sigs = rng.integers(0, 60, 150) * 7 + 3, rng.integers(-80, 80, 150)
        names, parts, sig, owner = ngram_join.join_batch(sigs, nodes)
        up = {n: n for n in nodes.tolist()}
        changed = True
        while changed:
            changed = False
            for s in set(sigs.tolist()):
                low = min(up[n] for n in nodes[sigs == s].tolist())
                for n in nodes[sigs == s].tolist():
                    changed |= up[n] != low
                    up[n] = low
        assert dict(zip(names.tolist(), parts.tolist())) == up
        assert {s: up[nodes[sigs == s][0]] for s in sig.tolist()} == dict(zip(sig.tolist(), owner.tolist()))
        assert len(set(sig.tolist())) == len(sig) == len(set(sigs.tolist()))


def test_rows_without_id_meet_their_own_texts(spark):
    rows = [(None, f"a text without id number {i} " * 3) for i in range(60)] * 2 + near_copies()
    found = ngram_join.set_table(frame(spark, rows))
    members = found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h"))
    assert ngram_join._with_sets(frame(spark, rows), members.select("doc_id", "h", "digest")).count() <= len(rows)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 40))).astype(np.uint64)) for _ in range(30)]
        index = ngram_join.InvertedIndex(sets)
        for q in sets[:8]:
            got = list(index.search(q, lambda i: False, lambda i: i + 1))
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
            assert got == want


# --- nearest neighbours ----------------------------------------------------------

def test_search_recall_and_exact_scores(spark):
    got = queries.QUERIES["op6_inverted_multi_index"](spark, "/root/testdata/sf0.1").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist()).astype(float), e.vec_id.to_numpy()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine.vec_id)
        assert mine.score.tolist() == [d[ids == v][0] for v in mine.vec_id] and mine.score.is_monotonic_increasing
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(mine.vec_id)) / 10)
    assert np.mean(hits) >= 0.9


def test_search_odd_vectors_ties_and_parts(spark):
    rows = [(0, [1.0, 0.0, 0.0], "r"), (1, [2.0, 0.0, 0.0], "r"), (2, [0.5, 0.0, 0.0], "r"), (2, [0.5, 0.0, 0.0], "r"), (3, None, "r"),
            (4, [0.0, 0.0, 0.0], "r"), (5, [1.0, None, 0.0], "r"), (6, [1.0, float("nan"), 0.0], "r"), (7, [1.0, float("inf"), 0.0], "r"),
            (8, [1.0], "r"), (None, [1.0, 1.0, 1.0], "r"), (9, [1.0, 0.0, 0.0], "r"), (10, [1.0, 0.0, 0.0], "r"), (100, None, "r")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    every = lambda i: F.pmod(i, F.lit(100)) == 0
    got = ann.search(v, every, top=10, k=2, probe=1.0, part_rows=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 9, 0.0), (0, 2, 10, 0.0), (0, 3, 2, 0.5), (0, 4, 1, 1.0)]
    assert ann.search(v.limit(0), every).count() == 0


def test_search_with_repeated_ids_and_chunked_queries(spark):
    """A vec_id with many vectors takes one place, and queries in many chunks find the same."""
    rng = np.random.default_rng(5)
    rows = [(1, [0.1 + i / 1000, 0.2]) for i in range(14)] + [(i, rng.random(2).tolist()) for i in range(2, 22)] + [(0, [0.1, 0.2])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = {}
    for i, x in rows:
        d = np.sqrt(((np.array(x) - [0.1, 0.2]) ** 2).sum())
        near[i] = min(near.get(i, d), d)
    want = sorted(((d, i) for i, d in near.items() if i))[:10]
    got = ann.search(v, lambda i: i == 0, k=1, probe=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in want] and [r.score for r in got] == pytest.approx([d for d, _ in want])
    whole, cut = (sorted(map(tuple, ann.search(v, lambda i: i % 2 == 0, k=2, probe=1.0, ask_rows=n).collect())) for n in (100, 2))
    assert whole == cut and len({r[0] for r in whole}) == 11


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(1)
    d1, d2, sizes = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    cells = ann.nearest_cells(d1, d2, sizes, 10**6)
    want = sorted(((d1[i] + d2[j], i, j) for i in range(7) for j in range(9) if sizes[i, j]))
    assert cells == [(i, j) for _, i, j in want]
    held = ann.nearest_cells(d1, d2, sizes, 12)
    assert sum(sizes[c] for c in held) >= 12 > sum(sizes[c] for c in held[:-1])


# --- packing ---------------------------------------------------------------------

def test_packing_covers_every_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["a  b", "a\n\n\nb", " x", "x ", "\n", "", None, "x \n y", "a\tb\t c", "i'm <|endoftext|> don't", "é\n\x85z 12\r\nq", "w " * 5000, "w " * 5000]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(90_000 + i, x) for i, x in enumerate(odd)] + [(None, "null id")]
    got = packing.pack_documents(frame(spark, rows, "length"), queries.tokenizer_ranks()).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    by = {k: g.sort_values("start") for k, g in got.groupby(got.doc_id.fillna(-1))}
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        g = by[-1 if d is None else d]
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        at = 0
        for start, n, crc in zip(g.start, g.length, g.ids_crc32):
            assert start == at and crc == zlib.crc32(ids[at:at + n].tobytes()) and n & (n - 1) == 0 and n <= 1024
            at += n
        assert (g.length < 1024).sum() == bin(len(ids) % 1024).count("1")
    assert packing.pack_documents(frame(spark, []), queries.tokenizer_ranks()).count() == 0


def test_packing_matches_added_tokens_as_tokenizers_does(spark, tmp_path):
    """Default ``tokenizers`` (no encode_special_tokens) against the query and the stage."""
    import json

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        assert {a["content"]: a["id"] for a in json.load(f)["added_tokens"]} == queries.SPECIAL_TOKENS
    t, end = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [f"i am {end} here", end, f"{end}{end}", f"x  {end}  y", f"a{end}b", f" {end} \n x", f"\n\n{end}\n\n", f"{end} i'm",
             "<|endoftext", "< |endoftext|>", "<|ENDOFTEXT|>", f"<|{end}|>", f"é {end}😀", f"{end} w" * 900, "plain", "", None]
    docs = frame(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert t.encode(texts[0], add_special_tokens=False).ids == [72, 716, 220, 50256, 994]
    for got in (queries.QUERIES["op7_power_of_two_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        got = got.toPandas()
        for i, text in enumerate(texts):
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
            g = got[got.doc_id == i].sort_values("start")
            assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
            assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()


# --- mixture ---------------------------------------------------------------------

def pour(node, budget):
    """Water-filling by bisection: (weight, capacity) or (weight, children) trees."""
    def room(n):
        return n[1] if not isinstance(n[1], dict) else sum(room(c) for c in n[1].values())
    if not isinstance(node[1], dict):
        return min(budget, node[1])
    kids, low, high = node[1], 0.0, 1e9
    budget = min(budget, room(node))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(room(c), mid * c[0]) for c in kids.values()) < budget else (low, mid)
    return {k: pour(c, min(room(c), high * c[0])) for k, c in kids.items()}


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "x", 50), ("b", "y", 30), ("c", "z", 5000)], "p string, q string, tokens long")
    weights = {"a": 2.0, "b": 3.0, "c": 1.0, "a/x": 4.0, "b/x": 2.0}
    tree = (1, {"a": (2, {"x": (4, 200), "y": (1, 2000)}), "b": (3, {"x": (2, 100), "y": (1, 60)}), "c": (1, {"z": (1, 10000)})})
    for budget in (60.0, 500.0, 1500.0, 99_999.0):
        want = pour(tree, budget)
        got = mixing.leaf_budgets(leaves, ["p", "q"], weights, F.lit(budget), 2).collect()
        assert len(got) == 5
        for r in got:
            assert abs(r.budget - want[r.p][r.q]) <= 1.001


def test_prefix_of_seeded_epochs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["s1", "s2", "hot", "hot", "hot", None]), 7) for i in range(400)]
    rows += [(400, None, "s1", 7), (None, "w w w", "s2", 7), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    weights = {"s1": 8.0, "s2": 1.0}
    got = mixing.mix(docs, {"source": F.col("source")}, weights, fraction=0.7, max_epochs=3).collect()
    n = lambda t: len((t or "").split())
    have = defaultdict(list)
    for d, t, s, _ in rows:
        if n(t):
            have[s].append((d, n(t)))
    total = {s: sum(k for _, k in v) for s, v in have.items()}
    want = pour((1, {s: ({"s1": 8, "s2": 1}.get(s, 1), 3 * t) for s, t in total.items()}), 0.7 * sum(total.values()))
    key = lambda e, d: hashlib.md5(f"17|{e}|{'' if d is None else d}".encode()).hexdigest()
    expect = []
    for s, v in have.items():
        full, rest = divmod(int(want[s] + 1e-6), total[s])
        v = sorted(v, key=lambda x: key(full, x[0]))
        at, stop = 0, None
        for d, k in v:
            at += k
            if at > rest:
                stop = key(full, d)
                break
        for d, k in v:
            expect += [(d, e) for e in range(full + (key(full, d) < stop))]
    assert sorted(((r.doc_id, r["__epoch"]) for r in got), key=str) == sorted(expect, key=str)
    assert got[0].tokens == 7
    assert mixing.mix(docs.limit(0), {"source": F.col("source")}, weights).count() == 0


# --- sharding --------------------------------------------------------------------

def _one_by_one(sizes, capacity):
    left, bins = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(c, b) for b, c in enumerate(left) if c >= size]
        if not fits:
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        b = min(fits)[1]
        left[b] -= size
        bins.append((size, b))
    return Counter(bins)


def test_best_fit_equals_one_group_at_a_time():
    rng = random.Random(7)
    for case in range(60):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 60 if case else 100_000))]
        runs = sorted(Counter(sizes).items())
        capacity = 60 if case else sum(sizes) // 8 + 40
        got = Counter()
        for (size, n), stretches in zip(runs, sharding.best_fit_decreasing(runs, capacity)):
            assert sum(k for k, _ in stretches) == n
            for k, b in stretches:
                got[size, b] += k
        assert got == _one_by_one(sizes, capacity)
    assert sharding.best_fit_decreasing([(5, 1), (70, 1)], 60) is None
    assert sharding.best_fit_decreasing([(30, 5)], 60, 2) is None


def test_even_packing_with_an_oversize_group():
    out = sharding.pack_even([(5000, 1), (10, 700)], 8)
    totals = Counter()
    for size, stretches in zip((5000, 10), out):
        for k, b in stretches:
            totals[b] += size * k
    most = sorted(totals.values())
    assert most[-1] == 5000 and most[-2] - most[0] <= 10 and len(most) == 8
    assert sharding.pack_even([], 8) == [] and sharding.pack_even([(3, 1)], 8) == [[(1, 0)]]
    assert sharding.pack_even([(9, 3)], 8) == [[(1, 0), (1, 1), (1, 2)]]


def test_shards(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(i, "copies of one text") for i in range(1000, 1100)] + [(2000, None), (2001, ""), (None, "x"), rows[0]]
    rows += [(i, f"small {i}") for i in range(3000, 9000)] + [(9000, "long " * 100_000)]
    got = sharding.shard_documents(frame(spark, rows, "shard"), 8).toPandas()
    assert len(got) == len(rows)
    text = defaultdict(set)
    by = {(d if d is not None else -1): t for d, t in rows}
    for r in got.itertuples():
        t = by[-1 if r.doc_id != r.doc_id else int(r.doc_id)] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        text[t].add(r.shard)
    assert all(len(s) == 1 for s in text.values())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    per = got.groupby("shard")["size"].sum().sort_values()
    assert len(per) == 8 and per.iloc[-1] == 500_001 and per.iloc[-2] - per.iloc[0] <= 20
    assert sharding.shard_documents(frame(spark, [])).count() == 0


# --- fixity ------------------------------------------------------------------------

def test_audit_finds_planted_faults(spark):
    rows = [(f"f{i % 7}", i // 7, (i // 7) * 100, f"record {i}", "h") for i in range(700)] + [("f0", 500, None, None, "h"), (None, 1, 0, "n", "h")]
    cols = "file string, no long, offset long, payload string, hash string"
    a = spark.createDataFrame(rows + rows[:3], cols)
    bad = {("f3", 40): "corrupt", ("f3", 41): "missing", ("f5", 99): "corrupt", ("f9", 0): "extra", ("", 1): "corrupt"}
    copy = [(f, n, o, "!" if bad.get((f or "", n)) == "corrupt" else p, h) for f, n, o, p, h in rows if bad.get((f or "", n)) != "missing"]
    b = spark.createDataFrame(copy + [("f9", 0, 0, "new", "h")], cols)
    got = warc.audit(a, b, range_bytes=300, fanout=3).collect()
    assert {(r.file, r.no): r.status for r in got} == bad and len(got) == len(bad)
    assert next(r for r in got if r.no == 40).expected == hashlib.sha256(f"record {40 * 7 + 3}".encode()).hexdigest()
    assert warc.audit(a, a).count() == 0
    assert {r.status for r in warc.audit(a, a.limit(0)).collect()} == {"missing"} and warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_audit_reaches_records_without_an_offset(spark):
    cols = "file string, no long, offset long, payload string"
    rows = [("f", i, i * 100, f"record {i}") for i in range(200)] + [("f", 200 + i, None, f"record {200 + i}") for i in range(5)]
    rows += [("g", i, None, f"lone {i}") for i in range(3)] + [(None, None, None, "bare")]
    bad = {("f", 201): "corrupt", ("f", 203): "missing", ("f", 7): "corrupt", ("g", 1): "corrupt", ("", None): "corrupt", ("h", 0): "extra"}
    copy = [(f, n, o, "!" if bad.get((f or "", n)) == "corrupt" else p) for f, n, o, p in rows if bad.get((f or "", n)) != "missing"]
    a, b = spark.createDataFrame(rows, cols), spark.createDataFrame(copy + [("h", 0, None, "new")], cols)
    for fanout in (3, 16):
        got = warc.audit(a, b, range_bytes=300, fanout=fanout).collect()
        assert {(r.file, r.no): r.status for r in got} == bad and len(got) == len(bad)


# --- preference pairs ----------------------------------------------------------------

def test_pairs(spark):
    cols = "pair_id long, turn long, role string, text string, prompt string"
    a = spark.createDataFrame([(1, 0, "user", "hi", "p"), (1, 1, "assistant", "yes", "p"), (1, 5, "user", "more", "p"), (1, 6, "assistant", "é😀!", "p"),
                               (1, 6, "assistant", "é😀!", "p"), (2, 0, "user", None, "p"), (3, 0, None, "q", "p"), (None, 0, "user", "x", "p")], cols)
    b = spark.createDataFrame([(1, 0, "user", "hi", "p"), (1, 2, "assistant", "yes", "p"), (1, 5, "user", "other", "p"), (1, 9, "assistant", "no", "p"),
                               (1, 9, "assistant", "no more", "p"), (2, 3, "user", "", "p"), (4, 0, "assistant", "z", "p")], cols)
    got = {r.pair_id: r for r in chat.format_pairs(a, b).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert r.n_common == 2 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    cut = lambda text, spans: [text[int(s):int(e)] for s, e in (x.split(":") for x in spans.split(",") if x)]
    assert r.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\né😀!<|end|>\n" and cut(r.chosen, r.chosen_spans) == ["é😀!"]
    assert cut(r.rejected, r.rejected_spans) == ["no", "no more"]
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[2].prompt == "<|user|>\n<|end|>\n"
    assert got[3].chosen == "<|unknown|>\nq<|end|>\n" and got[3].rejected == "" and cut(got[4].rejected, got[4].rejected_spans) == ["z"]
    assert chat.format_pairs(a.limit(0), b.limit(0)).count() == 0
