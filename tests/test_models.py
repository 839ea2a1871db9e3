"""Invariants of the trained models on the smallest tables."""

import os
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import forest_grid as FG
from textloom.operators import metrics as MT

from textloom.operators import models as ML
from textloom.operators import skipgram as SG
from textloom.operators import sparse_forest as SP
from textloom.operators import topic_model as TM
from textloom.operators.common import CLEANUP
from textloom.plans import QUERIES
from textloom.plans.ml import labelled_docs
from textloom.plans.vocab import w2v_sentences
from textloom.sources import io as IO

SF = "/root/testdata/sf0.001"


def test_forest_ranks_better_than_chance(spark):
    data = labelled_docs(spark, SF)
    scored = ML.tfidf_forest(n_trees=20).fit(data).transform(data)
    assert BinaryClassificationEvaluator(labelCol="label").evaluate(scored) > 0.5
    assert scored.where(ML.probability_of().between(0, 1)).count() == data.count()


def _features(spark, n_docs=200):
    pipe = ML.tfidf_forest(vocab_size=400)
    data = labelled_docs(spark, SF)
    return pipe, Pipeline(stages=pipe.getStages()[:-1]).fit(data).transform(data).select("doc_id", "label", "features").cache()


def test_cut_forest_scores_like_a_forest_of_that_size(spark, tmp_path):
    pipe, feats = _features(spark)
    rf = pipe.getStages()[-1]
    whole = rf.copy({rf.numTrees: 40, rf.maxDepth: 12}).fit(feats)
    nodes = FG.forest_nodes(spark, whole, str(tmp_path / "f"))
    assert len(nodes.roots) == 40 and len(nodes.left) == whole.totalNumNodes
    cuts = FG.score_cuts(feats, nodes, (15, 40), (3, 12), "label", "features").cache()
    full = sorted((int(r.label), round(r.p, 9)) for r in whole.transform(feats).select(
        "label", ML.probability_of().alias("p")).collect())
    assert sorted((r.label, round(r.score, 9)) for r in cuts.where("setting = 3").collect()) == full
    # a forest grown to the cut's size ranks as well, within sampling error
    small = rf.copy({rf.numTrees: 15, rf.maxDepth: 3, rf.seed: 5}).fit(feats)
    grown = MT.roc_auc(small.transform(feats).select("label", ML.probability_of().alias("score"))).first()["auc"]
    cut = MT.roc_auc(cuts.where("setting = 0")).first()["auc"]
    assert abs(grown - cut) < 0.1


def test_cut_ends_are_pruned_like_a_shallow_tree():
    """A tree of depth 2 whose right side predicts one class below the root."""
    rows = pd.DataFrame({"tree": [0] * 7, "id": range(7), "left": [1, 2, -1, -1, 5, -1, -1], "right": [4, 3, -1, -1, 6, -1, -1],
                         "feature": [3, 5, -1, -1, 3, -1, -1], "threshold": [.5, .5, -1, -1, 2, -1, -1],
                         "stats": [[5, 5], [4, 1], [4, 0], [0, 1], [1, 4], [1, 3], [0, 1]]})
    nodes = FG.Nodes(rows)
    assert nodes.depth.tolist() == [0, 1, 2, 2, 1, 2, 2] and nodes.features.tolist() == [-1, 3, 5]
    assert nodes.ends(2).tolist() == [False, False, True, True, True, True, True]
    x = np.array([[0, 0, 1.0], [0, 1.0, 0], [0, 0, 0]])
    assert nodes.scores(x, [1], [0, 1, 2]).tolist() == [[.5, .2, 1], [.5, .8, .8], [.5, .2, 0]]


def test_grid_has_all_settings(spark):
    pipe = ML.tfidf_forest(vocab_size=300)
    grid = FG.grid_search(pipe, labelled_docs(spark, SF), lambda n: IO.scratch_path(spark, n), trees=(4, 9), depths=(2, 3, 5),
                          folds=3, parallelism=4).collect()
    assert {(r.trees, r.depth, r.subset, r.impurity) for r in grid} == set(
        product((4, 9), (2, 3, 5), ("sqrt", "log2"), ("gini", "entropy"))) and len(grid) == 24
    assert all(0 <= r.auc <= 1 for r in grid) and max(r.auc for r in grid) > 0.55


def _rows_of_words(n=120):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.4, (n, 12)) * rng.choice([0.5, 1.5, -1.0], 12)
    y = ((x[:, 0] + x[:, 3] + rng.normal(0, 0.5, n)) > 0.5).astype(float)
    return x, y


def test_sparse_forest_splits_like_a_plain_search(spark):
    """Every node of a forest that draws all features has the best gain of its bootstrap rows."""
    x, y = _rows_of_words()
    df = spark.createDataFrame([(i, float(y[i]), 0, x[i].tolist()) for i in range(len(y))], "key long, label double, fold int, x array<double>")
    df = df.select("key", "label", "fold", array_to_vector("x").alias("features"))
    bins = SP.fold_bins(df, "features", 2, 12, 32)[1]
    for f in range(12):
        v = np.unique(x[:, f])
        assert np.allclose(bins.values[bins.start[f]:bins.start[f + 1]], (v[:-1] + v[1:]) / 2)
    weight = SP.bags(np.arange(len(y)), 3, 7, SP.bag_table(1.0)).astype(int)
    for kind in ("gini", "entropy"):
        nodes = [SP.grow(SP.packed_blocks(df.repartition(k), bins, "label", "features", "key"), bins, 2, 3, 4, "all", kind, 7) for k in (1, 5)]
        assert nodes[0].equals(nodes[1]) and set(nodes[0]["tree"]) == {0, 1, 2}
        for t, tree in nodes[0].groupby("tree"):
            at, todo = tree.set_index("id"), [(0, np.arange(len(y)), 0)]
            while todo:
                i, rows, depth = todo.pop()
                n, w = at.loc[i], weight[rows, t]
                count = lambda r: np.bincount(y[r].astype(int), weights=weight[r, t], minlength=2)
                bad = lambda c: SP.impurity_of(c[None, :], kind)[0]
                gain = lambda f, cut: bad(count(rows)) - sum(
                    count(s).sum() / w.sum() * bad(count(s)) for s in (rows[x[rows, f] <= cut], rows[x[rows, f] > cut]))
                assert list(n["stats"]) == count(rows).tolist()
                best = max(gain(f, c) for f in range(12) for c in bins.values[bins.start[f]:bins.start[f + 1]])
                if n["left"] < 0:
                    assert depth == 4 or best < 1e-9
                    continue
                assert abs(gain(n["feature"], n["threshold"]) - best) < 1e-9
                low = x[rows, n["feature"]] <= n["threshold"]
                todo += [(n["left"], rows[low], depth + 1), (n["right"], rows[~low], depth + 1)]


def test_sparse_forest_ranks_like_sparks(spark):
    pipe, feats = _features(spark)
    rf, held = pipe.getStages()[-1], feats.where("doc_id % 3 = 0")
    data = feats.withColumn("fold", (F.col("doc_id") % 3 != 0).cast("int")).withColumn("key", F.xxhash64("doc_id"))
    bins = SP.fold_bins(data, "features", 2, 400, 32)[0]
    blocks = SP.packed_blocks(data.where("fold = 1"), bins, "label", "features", "key")
    for subset in ("sqrt", "log2"):
        nodes = SP.grow(blocks, bins, 2, 100, 6, subset, "gini", 0)
        ours = MT.roc_auc(FG.score_cuts(held, FG.Nodes(nodes), (100,), (6,), "label", "features")).first()["auc"]
        model = rf.copy({rf.numTrees: 100, rf.maxDepth: 6, rf.featureSubsetStrategy: subset}).fit(data.where("fold = 1"))
        theirs = MT.roc_auc(model.transform(held).select("label", ML.probability_of().alias("score"))).first()["auc"]
        assert abs(ours - theirs) < 0.15
        inner = nodes[nodes["left"] >= 0]
        assert inner["feature"].nunique() > 20 and 0.5 < len(nodes) / model.totalNumNodes < 2


def test_nodes_draw_runs_of_all_features():
    level = SP.Level(3, np.arange(60), None, None, None, None, np.zeros(0, np.uint8), 33, 9, 5, 2, None)
    runs = level.run_of(300)
    assert runs.shape == (300, 3) and all((np.bincount(runs[:, i])[:33] == 9).all() for i in range(3))
    assert not (runs[:, 0] == runs[:, 1]).all()
    weight = SP.bags(np.random.default_rng(0).integers(-2**62, 2**62, 4000), 50, 0, SP.bag_table(1.0))
    assert abs(weight.mean() - 1) < 0.01 and abs((weight == 0).mean() - np.exp(-1)) < 0.01 and abs(weight.var() - 1) < 0.02
    assert abs(np.corrcoef(weight.T)[0, 1:]).max() < 0.08
    many = SP.thresholds_of(np.arange(1.0, 101), np.ones(100), 200, 31)
    assert len(many) <= 31 and (many > 0).all()


def test_grid_fits_no_dense_forest(spark, monkeypatch):
    """Spark ML's forest holds a cell for each row and feature; the grid must not fit one."""
    from pyspark.ml.classification import RandomForestClassifier
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a dense forest was fitted"))
    grid = FG.grid_search(ML.tfidf_forest(vocab_size=300), labelled_docs(spark, SF), lambda n: IO.scratch_path(spark, n),
                          trees=(3,), depths=(2,), subsets=("sqrt",), impurities=("gini",), folds=2).collect()
    assert len(grid) == 1


def _planted(spark):
    rng = np.random.default_rng(1)
    groups = [["red", "green", "blue", "pink"], ["cat", "dog", "cow", "hen"], ["one", "two", "six", "ten"]]
    rows = [(i, rng.choice(groups[i % 3], 30).tolist() + ["the"] * 10) for i in range(90)]
    return groups, spark.createDataFrame(rows, "doc_id long, tokens array<string>")


@pytest.mark.parametrize("blocks", [1, 2])
def test_skip_gram_finds_planted_neighbours(spark, blocks):
    groups, docs = _planted(spark)
    settings = dict(min_count=5, size=12, passes=60 if blocks == 1 else 24, negative=3, sample=1.0, blocks=blocks, per_visit=12)
    v = {r.word: np.array(r.vec) for r in SG.train(docs, **settings).collect()}
    assert set(v) == {w for g in groups for w in g} | {"the"} and all(len(x) == 12 for x in v.values())
    unit = {w: x / np.linalg.norm(x) for w, x in v.items()}
    for g in groups:
        for w in g:
            near = sorted((x for x in unit if x not in (w, "the")), key=lambda x: -unit[w] @ unit[x])
            assert set(near[:3]) == set(g) - {w}
    again = {r.word: np.array(r.vec) for r in SG.train(docs.repartition(3), **settings).collect()}
    assert all(np.allclose(v[w], again[w], atol=1e-5) for w in v)


def test_skip_gram_pairs(spark):
    docs = spark.createDataFrame([(1, list("abcab")), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("a", 1, 3), ("b", 2, 2), ("c", 3, 1)], "word string, id int, cnt long")
    got = {(r.a, r.b): r.n for r in SG.pair_counts(docs, words, 1, 1e9, 7).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (2, 3): 1, (3, 2): 1, (3, 1): 1, (1, 3): 1}
    wide = SG.pair_counts(docs, words, 4, 1e9, 7).agg(F.sum("n")).first()[0]
    assert 8 <= wide <= 20                       # pairs at distance k stay with (5 - k) / 4
    many = spark.createDataFrame([(i, ["a", "b"] * 50) for i in range(50)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("a", 1, 2500), ("b", 2, 2500)], "word string, id int, cnt long")
    thin = SG.pair_counts(many, words, 1, 0.02, 7).agg(F.sum("n")).first()[0]
    assert 0.18 * 9900 < thin < 0.3 * 9900       # one in about four occurrences stays (sqrt(.04) + .04)
    assert SG.train(docs, min_count=50).collect() == []


def test_document_vectors_are_means(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, ["zz"])], "doc_id long, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    assert [(r.doc_id, [round(x, 9) for x in r.vec]) for r in SG.document_vectors(docs, vec).collect()] == [(1, [round(2 / 3, 9), 1.0])]


def test_skip_gram_cells_hold_every_pair(spark):
    """Counts move packed, a row a cell, and are those of ``pair_counts``, whose draws are Spark's hashes."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i if i % 7 else None, [f"w{j}" for j in rng.integers(0, 40, 30)]) for i in range(40)],
                                 "doc_id long, tokens array<string>").repartition(5)
    words = spark.createDataFrame([(f"w{j}", j + 1, 30) for j in range(35)], "word string, id int, cnt long")
    plain = {(r.a, r.b): r.n for r in SG.pair_counts(docs, words, 3, 0.01, 7).collect()}
    blk, place, size = SG._dealt(35, 4, 7)
    assert [r[0] for r in spark.range(1, 36).select(F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("int")), F.lit(4))).collect()] == blk[1:].tolist()
    at = {(int(b), int(p)): i for i, (b, p) in enumerate(zip(blk, place)) if i}
    got = {}
    for r in SG.pair_cells(docs, words, 35, 4, 3, 0.01, 7).collect():
        keys, n = SG._pairs_of(pd.DataFrame([r.asDict()]))
        got |= {(at[r.cell, int(k >> 32)], at[(r.cell + r.turn) % 4, int(k & 0xFFFFFFFF)]): int(x) for k, x in zip(keys, n)}
    assert got == plain and len(plain) > 300


def test_skip_gram_rounds_leave_one_state(spark, tmp_path, monkeypatch):
    """Of all rounds only the last vectors stay on disk, a row for each side of a block."""
    kept = []
    monkeypatch.setattr(SG, "materialize", lambda df, f=SG.materialize: kept.append(f(df)) or kept[-1])
    _, docs = _planted(spark)
    SG.train(docs, min_count=5, size=8, passes=6, negative=3, sample=1.0, blocks=2, per_visit=2).collect()
    files = [d._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get() for d in kept]
    there = [os.path.exists(f.removeprefix("file:")) for f in files]
    assert len(kept) == 2 + 4 and there == [True, True, False, False, False, True]
    assert kept[-1].count() == 4 and spark.conf.get(CLEANUP, None) is None or spark.conf.get(CLEANUP) == "false"


def test_document_vectors_move_a_vector_once_a_part(spark):
    """Not a row of a vector for each word of each document."""
    rng = np.random.default_rng(8)
    rows = [(i % 30, rng.choice([f"w{j}" for j in range(12)], 9).tolist()) for i in range(40)] + [(None, ["w1"]), (99, None), (98, [None, "w2"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vec = {f"w{j}": rng.random(5) for j in range(10)}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "word string, vec array<double>")
    out = SG.document_vectors(docs, table)
    assert "aggregate_metrics" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()).lower() and "MapInArrow" in plan
    want = {}
    for d, t in rows:
        want.setdefault(d, []).extend(vec[w] for w in t or [] if w in vec)
    got = {r.doc_id: r.vec for r in out.collect()}
    assert set(got) == {d for d, v in want.items() if v} and all(np.allclose(got[d], np.mean(want[d], axis=0)) for d in got)


def test_words_of_the_word_vector_corpus(spark):
    """Words are found in the text, not left over by a replacement of the rest."""
    texts = ["It's A\u212a test-CASE, x1y2 ''", "", None, "\u00c9t\u00e9 caf\u00e9 \u0130I", " \n", "''a b''\u00a0c"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = d.select(T.tokenize_ws(T.alpha_only("text")).alias("old"), F.transform(T.alpha_words("text"), lambda x: F.lower(x)).alias("new")).collect()
    assert all(x.old == x.new for x in r) and r[2].new is None and r[0].new[:2] == ["it's", "a"]
    assert "regexp_replace" not in w2v_sentences(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lda_topics(spark):
    rows = QUERIES["top_lda"](spark, SF).collect()
    assert {r.topic for r in rows} == {0, 1, 2, 3} and len(rows) == 40
    for t in range(4):
        assert len({r.word for r in rows if r.topic == t}) == 10


def test_topic_model_finds_planted_topics(spark):
    rng = np.random.default_rng(3)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abc"]
    rows = [(i, rng.choice(groups[i % 3], 25).tolist()) for i in range(90)] + [(90, []), (91, None), (None, ["a0", "zz"]), (92, [None])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    trace = []
    words, shares = TM.train(docs, k=3, passes=30, trace=trace)
    assert len(trace) > 3 and all(b >= a - 1e-9 * abs(a) for a, b in zip(trace, trace[1:]))
    top = TM.top_words(words, 3, 8).collect()
    assert {frozenset(r.word for r in top if r.topic == t) for t in range(3)} == {frozenset(g) for g in groups}
    assert all(sorted(r["rank"] for r in top if r.topic == t) == list(range(8)) for t in range(3))
    got = {r.doc: np.array([r.q0, r.q1, r.q2]) for r in shares.collect()}
    assert set(got) == set(range(90))
    assert all(abs(q.sum() - 1) < 1e-9 and q.argmax() == got[d % 3].argmax() and q.max() > 0.9 for d, q in got.items())
    p = words.agg(*[F.sum(f"p{i}") for i in range(3)]).first()
    assert all(abs(x - 1) < 1e-9 for x in p)


def test_topic_model_step_is_the_plain_one(spark):
    """One pass against the formula in numpy, and a model of no documents."""
    rows = [(1, list("aab")), (2, list("bcc")), (3, list("abc"))]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    w0, _ = TM.train(docs, k=2, passes=0)
    w1, d1 = TM.train(docs, k=2, passes=1, alpha=0.1, eta=0.01)
    p = np.array([[r.p0, r.p1] for r in w0.orderBy("word").collect()])
    n = np.array([[t.count(w) for w in "abc"] for _, t in rows], dtype=float)
    share = p / p.sum(1, keepdims=True)          # a uniform start of the documents cancels out
    by_word = n.sum(0)[:, None] * share + 0.01
    by_doc = n @ share + 0.1
    assert np.allclose([[r.p0, r.p1] for r in w1.orderBy("word").collect()], by_word / by_word.sum(0))
    assert np.allclose([[r.q0, r.q1] for r in d1.orderBy("doc").collect()], by_doc / by_doc.sum(1, keepdims=True))
    none, _ = TM.train(docs.limit(0), k=2, passes=2)
    assert none.count() == 0


def test_topic_model_passes_leave_one_state(spark, monkeypatch):
    """Of all passes only the last counts and shares stay on disk, and a pass sends no word."""
    kept = []
    monkeypatch.setattr(TM, "materialize", lambda df, f=TM.materialize: kept.append(f(df)) or kept[-1])
    monkeypatch.setattr(TM, "BLOCK_COUNTS", 300)
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, [f"w{j}" for j in rng.integers(0, 50, 30)]) for i in range(50)], "doc_id long, tokens array<string>")
    words, shares = TM.train(docs, k=3, passes=4, tol=0)
    files = [d._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get() for d in kept]
    there = [os.path.exists(f.removeprefix("file:")) for f in files]
    # words, dealt words, blocks, members, first parts, then the state and the parts of each pass
    assert there == [False, True, True, True, False] + [False] * 6 + [True] * 2
    assert not any("word" in d.columns for d in kept[2:])
    blocks = kept[2].collect()
    assert len(blocks) >= 4 and all(len(b.n) == len(b.w) and len(b.n) <= 300 + 30 for b in blocks)   # a byte each
    assert words.count() == 50 and shares.count() == 50


def test_mean_vector_classifier_ranks_held_out_rows(spark):
    """Documents of two planted vocabularies: the held-out half is told apart."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice(["up", "high", "top"] if i % 2 else ["down", "low", "deep"], 6).tolist() + ["the"], float(i % 2))
            for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>, label double")
    v = SG.document_vectors(docs, SG.train(docs, min_count=2, size=8, passes=20, negative=3, sample=1.0)).join(
        docs.select("doc_id", "label"), "doc_id")
    model, _ = ML.mean_vector_classifier(v.where("doc_id < 40"))
    held = model.transform(v.where("doc_id >= 40").withColumn("features", array_to_vector("vec")))
    scored = held.select("label", ML.probability_of().alias("score"))
    assert scored.count() == 40 and MT.roc_auc(scored).first()["auc"] > 0.95


def test_mean_vectors_are_made_once(spark):
    """The fit and the scores read kept vectors; the corpus is not read again."""
    df = spark.range(40).select(F.array(F.col("id") % 5 / 5, F.rand(3)).alias("vec"), (F.col("id") % 2).cast("double").alias("label"))
    model, feat = ML.mean_vector_classifier(df)
    assert "Range" not in feat._jdf.queryExecution().optimizedPlan().toString()
    assert model.transform(feat).where(ML.probability_of().between(0, 1)).count() == 40


def test_projection_and_clusters(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    pcs = QUERIES["ml_pca_project"](spark, SF)
    var = pcs.agg(F.var_samp("x").alias("x"), F.var_samp("y").alias("y")).first()
    assert pcs.count() == n and var.x >= var.y
    assert QUERIES["ml_kmeans_topics"](spark, SF).agg(F.sum("n")).first()[0] == n


def test_forest_query_ranks_held_out_rows(spark):
    """Scores of the held-out fifth, by the library's own AUC."""
    scored = QUERIES["ml_tfidf_forest"](spark, "/root/testdata/sf0.01").select("label", F.col("p1").alias("score")).cache()
    n = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").count()
    assert abs(scored.count() - n / 5) <= 1
    assert MT.roc_auc(scored).first()["auc"] > 0.55


def test_reloaded_pipeline_scores_alike(spark):
    rows = QUERIES["ml_save_load"](spark, SF).collect()
    assert len(rows) == labelled_docs(spark, SF).count() and all(r["diff"] == 0 for r in rows)


def test_batch_scoring_covers_all_documents(spark):
    got = {r.doc_id: r for r in QUERIES["ml_score_batch"](spark, SF).collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert set(got) == ids and all(0 <= r.p1 <= 1 and r.prediction == (r.p1 > 0.5) for r in got.values())


def test_topic_model_is_alike_in_more_blocks(spark, monkeypatch):
    """A pass joins words with blocks, not with every count; the number of blocks changes nothing."""
    rng = np.random.default_rng(4)
    rows = [(i, [f"w{j}" for j in rng.integers(0, 30, 20)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    a, b = [], []
    words, shares = TM.train(docs, k=3, passes=3, trace=a)
    monkeypatch.setattr(TM, "BLOCK_COUNTS", 200)
    monkeypatch.setattr(TM, "AT_ONCE", 37)
    more, parts = TM.train(docs, k=3, passes=3, trace=b)
    assert np.allclose(a, b) and len(a) == 3
    for x, y, key in ((words, more, "word"), (shares, parts, "doc")):
        x, y = (d.toPandas().set_index(key).sort_index() for d in (x, y))
        assert x.index.equals(y.index) and np.allclose(x, y)


def test_cell_by_matrices_is_the_plain_one(monkeypatch):
    rng = np.random.default_rng(5)
    n_w, n_c, size = 60, 40, 8
    pairs = np.argwhere(rng.random((n_w, n_c)) < 0.4)
    n = rng.integers(1, 5, len(pairs))
    noise, mass = rng.random(n_c) + 0.1, np.bincount(pairs[:, 0], n, n_w)
    w, c = rng.random((n_w, size)).astype(np.float32) - 0.5, rng.random((n_c, size)).astype(np.float32) - 0.5

    def run():
        a, b = w.copy(), c.copy()
        SG.fit_cell(a, np.zeros(n_w), b, np.zeros(n_c), pairs[:, 0], pairs[:, 1], n, mass, noise, 1.0, 3, 0.1, 3, 1)
        return a, b
    plain = run()
    monkeypatch.setattr(SG, "MATRIX_PAIRS", 0)
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(plain, run()))


def test_fitted_forest_is_the_pipelines(spark):
    """Features kept as checkpoints give the model that the plain pipeline fits."""
    data = labelled_docs(spark, SF).repartition(3, "doc_id").cache()
    pipe = ML.tfidf_forest(n_trees=5, vocab_size=300)
    mine, plain = ML.fit_forest(pipe, data), pipe.fit(data)
    assert [type(s) for s in mine.stages] == [type(s) for s in plain.stages]
    assert len(mine.stages[-3].vocabulary) == len(plain.stages[-3].vocabulary) and mine.stages[-1].getNumTrees == 5
    scored = mine.transform(data).select("doc_id", ML.probability_of().alias("p"))
    assert scored.count() == data.count() and scored.where("p between 0 and 1").count() == data.count()
