"""Exact neighbours and edges with pruned pairs of blocks, against brute force."""

import hashlib

import numpy as np
import pytest

from textloom.operators import near as NR
from textloom.operators import vectors as V

DIM = 16


def _rows(spark, kind, n=400):
    rng = np.random.default_rng(11)
    if kind == "clustered":                      # ten far directions, many rows of one of them alike
        x = np.eye(DIM)[rng.integers(0, 10, n)] * 5 + rng.normal(0, .05, (n, DIM))
        x[:60] = x[0]
    else:
        x = rng.normal(0, 1, (n, DIM))
    x = x.astype(np.float32).astype(np.float64)
    if kind == "odd":
        x[:3], x[3] = 0.0, x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    return x, df


def _cosines(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    return u @ u.T


@pytest.mark.parametrize("kind", ["clustered", "uniform", "odd"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_is_exact_over_many_blocks(spark, kind, metric):
    x, df = _rows(spark, kind, 250)
    got = V.top_k_neighbours(df, k=5, metric=metric, block_bytes=25 * DIM * 8).collect()
    d = -_cosines(x) if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        mine = sorted((r for r in got if r.id == i), key=lambda r: r["rank"])
        want = np.sort(d[i])[:5]
        assert len(mine) == 5 and len({r.nbr for r in mine}) == 5
        assert np.allclose([-r.sim if metric == "cosine" else r.sim for r in mine], want, atol=1e-8)
        assert np.allclose(d[i, [r.nbr for r in mine]], want, atol=1e-8)


@pytest.mark.parametrize("kind", ["clustered", "uniform", "odd"])
@pytest.mark.parametrize("blocks", [1, 9])
def test_edges_are_exact(spark, kind, blocks):
    x, df = _rows(spark, kind)
    s = _cosines(x)
    got = V.similarity_edges(df, 0.35, block_bytes=len(x) * DIM * 8 // blocks).collect()
    assert len(got) == len({(r.src, r.dst) for r in got})
    assert {(r.src, r.dst) for r in got} == {(i, j) for i, j in zip(*np.nonzero(np.triu(s, 1) > 0.35))}
    assert all(abs(r.weight - s[r.src, r.dst]) < 1e-9 for r in got)


def test_far_blocks_are_skipped(spark):
    """Of clustered vectors most pairs of blocks are never formed, of uniform ones few are skipped."""
    shares = {}
    for kind in ("clustered", "uniform"):
        _, df = _rows(spark, kind)
        _, pairs = V.metric_blocks(df, "id", "vec", 20 * DIM * 8, True)
        bounds = [r.bound for r in pairs.select("bound").collect()]
        shares[kind] = np.mean(np.array(bounds) > np.arccos(0.6))
    assert shares["clustered"] > 0.6 and shares["uniform"] < 0.2


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, vec array<double>")
    assert V.top_k_neighbours(df, 3).count() == 0 and V.similarity_edges(df).count() == 0


def test_relaxed_wmd_in_parts_is_the_plain_one(spark, tmp_path, monkeypatch):
    """Turns in many parts against the formula; a turn without words has no pair."""
    from textloom.plans import QUERIES, wordvec
    rng = np.random.default_rng(6)
    vecs = rng.random((7, 5))
    texts = {(c, t): " ".join(rng.choice(list("abcdefgh"), 6)) for c in range(8) for t in range(3)} | {(9, 0): "a b", (9, 1): "", (9, 2): "c"}
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(*k, x) for k, x in texts.items()], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def words(text):
        seen = {w: np.log1p(text.split().count(w)) for w in sorted(set(text.split()))}
        at = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % len(vecs) for w in seen]
        return vecs[at], np.array(list(seen.values())) / sum(seen.values())
    want = {}
    for (c, t), x in texts.items():
        if x and texts.get((c, t + 1)):
            (va, wa), (vb, wb) = words(x), words(texts[c, t + 1])
            d = np.linalg.norm(va[:, None] - vb[None], axis=2)
            want[c, t, t + 1] = max((wa * d.min(1)).sum(), (wb * d.min(0)).sum())
    for most in (wordvec.PART_WORDS, 10):
        monkeypatch.setattr(wordvec, "PART_WORDS", most)
        got = {(r.conv_id, r.ta, r.tb): r.rwmd for r in QUERIES["vec_relaxed_wmd"](spark, str(tmp_path)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("kind", ["plain", "ties", "offset", "odd", "scales", "copies", "huge", "tiny"])
def test_bounded_search_equals_plain_one(kind, monkeypatch):
    """Bit for bit what direct differences give, also for repeated and null ids, copies, and
    vectors that single precision can't tell apart or hold; in few measured pairs."""
    rng = np.random.default_rng(8)

    def block(n, dim):
        m = rng.normal(0, 1, (n, dim)) * {"huge": 1e300, "tiny": 1e-12}.get(kind, 1.0)
        if kind == "ties":
            m = np.round(m)
        if kind == "offset":
            m = m * 1e-3 + 1e6
        if kind == "odd":
            m[rng.random((n, dim)) < .02], m[rng.random((n, dim)) < .02] = np.nan, np.inf
        if kind == "scales":
            m *= 10.0 ** rng.integers(-150, 150, (n, 1))
        if kind == "copies":
            m[:] = m[0]
            m[::7] += 1e-9
        return m

    def rows(frames):
        return sorted(tuple(r) for f in frames for r in f.fillna(-1).to_numpy(dtype=float).tolist())
    for gathered in (NR.GATHERED, 50):
        monkeypatch.setattr(NR, "GATHERED", gathered)
        for trial in range(12):
            k, dim, (na, nb) = int(rng.integers(1, 7)), int(rng.integers(1, 12)), rng.integers(1, 80, 2)
            ids = [rng.permutation(na + nb), rng.integers(0, 12, na + nb)][trial % 2].astype(float)
            if trial % 3 == 0:
                ids[rng.random(na + nb) < .1] = np.nan
            (a, b), (ia, ib) = (block(na, dim), block(nb, dim)), (ids[:na], ids[na:])
            with np.errstate(all="ignore"):
                found, free = NR.nearest(ia, a, k), NR.nearest_between(ia, a, np.full(na, np.inf), ib, b, np.full(nb, np.inf), k)
                (ia, a), (ib, b) = ((i[f], m[f]) for i, m in ((ia, a), (ib, b)) for f in [np.isfinite(m).all(1)])
                assert rows(found) == rows(V._best_of_block(ia, a, ia, a, k, False) if len(a) else [])
                assert rows(free) == rows(V._best_of_block(ia, a, ib, b, k, False) + V._best_of_block(ib, b, ia, a, k, False) if len(a) and len(b) else [])


def test_few_pairs_are_measured(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (3000, 32))
    met = []
    plain = NR._open_pairs
    monkeypatch.setattr(NR, "_open_pairs", lambda *a: ((met.append(len(u)), (u, v))[1] for u, v in plain(*a)))
    kth = NR.nearest(np.arange(3000), x, 5)[0].groupby("id")["sim"].max().to_numpy()
    x[2000:] = x[0]                              # a third are copies of one
    NR.nearest(np.arange(3000), x, 5)
    NR.nearest_between(np.arange(1000), x[:1000], kth[:1000], np.arange(1000, 2000), x[1000:2000], kth[1000:2000], 5)
    assert sum(met) < 0.02 * 3000 * 3000
