"""op11, op12 and op13 against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, lexical, queries, whitening

SF = "/root/testdata/sf0.001"


# --- op11 --------------------------------------------------------------------

@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 12), [5.0] * 6, [3.0, 3.0, 3.0 - 1e-13, 1.0, 0.0, 0.0, 0.0], [2.0], [1e-9, 1e-10, 1e-30],
    [7.0, 7.0 - 1e-7, 7.0 - 2e-7, 1.0, -4.0]])
def test_sliced_eigenvalues(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    exact = np.sort(np.linalg.eigvalsh(v))[::-1]
    e, x = whitening.leading(v, d)
    scale = np.abs(exact).max()
    assert np.abs(e - exact).max() <= 1e-13 * scale
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-12
    assert np.abs(v @ x - x * e).max() <= 1e-12 * scale


def test_inertia_needs_blocks():
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    v = np.array([[0.0, 2, 1], [2, 0, 3], [1, 3, 0]])
    for s in (-4.0, -1.5, 0.0, 2.0, 5.0):
        assert whitening.count_above(v, s) == (np.linalg.eigvalsh(v) > s).sum()


def _plain_whitening(rows, k=16):
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s).astype(float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, y in x.items():
        z = np.array(y, dtype=object) * n - s
        out[i] = (n, int((z * z).sum()), (z.astype(float) / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum())
    return out


def test_whitening_matches_plain(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = _plain_whitening([(r["vec_id"], r["embedding"]) for r in docs.collect()
                              if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])])
    got = queries.QUERIES["op11_spectrum_whitening"](spark, SF).collect()
    rows = defaultdict(dict)
    for r in got:
        rows[r["vec_id"]][r["component"]] = r
    assert set(rows) == set(plain)
    axis = np.array([[rows[i][k]["whitened"] for k in range(1, 17)] for i in sorted(rows)])
    want = np.array([plain[i][2] for i in sorted(rows)])
    assert np.abs(axis * np.sign((axis * want).sum(0)) - want).max() < 1e-7
    for i, (n, far, _, share) in plain.items():
        for k in range(1, 17):
            r = rows[i][k]
            assert (r["n"], r["deviation"]) == (n, far)
            assert abs(r["explained"] / share[k - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_cases(spark):
    schema = "vec_id long, embedding array<double>, x int, v string, n long, d int"
    good = [(i, [0.1 * i, (i * i) % 7 / 7, -0.3 * (i % 3)]) for i in range(9)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [1.0, float("nan"), 2.0]), (24, [float("inf"), 0.0, 0.0]),
           (25, [1.0]), (26, [2.0 ** 41, 0.0, 0.0])]
    again = [(3, good[3][1]), (None, good[4][1]), (30, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 2, 3) for i, v in good + odd + again], schema)
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 6 if i == 3 else 3 for i in [*range(9), None, 30]})
    assert {r["n"] for r in got} == {9}          # the zero vector is that of row 0
    assert {r["component"] for r in got} == {1, 2, 3}
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []          # no variance
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>"))
    assert {r["component"] for r in line.collect()} == {1}
    big = whitening.whiten(spark.createDataFrame([(i, [float(2 ** 36 * i)]) for i in range(3)], "vec_id long, embedding array<double>"))
    assert {r["deviation"] for r in big.collect()} == {None, 0}


# --- op12 --------------------------------------------------------------------

def _plain_chars(text, order=langid.ORDER):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    return " " * (order - 1) + " ".join(words) + " " if words else None


class PlainModel:
    """Interpolated Kneser-Ney by dictionaries and recursion."""

    def __init__(self, texts, letters, order=langid.ORDER):
        self.letters, self.n = letters, [None] * (order + 1)
        self.n[order] = Counter(t[i:i + order] for t in map(_plain_chars, texts) if t for i in range(len(t) - order + 1))
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.kinds = {}, defaultdict(int), defaultdict(int)
        for k in range(1, order + 1):
            n1, n2 = (sum(c == m for c in self.n[k].values()) for m in (1, 2))
            self.d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, c in self.n[k].items():
                self.total[k, g[:-1]] += c
                self.kinds[k, g[:-1]] += 1

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / self.letters
        total = self.total.get((k, g[:-1]))
        if not total:
            return self.p(g[1:])
        return max(self.n[k][g] - self.d[k], 0) / total + self.d[k] * self.kinds[k, g[:-1]] / total * self.p(g[1:])


def test_models_match_plain(spark):
    texts = {"a": ["the cat sat on the mat, the cat", "The hat!", "then   that; other"],
             "b": ["le chat est sur le lit", "la chaîne d'or était là", "ß 中文 le"]}
    rows = [(x, False, t) for x, ts in texts.items() for t in ts]
    df = spark.createDataFrame(rows, "lang string, apart boolean, text string")
    counts = langid.window_counts(df).select("lang", "g", "n")
    models = langid.load_models(langid.shares(counts))
    letters = len({c for ts in texts.values() for t in ts for c in _plain_chars(t)}) + 1
    asked = ["the chat", "unseen ж letters", None, "12 !", "", "x" * 3000, "中文"]
    ce, size = langid.cross_entropies(asked, [models["a"], models["b"]])
    for i, name in enumerate("ab"):
        plain = PlainModel(texts[name], letters)
        for t, got, n in zip(asked, ce[:, i], size):
            chars = _plain_chars(t)
            if chars is None:
                assert n == 0 and math.isnan(got)
                continue
            logs = [math.log(plain.p(chars[j:j + langid.ORDER])) for j in range(len(chars) - langid.ORDER + 1)]
            assert n == len(logs) and got == pytest.approx(-sum(logs) / n, rel=1e-5)
        context = "  t"                          # the shares after a context add up to 1
        seen = {c for ts in texts.values() for t in ts for c in _plain_chars(t)}
        w = np.array([[ord(x) for x in context + c] for c in sorted(seen)], dtype=np.uint32)
        unseen = np.array([[ord(x) for x in context + "ж"]], dtype=np.uint32)
        p = np.exp(langid.log_shares(w, [models[name]])[0]).sum() + np.exp(langid.log_shares(unseen, [models[name]])[0][0])
        assert p == pytest.approx(1, abs=1e-5)
    few = langid.load_models(langid.shares(counts, max_entries=6))           # most go to the back-off
    assert len(few["a"].keys) < len(models["a"].keys)
    p = np.exp(langid.log_shares(w, [few["a"]])[0]).sum() + np.exp(langid.log_shares(unseen, [few["a"]])[0][0])
    assert p == pytest.approx(1, abs=1e-5)


def test_identify_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_kneser_ney_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    hits = []
    for r in docs:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= g["score"] <= 1
        if not _plain_chars(r["text"]):
            assert g["lang_pred"] == "und"
        elif g["held_out"] and r["lang"] is not None:
            hits.append(g["lang_pred"] == r["lang"])
    assert len(hits) > 150 and np.mean(hits) > 0.97


def test_identify_cases(spark):
    schema = "doc_id long, text string, lang string, g long, score int, apart int"
    rows = [(i, t, x, 1, 1, 1) for i, (t, x) in enumerate(
        [("the cat and the hat", "en"), ("the dog and the log", "en"), ("le chat et le chien", "fr"), ("la maison et le jardin", "fr")] * 8)]
    odd = [(100, None, "en", 1, 1, 1), (101, "", "fr", 1, 1, 1), (102, "42 !? ٠", None, 1, 1, 1), (None, "the hat", None, 1, 1, 1),
           (103, "le chat " * 20000, None, 1, 1, 1), (103, "le chat " * 20000, None, 1, 1, 1), (104, "zz", "", 1, 1, 1)]
    df = spark.createDataFrame(rows + odd, schema).drop("score")
    got = langid.identify(df, F.col("doc_id").isNotNull())
    assert got.columns == ["doc_id", "g", "apart", "lang_pred", "score", "cross_entropy", "accepted"]
    out = [(r["doc_id"], r["lang_pred"]) for r in got.collect()]
    assert len(out) == len(rows) + len(odd)
    assert {x for i, x in out if i in (100, 101, 102)} == {"und"} and (None, "en") in out
    assert [x for i, x in out if i == 103] == ["fr", "fr"] and (104, "") in out
    assert langid.identify(df.where("false"), F.lit(True)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


# --- op13 --------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in _TERM.findall(text or "")]


def _plain_search(docs, items, top=20):
    terms = [(i, _plain_terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in set(items):
        found = []
        asked = _plain_terms(text)
        for i, t in terms:
            m, tf = 75 + (25 * len(t) * n) // length, Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10 ** 9 * tf[x]) // (1000 * tf[x] + 12 * m))
                        for x in asked if x in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return Counter(out)


def _found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_terms_split_like_the_pattern():
    for t in (None, "", "A-b_C 9\x00z\x7fÉté  x Q@[`{~", "\U0001F600k"):
        assert [x.decode() for x in lexical.terms(t)] == _plain_terms(t)


def test_search_matches_plain(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = _plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert _found(lexical.search(docs, items)) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 2000)         # several blocks of items
    monkeypatch.setattr(lexical, "CHUNK", 64)                # several chunks in a task
    assert _found(lexical.search(docs, items)) == want


def test_blocks_are_skipped_and_lose_nothing():
    rng = np.random.default_rng(3)
    size, n = 40, 3000
    table = np.where(rng.random((size, n)) < 0.3, rng.integers(1, 900_000, (size, n)), 0).astype(np.int32)
    table[:20, : n // 2] = 0                     # two kinds of documents
    table[20:, n // 2:] = 0
    table[:, :200] = table[:, :1]                # many equal ones
    weights = rng.integers(1, 9000, size)
    asked = [lexical.Item({int(t): int(rng.integers(1, 3)) for t in rng.choice(size, 6, replace=False)}, weights) for _ in range(12)]
    wanted = {t: np.arange(size) for t in range(size)}
    docs, scored = rng.permutation(n), 0
    for item in asked:
        best = lexical.Best(10)
        for half in (slice(0, 1700), slice(1700, n)):
            part = table[:, half]
            scored += lexical.visit(item, lexical.Chunk(part, wanted, weights), best, docs[half], np.zeros(part.shape[1]))
        score = item.weights @ table[item.terms].astype(np.int64)
        want = sorted((-s, d) for s, d in zip(score.tolist(), docs.tolist()) if s > 0)[:10]
        assert list(zip((-best.scores).tolist(), best.docs.tolist())) == want
    assert scored < 0.8 * n * len(asked)


def test_search_cases(spark):
    schema = "doc_id long, text string, item int, n long, tf string, rank int"
    rows = [(1, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""), (5, "!!"),
            (6, "gamma " * 50_000 + "alpha"), (7, "Été ALPHA"), (8, "delta")]
    docs = spark.createDataFrame([(i, t, 1, 1, "x", 1) for i, t in rows], schema)
    asked = [(1, "alpha Alpha gamma"), (1, "alpha Alpha gamma"), (1, "delta"), (2, None), (3, "?"), (4, "nothing"), (None, "beta"),
             (5, "Été")]
    items = spark.createDataFrame([(i, t, 7, 8) for i, t in asked], "item_id long, text string, doc long, item int")
    want = _plain_search(rows, [x for x in asked if x[1] is not None])
    assert _found(lexical.search(docs, items)) == want
    assert _found(lexical.search(docs, items, top=2)) == _plain_search(rows, [x for x in asked if x[1] is not None], 2)
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []


def test_every_learning_text_calibrates(spark, monkeypatch):
    """More learning rows than the former bound of 20,000 of a sixteenth: each is counted."""
    words = {"en": ["the", "house", "which"], "de": ["und", "schloss", "nicht"]}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang], 4)), lang) for i in range(300) for lang in [("en", "de")[i % 2]]]
    seen = []
    fit = langid.fit_logistic
    monkeypatch.setattr(langid, "fit_logistic", lambda x, hit, n: seen.append(int(n.sum())) or fit(x, hit, n))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.col("doc_id") < 240).collect()
    assert seen == [240]
    assert all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] and r["accepted"] and 0.5 < r["score"] <= 1 for r in got)
    x, hit = np.array([0.1, 0.1, 2.0, 2.0, 2.0]), np.array([True, False, True, True, False])
    a = fit(x, hit, np.ones(5))
    b = fit(np.array([0.1, 0.1, 2.0, 2.0]), np.array([True, False, True, False]), np.array([1, 1, 2, 1]))
    assert np.allclose(a, b)
