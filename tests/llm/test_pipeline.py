"""The pipeline stage by stage on the smallest tables, each against its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
import __spark_entry__ as E

from textloom.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, written and read again as the driver does."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        got = spark.read.parquet(f"{at}/{i}")
        out.append((docs, got))
        docs = got
    return out


def test_columns_stay(steps):
    for docs, got in steps[:-1]:
        assert got.dtypes == docs.dtypes


def test_quality_stage_drops_what_the_query_rejects(spark, steps):
    docs, got = steps[0]
    kept = {r.doc_id for r in E.queries()["op4_learned_quality_rules"](spark, SF).where("kept").collect()}
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) >= 0.9 * len(good & {r.doc_id for r in docs.collect()})


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    docs, got = steps[1]
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(i) for i in ids})


def test_secret_stage_redacts(steps):
    docs, got = steps[2]
    before = {r.doc_id: r for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == len(before)
    for r in rows:
        b = before[r.doc_id]
        assert r.text == secrets.redact_text(b.text) and r.n_chars == (b.n_chars if r.text == b.text else len(r.text))


def test_mixture_stage_moves_towards_the_weights(steps):
    docs, got = steps[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    times = Counter(r.doc_id for r in got.collect())
    n = defaultdict(int)
    for d, k in times.items():
        n[d] = len(texts[d].split()) * k
    total = sum(len(t.split()) for t in texts.values())
    assert max(times.values()) <= 4 and 0.3 * total <= sum(n.values()) <= 0.5 * total


def test_packing_stage_covers_all_rows(steps):
    docs, got = steps[4]
    rows = Counter(r.doc_id for r in docs.collect())
    tokens = defaultdict(int)
    whole = {}
    for r in got.collect():
        tokens[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
    assert set(tokens) == set(rows) and all(tokens[d] == k * whole[d] for d, k in rows.items())


def test_run_is_the_stages_in_order(spark, steps):
    got = P.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "ids_crc32").collect())) == sorted(
        map(tuple, steps[-1][1].select("doc_id", "start", "ids_crc32").collect()))
    assert "pipeline" in E.queries() and [k for k, _ in P.STAGES] == ["quality rules", "near duplicates", "secret scan", "mixture", "packing"]
