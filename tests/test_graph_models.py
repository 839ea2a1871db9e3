"""Spanning forests, density clusters and topic models against plain algorithms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import density as D


def _kruskal(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    kept = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if find(a) != find(b):
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
            kept.add((a, b, w))
    return kept, {x: find(x) for x in up}


@pytest.mark.parametrize("seed, in_task", [(1, 0), (2, 40), (3, 10_000)])
def test_forest_equals_kruskal(spark, seed, in_task):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(6))) for _ in range(70 + 60 * seed)]
    edges += [(i, i + 1, 3.0) for i in range(100, 130)] + [(7, 7, 0.0)]          # a chain of ties, a loop
    forest, labels = D.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), in_task)
    kept, parts = _kruskal(edges)
    assert {(r.a, r.b, r.w) for r in forest.collect()} == kept and forest.count() == len(kept)
    assert {r.node: r.component for r in labels.collect()} == parts


def test_forest_of_nothing(spark):
    forest, labels = D.spanning_forest(spark.createDataFrame([], "a long, b long, w double"))
    assert forest.count() == 0 and labels.count() == 0


def test_density_clusters_find_groups_and_noise(spark):
    rng = np.random.default_rng(4)
    groups = np.repeat(np.arange(3), 25)
    x = np.vstack([np.eye(3)[groups] * 10 + rng.normal(0, .3, (75, 3)), rng.uniform(-40, 40, (30, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in D.density_clusters(df, k=4, cut=F.lit(1.5)).collect()}
    assert len(got) == 105
    for g in range(3):
        assert {got[i] for i in np.flatnonzero(groups == g).tolist()} == {25 * g}
    assert sum(got[i] is None for i in range(75, 105)) >= 28


def test_rounds_keep_size_estimates_small(spark):
    """A chain whose picks all point one way takes many doublings and rounds."""
    n = 150
    edges = [(i, i + 1, float(i % 7) + i / 1000) for i in range(n)]
    forest, labels = D.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), 0)
    assert forest.count() == n and {r.component for r in labels.collect()} == {0}
    for df in (forest, labels):
        assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10 ** 18
