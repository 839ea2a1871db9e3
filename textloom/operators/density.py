"""Density clusters of vectors: neighbour graph, minimum spanning forest, cut.

The core distance of a vector is that to its k-th neighbour; an edge between neighbours
weighs the largest of their distance and both core distances, so sparse regions are far
from everything. The minimum spanning forest of that graph is found by Boruvka rounds
over an edge table: every component takes its lightest outgoing edge (ties by the ids of
its ends), the picks are followed to a root by pointer doubling, and edges are relabelled
and reduced to the lightest for each pair of components. Rounds are at most the logarithm of
the vectors; a round's tables are aggregates and joins on component ids, written to
the shared folder and read again: a checkpoint keeps the size its plan was estimated at,
and through the joins of the rounds that estimate grows to numbers of millions of digits.
Every round at least halves the components; once no more than ``IN_TASK`` edges
are left between them, one task ends the forest by sorting those. The order of edges is
total, so both ways give the one forest. Cutting it at a weight leaves the clusters of that
density."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.common import materialize, with_one_row
from textloom.operators.vectors import top_k_neighbours
from textloom.sources.io import scratch_path


#: Edges between components that one task may hold (32 bytes each).
IN_TASK = 200_000


def _stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, with the size of its files as its estimate."""
    path = scratch_path(df.sparkSession, "forest")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def reachability_edges(vectors: DataFrame, k: int = 5, id_col: str = "id", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(a, b, w) with a < b: the edges of the neighbour graph, and (id, core)."""
    near = materialize(top_k_neighbours(vectors, k, id_col, vec, metric="euclidean"))
    core = near.groupBy("id").agg(F.max("sim").alias("core"))
    pairs = near.groupBy(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).agg(F.min("sim").alias("d"))
    edges = (pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a")
             .join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
             .select("a", "b", F.greatest("d", "ca", "cb").alias("w")))
    return edges, core


def _roots(picks: DataFrame) -> DataFrame:
    """(c, root) from (c, other): the pick of every component that has one. Picks of the
    lightest edges close no cycle but two components that pick the same edge; the smaller
    of them is the root."""
    back = picks.select(F.col("c").alias("other"), F.col("other").alias("back"))
    up = picks.join(back, "other", "left").select("c", F.when(
        (F.col("back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("up"))
    while True:
        for _ in range(3):                       # three doublings a job: paths of up to eight picks
            again = up.select(F.col("c").alias("up"), F.col("up").alias("next"))
            up = up.join(again, "up", "left").select("c", F.col("up").alias("was"), F.coalesce("next", "up").alias("up"))
        up = _stored(up)
        if up.where("up <> was").isEmpty():
            return up.select("c", F.col("up").alias("root"))


def _sorted_forest(live: DataFrame) -> DataFrame:
    """(x, root, a, b, w): the forest of a bounded edge table in one task; a row for each
    component with its root, and one for each edge taken."""
    def run(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["x", "y", "a", "b", "w"])], ignore_index=True)
        rows = rows.sort_values(["w", "a", "b"])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x
        taken = []
        for x, y, a, b, w in zip(*(rows[c].tolist() for c in ("x", "y", "a", "b", "w"))):
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                taken.append((a, b, w))
        yield pd.DataFrame({"x": list(up), "root": [find(x) for x in up]}, dtype="int64").assign(a=None, b=None, w=None)
        yield pd.DataFrame(taken, columns=["a", "b", "w"]).assign(x=None, root=None)[["x", "root", "a", "b", "w"]]
    return live.select("x", "y", "e.a", "e.b", "e.w").coalesce(1).mapInPandas(run, "x long, root long, a long, b long, w double")


def spanning_forest(edges: DataFrame, in_task: int = IN_TASK) -> tuple[DataFrame, DataFrame]:
    """(a, b, w) of the minimum spanning forest of ``edges`` (a, b, w), and (node, component)
    of every node in it; a component is named by its least node. Loops are ignored; equal
    weights are ordered by the ids, so the forest is unique."""
    edge = F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = _stored(edges.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), edge.alias("e"))
                       .groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("e").alias("e")))
    nodes = live.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("c"))
    forest = []
    while (left := live.count()) > in_task:
        ends = live.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("other"), "e"),
                                             F.struct(F.col("y").alias("c"), F.col("x").alias("other"), "e"))).alias("p"))
        picks = _stored(ends.groupBy(F.col("p.c").alias("c")).agg(F.min(F.struct(F.col("p.e").alias("e"), F.col("p.other").alias("other"))).alias("m"))
                            .select("c", "m.other", "m.e"))
        forest.append(picks.select("e.a", "e.b", "e.w").distinct())
        root = _roots(picks.select("c", "other"))
        nodes = _stored(nodes.join(root, "c", "left").select("node", F.coalesce("root", "c").alias("c")))
        to = lambda c: root.select(F.col("c").alias(c), F.col("root").alias(f"r{c}"))
        live = _stored(live.join(to("x"), "x").join(to("y"), "y").where("rx <> ry")
                           .groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("e").alias("e")))
    if left:
        last = _stored(_sorted_forest(live))
        forest.append(last.where("x is null").select("a", "b", "w"))
        root = last.where("x is not null").select(F.col("x").alias("c"), "root")
        nodes = nodes.join(root, "c", "left").select("node", F.coalesce("root", "c").alias("c"))
    nodes = _stored(nodes)
    named = nodes.groupBy("c").agg(F.min("node").alias("component"))
    labels = nodes.join(named, "c").select("node", "component")
    empty = edges.select("a", "b", "w").limit(0)
    return _stored(reduce(DataFrame.unionByName, forest, empty)), labels


def density_clusters(vectors: DataFrame, k: int = 5, cut: Column | None = None, min_size: int = 5, id_col: str = "id",
                     vec: str = "vec") -> DataFrame:
    """(id, cluster) of every vector: the forest cut at ``cut``, an aggregate of the core
    distances (column ``core``; by default their median). A cluster is named by its least
    id; vectors in parts below ``min_size`` get null."""
    edges, core = reachability_edges(vectors, k, id_col, vec)
    forest, _ = spanning_forest(edges)
    limit = core.agg((F.percentile("core", 0.5) if cut is None else cut).alias("_cut"))
    _, labels = spanning_forest(with_one_row(forest, limit).where(F.col("w") <= F.col("_cut")))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    named = labels.join(sizes, "component").select(F.col("node").alias("_node"), F.col("component").alias("cluster"))
    ids = vectors.select(F.col(id_col).alias("id"))
    return ids.join(named, ids["id"] == named["_node"], "left").select("id", "cluster")
