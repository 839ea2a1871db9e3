"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: Edges in a partition.
ROWS = 200_000


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v): every node of each ``rows`` edges of a partition and the least node it is
    connected with there, instead of those edges; never more rows than before."""
    def run(batches):
        up: dict = {}
        held = 0

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def found():
            ends = [(x, find(x)) for x in list(up)]
            ends = [e for e in ends if e[0] != e[1]]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], kind.field(i).type) for i in (0, 1)], ["u", "v"])
        for b in batches:
            kind = b.schema
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                p, q = find(x), find(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                held += 1
                if held == rows:
                    yield found()
                    up.clear()
                    held = 0
        if up:
            yield found()
    return edges.mapInArrow(run, edges.schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its least
    node. Rows with equal or null ends are ignored.

    Each round, every node first hands its larger neighbours to its least neighbour
    (large star), then its smaller ones (small star); rounds grow with the logarithm
    of the longest chain. Edges are first replaced by stars inside their partition, so
    edges of one partition need no round and the rounds join fewer edges. Neighbour minima are aggregates with map-side combining
    joined back by a skew-split join, and each round is cut by a checkpoint. The edges
    never grow in number, so they are kept in partitions of ``ROWS`` rows; where one
    such partition holds them all, a round needs no shuffle."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = max(1, ceil(edges.count() / ROWS))
    edges = materialize(_stars(edges.coalesce(parts), ROWS))
    if parts > 1 and edges.count() <= ROWS:
        parts, edges = 1, materialize(_stars(edges.coalesce(1), ROWS))
    edges, before = edges.coalesce(parts), None
    while parts > 1:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct())
        edges = materialize(small.coalesce(parts)).coalesce(parts)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
