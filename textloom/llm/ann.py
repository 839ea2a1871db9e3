"""Approximate nearest neighbours with an inverted multi-index.

A vector is cut in two halves and each half is quantised by its own codebook of
``k`` centroids (k-means on a bounded sample, the ``fit_rows`` smallest seeded hashes
of vec_id). The pair of codes names one of k * k cells, and every vector is listed in
its cell. A query walks the cells in the order of summed squared distances with a
heap over the two sorted centroid lists (multi-sequence traversal) until the cells
visited hold ``probe`` of all vectors, which a histogram of at most k * k rows
tells, and the listed vectors are reranked by exact distance.

Queries and vectors meet in a join on (cell, part). Cells above ``part_rows`` vectors
are cut into parts by a hash of the row, and each query visits all parts of its
cells, so a cell with a third of all vectors is no single task. Queries are dealt in
chunks of about ``ask_rows`` as well, so both sides of a meeting are bounded. Each
(cell, part) keeps its best ``top`` ids of a query, and one ranked window per query
ends it.

Defined cases: vectors that are null, empty, zero, of another length than the most
common one (ties: the longer), or hold null or non-finite values take no part, nor
do rows without vec_id; repeated rows count once; a vec_id with several vectors is
found once for a query, at its nearest, and asks with each of them; a query never
meets rows of its own vec_id; ties in distance go to the smaller vec_id; fewer candidates than ``top``
give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows that take part, each once."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = (vectors.select(F.col(key).alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ok))
    size = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("d")).limit(1).select("d"))
    return rows.join(F.broadcast(size), F.size("v") == F.col("d")).drop("d").dropDuplicates(["vec_id", "v"])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's k-means on a bounded sample; empty clusters take far points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        d = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None])
        near, far = d.argmin(1), np.argsort(-d.min(1), kind="stable")
        for j in range(len(centres)):
            mine = near == j
            centres[j] = x[mine].mean(0) if mine.any() else x[far[j % len(far)]]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1) if len(x) else np.zeros((0, len(centres)))


def nearest_cells(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells by growing summed distance until they hold
    ``want`` vectors. ``sizes`` is the k1 x k2 histogram of the index."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, cells, held = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        a, b = int(o1[i]), int(o2[j])
        if sizes[a, b]:
            cells.append((a, b))
            held += int(sizes[a, b])
        for s, t in ((i + 1, j), (i, j + 1)):
            if s < len(o1) and t < len(o2) and (s, t) not in seen:
                seen.add((s, t))
                heapq.heappush(heap, (float(d1[o1[s]] + d2[o2[t]]), s, t))
    return cells


def search(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", top: int = 10,
           k: int = 16, probe: float = 0.75, fit_rows: int = 20_000, part_rows: int = 20_000,
           ask_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for the rows that the
    condition ``queries`` (on vec_id) picks, among all other rows."""
    rows = materialize(usable(vectors, key, vector))
    schema = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(fit_rows).select("v").collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    x = np.array([r["v"] for r in sample])
    half = (x.shape[1] + 1) // 2
    books = [kmeans(x[:, :half], k, seed), kmeans(x[:, half:], k, seed)] if x.shape[1] > 1 else [
        kmeans(x, k, seed), np.zeros((1, 0))]
    wide = len(books[1])

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array(b["v"].tolist()).reshape(len(b), -1)
            if len(b):
                b["cell"] = squared(m[:, :half], books[0]).argmin(1) * wide + squared(m[:, half:], books[1]).argmin(1)
                yield b

    index = materialize(rows.mapInPandas(codes, "vec_id long, v array<double>, cell long"))
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()       # at most k * k rows
    sizes = np.zeros((len(books[0]), wide), dtype=np.int64)
    for r in counts:
        sizes[divmod(r["cell"], wide)] = r["n"]
    want = max(int(np.ceil(probe * sizes.sum())), top + 1)
    parts = {int(r["cell"]): -(-r["n"] // part_rows) for r in counts}

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, v in zip(b["vec_id"], b["v"]):
                m = np.asarray(v)[None]
                cells = nearest_cells(squared(m[:, :half], books[0])[0], squared(m[:, half:], books[1])[0], sizes, want)
                at = [(a * wide + c, p) for a, c in cells for p in range(parts[a * wide + c])]
                yield pd.DataFrame({"query_id": q, "q": [v] * len(at), "cell": [c for c, _ in at], "part": [p for _, p in at]})

    part_of = F.pmod(F.xxhash64("vec_id", "v"), F.element_at(
        F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv]), F.col("cell"))).cast("int")
    asking = index.where(queries(F.col("vec_id"))).select("vec_id", "v")
    chunks = max(1, -(-asking.count() // ask_rows))
    meet = ["cell", "part", "chunk"]
    listed = index.withColumn("part", part_of).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(*meet)
    asked = asking.mapInPandas(visits, "query_id long, q array<double>, cell long, part int").withColumn(
        "chunk", F.pmod(F.xxhash64("query_id", "q"), F.lit(chunks)).cast("int"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, m = right["vec_id"].to_numpy(), np.array(right["v"].tolist())
            repeated = len(np.unique(ids)) < len(ids)
            for q, v in zip(left["query_id"], left["q"]):
                d = np.sqrt(((m - np.asarray(v)[None]) ** 2).sum(1))
                keep = np.flatnonzero(ids != q)
                best = keep[np.lexsort((ids[keep], d[keep]))]
                if repeated:                     # each id at its nearest
                    best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
                best = best[:top]
                out["query_id"] += [q] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += d[best].tolist()
        return pd.DataFrame(out)

    near = (asked.groupBy(*meet).cogroup(listed.groupBy(*meet))
            .applyInPandas(rerank, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # a vec_id repeated with other vectors may stand in several parts
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
