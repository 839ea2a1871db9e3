"""Vector operators on ``array<float>`` columns.

Row-local maths (cosine, euclidean, normalisation, pooling) are higher-order
array expressions whose lambdas only read their own parameters. Set-level
similarity search is exact and blocked:

* ``top_k_neighbours`` / ``similarity_edges``: all-pairs over one table. Rows
  go to the nearest of a few pivots, and the cell of a pivot is cut into blocks
  by bytes. The triangle inequality bounds the distance of two blocks from
  below by their pivots' distance and the least and greatest distance of their
  rows to them; a pair of blocks that can't hold a neighbour is never formed.
  For the top-k every block is first scored by itself, so its worst k-th
  distance is known. Every other pair of blocks is one group, scored with one
  matrix product inside ``applyInPandas``, that emits only each row's top-k (or
  the pairs above a threshold); a final per-row top-k uses Spark's partial
  ``WindowGroupLimit``. For Euclidean distances the product only bounds them
  (``near``): few pairs are measured, and a row brings along its k-th distance
  within its block, beyond which it takes no pair.
* ``rank_against``: query blocks against corpus blocks, one cogrouped task per
  pair of blocks; ranks per query are distributed prefix counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import near as NR
from textloom.operators.common import evaluate_once, materialize
from textloom.operators.ordering import ordered_prefix


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vsum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a, b) -> Column:
    """Cosine similarity (null when a vector has zero norm)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(dot(a, b) / den)


def euclidean(a, b) -> Column:
    """Euclidean distance, negative squared sums clipped to 0."""
    sq = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                                * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), sq))


def scale(v, factor_col: str) -> Column:
    """Multiply every element by a per-row scalar column (an attribute)."""
    return F.transform(_c(v), lambda x: x.cast("double") * F.col(factor_col))


def l2_normalize(df: DataFrame, vec: str, out_col: str | None = None) -> DataFrame:
    """Unit vectors; the norm is computed once per row, then applied. A zero vector gives nulls."""
    out_col = out_col or vec
    d = evaluate_once(df.withColumn("_inv", F.try_divide(F.lit(1.0), norm(vec))), "_inv")
    return d.withColumn(out_col, scale(vec, "_inv")).drop("_inv")


def l1_normalize(df: DataFrame, vec: str, out_col: str | None = None) -> DataFrame:
    """Divide a vector by its sum (not its norm); null when the sum is zero."""
    out_col = out_col or vec
    d = evaluate_once(df.withColumn("_s", vsum(vec)), "_s")
    return d.withColumn(out_col, F.when(F.col("_s") == 0, F.lit(None)).otherwise(
        F.transform(vec, lambda x: x.cast("double") / F.col("_s")))).drop("_s")


def mean_vector(df: DataFrame, group_cols, vec: str, weight: Column | None = None,
                out_col: str = "mean", min_den: float = 1e-9) -> DataFrame:
    """Weighted (masked) mean per group: sum(v * w) / max(sum(w), min_den). Each
    partition keeps one running vector per group (``Summarizer``), so rows are not
    blown up by dimension."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = list(group_cols)
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    rows = df.select(*g, array_to_vector(to_double(vec)).alias("_x"), w.alias("_w"))
    # Summarizer ignores rows of weight 0 and divides by the sum of weights
    agg = rows.groupBy(*g).agg(Summarizer.mean(F.col("_x"), F.col("_w")).alias("_m"), F.sum("_w").alias("_sw"))
    scale_by = F.col("_sw") / F.greatest(F.col("_sw"), F.lit(min_den))
    return agg.select(*g, F.transform(vector_to_array("_m"), lambda x: x * scale_by).alias(out_col))


def sphereize(df: DataFrame, vec: str, out_col: str | None = None) -> DataFrame:
    """Subtract the corpus centroid and L2-normalise each vector. The centroid is a
    one-row aggregate joined in the plan. One row: returned unchanged."""
    out_col = out_col or vec
    one = F.lit(1).alias("_one")
    centre = mean_vector(df.select(F.col(vec), one), ["_one"], vec, out_col="_c")
    count = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(centre.join(count, "_one")), "_one")
    unit = l2_normalize(j.withColumn("_v", F.zip_with(vec, "_c", lambda x, m: x.cast("double") - m)), "_v")
    return unit.withColumn(out_col, F.when(F.col("_n") > 1, F.col("_v")).otherwise(to_double(vec))).drop(
        "_one", "_c", "_n", "_v")


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


#: Bytes of vectors (as doubles) in a block, and of a strip of scores.
BLOCK_BYTES = 16 << 20
STRIP_BYTES = 32 << 20


def _n_blocks(df: DataFrame, vec: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes``, from one aggregate over the vector sizes."""
    total = df.agg(F.sum(F.size(vec).cast("long") * 8)).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


#: Most pivots, and vectors of the hash sample they are picked from: all that the driver sees.
PIVOTS, PIVOT_SAMPLE = 128, 2048
#: Added to a distance bound, far above rounding errors.
SLACK = 1e-6


def _metric(q: np.ndarray, c: np.ndarray, cos: bool) -> np.ndarray:
    """Distances that obey the triangle inequality: angles, or Euclidean distances."""
    return np.arccos(np.clip(_unit_rows(q) @ _unit_rows(c).T, -1.0, 1.0)) if cos else _distances(q, c)


def _in_space(m: np.ndarray, cos: bool) -> np.ndarray:
    """Rows with a place in the metric space: finite and, for angles, not zero."""
    ok = np.isfinite(m).all(axis=1)
    return ok & (m != 0).any(axis=1) if cos else ok


def _spread_out(m: np.ndarray, n: int, cos: bool) -> np.ndarray:
    """Up to ``n`` distinct rows of ``m``, each the farthest from those before it."""
    if not len(m):
        return m
    picked, d = [0], _metric(m[:1], m, cos)[0]
    while len(picked) < n and d.max() > SLACK:
        picked.append(int(d.argmax()))
        d = np.minimum(d, _metric(m[picked[-1:]], m, cos)[0])
    return m[picked]


def metric_blocks(df: DataFrame, id_col: str, vec: str, block_bytes: int, cos: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(id, vec, blk)`` and, when there are several blocks, ``(a, b, bound)`` for each two
    blocks a < b: no row of a is nearer than ``bound`` to a row of b. Rows without a place
    in the space have blocks of their own, with bounds of no force."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    n_blocks = _n_blocks(rows, "vec", block_bytes)
    if n_blocks == 1:
        return rows.withColumn("blk", F.lit("0:0")), None
    sample = _stack(rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(PIVOT_SAMPLE).toPandas()["vec"])
    pivots = _spread_out(sample[_in_space(sample, cos)], min(n_blocks, PIVOTS), cos)
    n = len(pivots)                              # also the cell of rows without a place

    def nearest(batches):
        for b in batches:
            m = _stack(b["vec"])
            ok = _in_space(m, cos) if len(b) else np.zeros(0, dtype=bool)
            cell, d = np.full(len(b), n), np.zeros(len(b))
            if n and ok.any():
                all_ = _metric(pivots, m[ok], cos)
                cell[ok], d[ok] = all_.argmin(axis=0), all_.min(axis=0)
            yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "cell": cell, "d": d})

    kind = rows.schema["vec"].dataType.simpleString()
    at = materialize(rows.mapInPandas(nearest, f"id {rows.schema['id'].dataType.simpleString()}, vec {kind}, cell int, d double"))
    cuts = at.groupBy("cell").agg(F.ceil(F.sum(F.size("vec").cast("long") * 8) / block_bytes).alias("cuts"))
    part = F.pmod(F.xxhash64("id"), F.greatest("cuts", F.lit(1)))
    cut = at.join(F.broadcast(cuts), "cell").withColumn("blk", F.concat_ws(":", F.col("cell").cast("string"), part.cast("string")))
    blocks = cut.groupBy("blk", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    blocks = materialize(blocks.withColumn("hi", F.when(F.col("cell") == n, F.lit(math.inf)).otherwise(F.col("hi"))))
    x, y = np.indices((n + 1, n + 1))
    far = np.zeros((n + 1, n + 1))
    if n:
        far[:n, :n] = _metric(pivots, pivots, cos)
    apart = df.sparkSession.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "far": far.ravel()}),
                                            "x int, y int, far double")
    side = lambda c, cell: blocks.select(F.col("blk").alias(c), F.col("cell").alias(cell), F.col("lo").alias(f"lo_{c}"),
                                         F.col("hi").alias(f"hi_{c}"))
    bound = F.greatest(F.col("far") - F.col("hi_a") - F.col("hi_b"), F.col("lo_a") - F.col("far") - F.col("hi_b"),
                       F.col("lo_b") - F.col("far") - F.col("hi_a"))
    pairs = side("a", "x").join(F.broadcast(apart), "x").join(side("b", "y"), "y").where("a < b")
    return cut.select("id", "vec", "blk"), pairs.select("a", "b", bound.alias("bound"))


def _paired(rows: DataFrame, pairs: DataFrame):
    """Rows grouped by the pairs of blocks that hold them."""
    pairs = pairs.select("a", "b")
    left = rows.join(pairs, F.col("blk") == F.col("a"))
    right = rows.join(pairs.where("a <> b"), F.col("blk") == F.col("b"))
    return left.unionByName(right).groupBy("a", "b")


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances from direct differences: no cancellation for near vectors."""
    return np.sqrt(np.stack([((c - row) ** 2).sum(1) for row in q])) if len(q) else np.zeros((0, len(c)))


def _smallest(key: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite keys of each row, ties to smaller ids."""
    k = min(k, key.shape[1])
    edge = np.partition(key, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero((key <= edge[:, None]) & np.isfinite(key))
    order = np.lexsort((ids[c], key[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)                # start of each row's run
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def _best_of_block(qi, qm, ci, cm, k: int, cos: bool) -> list[pd.DataFrame]:
    """The k nearest of a block for each query row, in strips of bounded size."""
    out = []
    qn, cn = (_unit_rows(qm), _unit_rows(cm)) if cos else (qm, cm)
    strip = max(1, STRIP_BYTES // (8 * max(1, len(ci))))
    for at in range(0, len(qi) if len(ci) else 0, strip):
        q, ids = qn[at:at + strip], qi[at:at + strip]
        s = q @ cn.T if cos else _distances(q, cn)
        key = np.where(ids[:, None] == ci[None, :], np.inf, -s if cos else s)  # self excluded
        r, c = _smallest(key, ci, k)
        out.append(pd.DataFrame({"id": ids[r], "nbr": ci[c], "sim": s[r, c]}))
    return out


def top_k_neighbours(df: DataFrame, k: int = 10, id_col: str = "id", vec: str = "vec",
                     block_bytes: int = BLOCK_BYTES, metric: str = "cosine") -> DataFrame:
    """Exact top-k most similar other rows per row: ``(id, nbr, rank, sim)``.
    ``metric`` is ``cosine`` (descending) or ``euclidean`` (ascending distance).
    Blocks are sized by bytes; a row is copied once for each pair of blocks that may hold
    a neighbour."""
    cos = metric == "cosine"
    rows, pairs = metric_blocks(df, id_col, vec, block_bytes, cos)
    schema = "id long, nbr long, sim double"
    order = F.desc("sim") if cos else F.asc("sim")
    w = Window.partitionBy("id").orderBy(order, F.asc("nbr"))
    none = pd.DataFrame({"id": pd.Series([], dtype="int64"), "nbr": pd.Series([], dtype="int64"),
                         "sim": pd.Series([], dtype="float64")})

    def score_block(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = pdf["id"].to_numpy(), _stack(pdf["vec"])
        out = _best_of_block(ids, m, ids, m, k, cos) if cos else NR.nearest(ids, m, k)
        return pd.concat(out, ignore_index=True).assign(blk=pdf["blk"].iloc[0]) if out else none.assign(blk="")

    def score_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        here = (pdf["blk"] == pdf["a"]).to_numpy()
        ids, m = pdf["id"].to_numpy(), _stack(pdf["vec"])
        if cos:
            sides = [(ids[x], m[x], ids[~x], m[~x]) for x in (here, ~here)]
            out = [p for side in sides for p in _best_of_block(*side, k, cos)]
        else:
            most = pdf["kth"].fillna(math.inf).to_numpy()
            out = NR.nearest_between(ids[here], m[here], most[here], ids[~here], m[~here], most[~here], k)
        return pd.concat(out, ignore_index=True) if out else none

    own = rows.groupBy("blk").applyInPandas(score_block, schema + ", blk string")
    cand = own.drop("blk")
    if pairs is not None:
        own = materialize(own)
        needed = pairs_needed(rows, own, pairs, k, cos)
        if not cos:
            known = own.groupBy("blk", "id").agg(F.max("sim").alias("kth"), F.count(F.lit(1)).alias("met")).where(F.col("met") >= k)
            rows = rows.join(known.select("blk", "id", "kth"), ["blk", "id"], "left")
        cand = own.drop("blk").unionByName(_paired(rows, needed).applyInPandas(score_pair, schema))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("id", "nbr", "rank", "sim"))


def pairs_needed(rows: DataFrame, own: DataFrame, pairs: DataFrame, k: int, cos: bool) -> DataFrame:
    """The pairs of blocks whose bound doesn't exceed the worst k-th distance of a row in
    one of them, as ``own`` (each block scored by itself) has it; a row with fewer than k
    neighbours in its block needs every pair."""
    d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim")))) if cos else F.col("sim")
    kth = own.groupBy("blk", "id").agg(F.when(F.count(F.lit(1)) >= k, F.max(d)).otherwise(F.lit(math.inf)).alias("kth"))
    kth = kth.groupBy("blk").agg(F.max("kth").alias("kth"), F.count(F.lit(1)).alias("met"))
    worst = materialize(rows.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).join(kth, "blk", "left").select(
        "blk", F.when(F.col("met") == F.col("n"), F.col("kth")).otherwise(F.lit(math.inf)).alias("kth")))
    of = lambda c: worst.select(F.col("blk").alias(c), F.col("kth").alias(f"kth_{c}"))
    most = F.greatest("kth_a", "kth_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("bound") <= most + SLACK * (1 + most)).select("a", "b")


def similarity_edges(df: DataFrame, threshold: float = 0.6, id_col: str = "id", vec: str = "vec",
                     block_bytes: int = BLOCK_BYTES // 8) -> DataFrame:
    """All pairs ``src < dst`` with cosine similarity above ``threshold``."""
    rows, pairs = metric_blocks(df, id_col, vec, block_bytes, True)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        here = (pdf["blk"] == pdf["a"]).to_numpy()
        own = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        left, right = pdf[here], pdf if own else pdf[~here]
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        if len(li) == 0 or len(ri) == 0:
            return pd.DataFrame({"src": [], "dst": [], "weight": []}).astype(
                {"src": "int64", "dst": "int64", "weight": "float64"})
        s = _unit_rows(_stack(left["vec"])) @ _unit_rows(_stack(right["vec"])).T
        a, b = np.nonzero(s > threshold)
        src, dst, wt = li[a], ri[b], s[a, b]
        keep = src < dst if own else src != dst
        src, dst, wt = src[keep], dst[keep], wt[keep]
        lo, hi = np.minimum(src, dst), np.maximum(src, dst)
        return pd.DataFrame({"src": lo, "dst": hi, "weight": wt})

    if pairs is None:
        grouped = rows.withColumns({"a": F.col("blk"), "b": F.col("blk")}).groupBy("a", "b")
    else:
        most = math.acos(max(-1.0, min(1.0, threshold)))
        within = rows.select(F.col("blk").alias("a"), F.col("blk").alias("b")).distinct()
        grouped = _paired(rows, pairs.where(F.col("bound") <= most + SLACK).select("a", "b").unionByName(within))
    return grouped.applyInPandas(edges, "src long, dst long, weight double")


def rank_against(queries: DataFrame, corpus: DataFrame, q_id: str = "qid", q_vec: str = "qvec",
                 id_col: str = "id", vec: str = "vec", exclude_self: bool = True,
                 unit_queries: bool = True, block_bytes: int = BLOCK_BYTES // 4) -> DataFrame:
    """Score every corpus row against every query, in blocks:
    ``(qid, id, sim, dist)`` with cosine ``sim`` and euclidean ``dist``. Queries
    and corpus are both cut into blocks by bytes and each pair of blocks is one
    cogrouped task, so neither side passes through the driver."""
    q = queries.select(F.col(q_id).alias("qid"), F.col(q_vec).alias("qvec"))
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    nq, nc = _n_blocks(q, "qvec", block_bytes // 8), _n_blocks(c, "vec", block_bytes)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(nq))).withColumn("bc", every(nc))
    right = c.withColumn("bc", F.pmod(F.xxhash64("id"), F.lit(nc))).withColumn("bq", every(nq))

    def score(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({"qid": [], "id": [], "sim": [], "dist": []})
        q_ids, ids = lp["qid"].to_numpy(), rp["id"].to_numpy()
        qm, m = _stack(lp["qvec"]), _stack(rp["vec"])
        sim = _unit_rows(m) @ (_unit_rows(qm) if unit_queries else qm).T
        dist = _distances(qm, m).T
        out = pd.DataFrame({"qid": np.repeat(q_ids[None, :], len(ids), 0).ravel(),
                            "id": np.repeat(ids, len(q_ids)), "sim": sim.ravel(), "dist": dist.ravel()})
        return out[out["qid"] != out["id"]] if exclude_self else out

    return (left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc"))
            .applyInPandas(score, "qid long, id long, sim double, dist double"))


def ranked(scored: DataFrame, by: str = "sim", descending: bool = True, rank_col: str = "rank",
           group: str = "qid", tie: str = "id") -> DataFrame:
    """Distributed per-query rank of a scored table (ties by id)."""
    return ordered_prefix(scored, [by, tie], group_cols=[group], rank_col=rank_col, descending=descending)


def layer_combine(layers: str, mode: str, top_n: int = 4) -> Column:
    """Combine the top-n layer vectors of a token (``array<array<double>>``):
    concat, average, sum, last, second_last; another mode gives null."""
    top = F.slice(F.col(layers), -top_n, top_n)
    if mode == "concat":
        return F.flatten(top)
    if mode in ("average", "sum"):
        zero = F.transform(F.element_at(top, 1), lambda x: F.lit(0.0))
        total = F.aggregate(top, zero, lambda acc, l: F.zip_with(acc, l, lambda a, b: a + b))
        return total if mode == "sum" else F.transform(total, lambda x: x / top_n)
    if mode == "last":
        return F.element_at(F.col(layers), -1)
    if mode == "second_last":
        return F.element_at(F.col(layers), -2)
    return F.lit(None).cast("array<double>")


def nbow(tf: DataFrame, group_cols, term: str = "term", tf_col: str = "tf") -> DataFrame:
    """nBOW weights ln(1 + tf) normalised to sum 1 within each document."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    known = tf.where(" and ".join(f"`{c}` is not null" for c in g))
    w = known.withColumn("_l", F.log1p(F.col(tf_col)))
    return w.withColumn("weight", F.col("_l") / F.sum("_l").over(Window.partitionBy(*g))).drop("_l")


def _accuracy(pairs: DataFrame, n: str) -> DataFrame:
    """Pairs (l, p) in the arrays ``z`` and the share of equal ones; counted row by row, then
    summed. A pair with a null is no hit and no miss."""
    of = lambda test: F.size(F.filter("z", test)).cast("long")
    rows = evaluate_once(pairs, "z").select(F.size("z").cast("long").alias("n"), of(lambda z: z["l"] == z["p"]).alias("hit"),
                                            of(lambda z: (z["l"] == z["p"]).isNotNull()).alias("told"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(n),
                    F.round(F.try_divide(F.sum("hit").cast("double"), F.sum("told").cast("double")), 6).alias("accuracy"))


def mlm_accuracy(df: DataFrame, labels: str, preds: str) -> DataFrame:
    """Share of positions with label != -100 whose prediction is right."""
    z = F.arrays_zip(F.col(labels).alias("l"), F.col(preds).alias("p"))
    z = F.filter(z, lambda x: x["l"] != -100)
    return _accuracy(df.select(z.alias("z")).where("z is not null"), "n_selected")


def clm_accuracy(df: DataFrame, labels: str, preds: str) -> DataFrame:
    """Next-token accuracy: labels from position 1 against predictions up to n-1."""
    n = F.size(F.col(labels))
    lab = F.slice(F.col(labels), 2, F.greatest(n - 1, F.lit(0)))
    pre = F.slice(F.col(preds), 1, F.greatest(n - 1, F.lit(0)))
    return _accuracy(df.select(F.arrays_zip(lab.alias("l"), pre.alias("p")).alias("z")).where("z is not null"), "n")


def align_vectors(vocab: DataFrame, pretrained: DataFrame, dim: int, seed: int = 42,
                  word: str = "word", vec: str = "v") -> DataFrame:
    """Vocabulary left join pretrained vectors; a word without one gets
    U(-sqrt(3/d), +sqrt(3/d)) per dimension from a hash of (seed, word, i)."""
    bound = math.sqrt(3.0 / dim)
    rnd = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.col(word), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) * 2 - 1) * bound)
    j = vocab.join(pretrained.select(word, F.transform(vec, lambda x: x.cast("double")).alias("_pv")), word, "left")
    return j.withColumn("pretrained", F.col("_pv").isNotNull()).withColumn("vec", F.coalesce("_pv", rnd)).drop("_pv")
