"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups (equal texts) must stay whole. Their total sizes are aggregated in Spark to runs,
(size, number of groups of that size); that list, as long as there are distinct sizes, is
all the driver holds, at any number of documents. The runs, largest first, enter bins
through a balanced search tree: the bin with the tightest remaining capacity that still
fits takes a group, and as it stays the tightest one, as many of the run as fit. That is
best-fit decreasing on the groups one by one. A run gives its bins in stretches, and the
groups of one size get theirs by their rank among them.

Defined cases: null text counts as empty text; equal texts (and repeated rows)
share a shard; a group larger than an even share gets a shard of its own, and the
others are evened out among the remaining shards; groups of one size are ranked by a
hash of their text; very long texts are groups like others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, number_rows, small_side


class BinTree:
    """Treap over (remaining capacity, bin): expected logarithmic insert, remove
    and smallest-key-not-below search. Priorities are a hash of the bin."""

    def __init__(self) -> None:
        self.root: list | None = None            # [key, priority, left, right]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        """Nodes with keys below ``key``, and the rest."""
        if t is None:
            return None, None
        if t[0] < key:
            low, high = self._split(t[3], key)
            t[3] = low
            return t, high
        low, high = self._split(t[2], key)
        t[2] = high
        return low, t

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = [key, zlib.crc32(b"%d" % key[1]), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return the smallest key with remaining capacity >= ``need``."""
        low, high = self._split(self.root, (need, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._merge(low, rest)
        return first[0]


Run = tuple[int, int]


def best_fit_decreasing(runs: Sequence[Run], capacity: int, max_bins: int | None = None
                        ) -> list[list[Run]] | None:
    """Stretches (groups, bin) of each run (size, groups); None as soon as more than
    ``max_bins`` bins are needed or a group exceeds the capacity."""
    out: list[list[Run]] = [[] for _ in runs]
    tree, n = BinTree(), 0
    for i in sorted(range(len(runs)), key=lambda j: -runs[j][0]):
        size, left = runs[i]
        if left and size > capacity:
            return None
        while left:
            hit = tree.pop_tightest(size)
            if hit is None:
                if max_bins is not None and n >= max_bins:
                    return None
                hit, n = (capacity, n), n + 1
            k = min(left, hit[0] // size) if size else left
            out[i].append((k, hit[1]))
            tree.insert((hit[0] - k * size, hit[1]))
            left -= k
    return out


def pack_even(runs: Sequence[Run], n_bins: int) -> list[list[Run]]:
    """Stretches in bins 0 .. n_bins-1 under a smallest fixed capacity for which best-fit
    decreasing needs no more than ``n_bins``. Groups above an even share of what is left
    get a bin of their own first."""
    order = sorted(range(len(runs)), key=lambda j: -runs[j][0])
    out: list[list[Run]] = [[] for _ in runs]
    count = [c for _, c in runs]
    used, left = 0, sum(s * c for s, c in runs)
    for i in order:
        while count[i] and used < n_bins - 1 and runs[i][0] * (n_bins - used) > left:
            out[i].append((1, used))
            used, left, count[i] = used + 1, left - runs[i][0], count[i] - 1
        if count[i]:
            break
    rest = [(runs[i][0], count[i]) for i in order]
    if not any(c for _, c in rest):
        return out
    k = n_bins - used
    low, step = max(-(-left // k), max(s for s, c in rest if c)), 1
    high, best = low, best_fit_decreasing(rest, low, k)
    while best is None:                          # an even share rarely fails by much
        low, high, step = high + 1, high + step, 2 * step
        best = best_fit_decreasing(rest, high, k)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(rest, mid, k)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    for i, stretches in zip(order, best):
        out[i] += [(c, used + b) for c, b in stretches]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("__g")))
    groups = materialize(rows.groupBy("__g").agg(F.sum("size").alias("__w")))
    runs = [(r["__w"], r["n"]) for r in groups.groupBy("__w").agg(F.count(F.lit(1)).alias("n")).orderBy("__w").collect()]
    ends = []
    for (size, _), stretches in zip(runs, pack_even(runs, n_shards)):
        at, mine = 0, []
        for k, b in stretches:
            at += k
            mine.append((at, b))
        ends.append((size, mine))
    bins = small_side(spark.createDataFrame(ends, "__w long, __b array<struct<end:long,bin:int>>"))
    ranked = number_rows(groups, ["__w"], ["__g"], "__i").join(bins, "__w")
    # the stretch that a rank falls in: the first one that ends above it
    placed = ranked.select("__g", F.filter("__b", lambda b: b["end"] > F.col("__i"))[0]["bin"].alias("shard"))
    sharded = rows.join(placed, "__g")
    numbered = number_rows(materialize(sharded.select("doc_id", "size", "text_crc32", "__g", "shard")),
                           ["shard"], ["doc_id", "__g"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")
