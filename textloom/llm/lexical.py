"""Ranked lexical search with per-term geometric blocks.

Terms are runs of ASCII letters, digits and all code points from U+0080 on, with A-Z
lower-cased. The score of a document for an item is the sum over the item's terms of
``weight(term) * share(tf, length)``, all in whole numbers (``term_weight``, ``shares``).

1. The items, in blocks of bounded size, give the terms that count. One scan of the texts
   keeps for each document its length and the counts of those terms, packed, and
   aggregates tell N, L and the document frequencies.
2. Documents are indexed in chunks, and every item searches every chunk. A chunk has one
   posting list a term. Lists above ``BLOCK`` documents are clustered: some of the list's
   documents are pivots, each document joins the pivot with the nearest sketch (a seeded
   projection of its weighted vector), and each cluster is a block whose summary holds,
   coordinate by coordinate, the largest share of its documents. Only coordinates that
   items with this term can ask for are stored, and a list is blocked when it is first
   needed.
3. An item visits its terms from the largest possible part of a score to the smallest. A
   document is due in the list of its first such term, so a block's bound is the sum of
   weight * summary over the terms from this one on. A block is skipped only when its
   bound is below the item's ``top``-th best score so far, and a search ends when the same
   sum over the whole chunk's maxima is. Both are exact, and ties are never skipped, so
   the result is that of a full scan.
4. Each task keeps its ``top`` rows of an item and their least score, which is a lower
   bound for the whole; rows below the largest such bound are dropped before the ranking.

Defined cases: null texts and texts without terms are no documents (they don't count in
N); rows without doc_id rank last among equals; repeated rows are documents of their
own; an item is a distinct (item_id, text), null texts and texts without terms give no
rows; equal scores go to the smaller doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_side

#: Documents of a posting list in a block, on average.
BLOCK = 64
#: Documents in a chunk, and cells of its (term, document) table.
CHUNK, CELLS = 4096, 16_000_000
#: Bytes of item texts that are searched together.
ITEM_BYTES = 1_000_000
SKETCH = 16
_SPLIT = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in _SPLIT)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, length: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    m = 75 + (25 * length * n_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n (terms), ids and tf (packed 32-bit numbers of the vocabulary's terms) of every
    document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)   # at most ITEM_BYTES of terms

    def run(batches):
        get = shared.value.get
        for b in batches:
            at, sizes, ids, tfs = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                words = terms(t)
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    at.append(i)
                    sizes.append(len(words))
                    ids.append(np.fromiter(found.keys(), dtype="<i4", count=len(found)).tobytes())
                    tfs.append(np.fromiter(found.values(), dtype="<i4", count=len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc", "n", "ids", "tf"])
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "doc long, n long, ids binary, tf binary")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(_unpack(b.column("ids")), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "df"])
    out = np.zeros(size, dtype=np.int64)
    for r in index.select("ids").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r["t"]] = r["df"]                    # a row a term of the items
    return out


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4")


class Item:
    """One query: its terms with weight times repeats."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray) -> None:
        self.terms = np.array(sorted(counts), dtype=np.int64)
        self.weights = np.array([counts[t] for t in self.terms.tolist()], dtype=np.int64) * weights[self.terms]


class Chunk:
    """Posting lists of a chunk of documents; ``table`` is (term, document) -> share."""

    def __init__(self, table: np.ndarray, wanted: dict[int, np.ndarray], weights: np.ndarray, block: int = BLOCK) -> None:
        self.table, self.wanted, self.block = table, wanted, block
        self.most = table.max(axis=1).astype(np.int64)
        self.blocks: dict[int, tuple] = {}
        self._weights, self._sketch = weights, None

    def sketch(self) -> np.ndarray:
        if self._sketch is None:
            signs = np.random.default_rng(17).choice(np.array([-1, 1], dtype=np.float32), (len(self.table), SKETCH))
            signs *= self._weights[:, None].astype(np.float32)
            z = sum(self.table[i:i + 512].T.astype(np.float32) @ signs[i:i + 512] for i in range(0, len(self.table), 512))
            self._sketch = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-30)
        return self._sketch

    def blocks_of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the term's list in the order of its blocks, where blocks start,
        and summaries (wanted coordinates x blocks)."""
        if term not in self.blocks:
            docs = np.flatnonzero(self.table[term])
            n = -(-len(docs) // self.block)
            if n > 1:
                z = self.sketch()[docs]
                pivots = z[np.random.default_rng(term).choice(len(docs), n, replace=False)]
                near = (z @ pivots.T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                starts = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            else:
                starts = np.zeros(1, dtype=np.int64)
            summary = np.maximum.reduceat(self.table[self.wanted[term]][:, docs], starts, axis=1)
            self.blocks[term] = docs, starts, summary
        return self.blocks[term]


class Best:
    """The ``top`` best (score, key) of an item so far."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores, self.keys = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float64)
        self.docs = np.zeros(0, dtype=np.int64)

    def bar(self) -> int:
        """A score that a further document must reach (1: any score counts)."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        ok = scores >= self.bar()
        if ok.any():
            s, d, x = (np.concatenate(p) for p in ((self.scores, scores[ok]), (self.docs, docs[ok]), (self.keys, missing[ok])))
            order = np.lexsort((d, x, -s))[:self.top]
            self.scores, self.docs, self.keys = s[order], d[order], x[order]


def visit(item: Item, chunk: Chunk, best: Best, docs: np.ndarray, missing: np.ndarray) -> int:
    """Add the item's best documents of the chunk to ``best``. Returns how many documents
    were scored."""
    part = item.weights * chunk.most[item.terms]
    order = np.argsort(-part, kind="stable")
    order = order[part[order] > 0]
    if not len(order):
        return 0
    ids, weights = item.terms[order], item.weights[order]
    left = np.cumsum(part[order][::-1])[::-1]    # the most that the terms from here on can add
    rows = chunk.table[ids]
    done = np.zeros(rows.shape[1], dtype=bool)
    for i, term in enumerate(ids.tolist()):
        if left[i] < best.bar():
            break
        listed, starts, summary = chunk.blocks_of(term)
        at = np.searchsorted(chunk.wanted[term], ids[i:])
        bounds = weights[i:] @ summary[at]
        ends = np.append(starts[1:], len(listed))
        queue = np.argsort(-bounds, kind="stable")
        while len(queue):
            queue = queue[bounds[queue] >= best.bar()]
            now, queue = queue[:4], queue[4:]    # a few at a time, as the bar rises
            if not len(now):
                break
            some = np.concatenate([listed[starts[b]:ends[b]] for b in now])
            some = some[~done[some]]
            done[some] = True
            best.add(weights @ rows[:, some], docs[some], missing[some])
    return int(done.sum())


def search_block(docs: DataFrame, items: list[tuple], key: str, text: str, top: int) -> DataFrame:
    """item (place in ``items``), doc, score: candidates that hold the ``top`` of each item."""
    spark = docs.sparkSession
    counts = [Counter(terms(t)) for _, t in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    size = len(vocabulary)
    index = materialize(forward_index(docs, vocabulary, key, text))
    all_ = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, all_terms = all_["n"], all_["l"] or 1
    df = document_frequencies(index, size)
    weights = np.array([term_weight(n_docs, int(x)) for x in df], dtype=np.int64)
    asked = [Item({vocabulary[w]: k for w, k in c.items()}, weights) for c in counts]
    users: dict[int, list[np.ndarray]] = {}
    for item in asked:
        for t in item.terms.tolist():
            users.setdefault(t, []).append(item.terms)
    wanted = {t: np.unique(np.concatenate(x)) for t, x in users.items()}
    shared = spark.sparkContext.broadcast((asked, wanted, weights))  # of the items alone
    step = max(64, min(CHUNK, CELLS // max(size, 1)))

    def run(batches):
        asked, wanted, weights = shared.value
        best = [Best(top) for _ in asked]
        for b in batches:
            for start in range(0, b.num_rows, step):
                c = b.slice(start, step)
                lists = c.column("ids").to_pylist()
                ids, tf = _unpack(c.column("ids")).astype(np.int64), _unpack(c.column("tf")).astype(np.int64)
                owner = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
                length = c.column("n").to_numpy()
                table = np.zeros((size, len(lists)), dtype=np.int32)
                table[ids, owner] = shares(tf, length[owner], n_docs, all_terms)
                chunk = Chunk(table, wanted, weights)
                missing = c.column("doc").is_null().to_numpy(zero_copy_only=False).astype(np.float64)
                doc = c.column("doc").fill_null(0).to_numpy()
                for item, mine in zip(asked, best):
                    visit(item, chunk, mine, doc, missing)
        out = [(i, None if x else d, s, m.bar()) for i, m in enumerate(best)
               for d, s, x in zip(m.docs.tolist(), m.scores.tolist(), m.keys.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                         [pa.array([], pa.int64())] * 4, ["item", "doc", "score", "bar"])
    return index.mapInArrow(run, "item long, doc long, score long, bar long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = materialize(items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text"))
                        .where(F.col(item_text).isNotNull()).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    found = []
    for k in range(n):                           # blocks of about ITEM_BYTES
        block = [(r["item"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]
        block = sorted((x for x in block if terms(x[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if block:
            names = F.broadcast(spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], "item long, item_id long"))
            rows = materialize(search_block(docs, block, key, text, top))
            bars = small_side(rows.groupBy("item").agg(F.max("bar").alias("most")))
            rows = rows.join(bars, "item").where(F.col("score") >= F.col("most"))
            w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
            found.append(rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(names, "item")
                         .select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
