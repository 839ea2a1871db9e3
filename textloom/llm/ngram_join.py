"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct ``words``-word shingles (64-bit hashes). Two
documents link when 100 * intersection >= 85 * union.

1. Candidates. In the sorted hashes of a set, each three neighbours are a gram. A
   shingle of r alone breaks at most three grams of r, one of s alone at most two, so
   sets that link share all but D(|r|) grams of r, and the D + 1 smallest grams of
   each must meet. Equal sets have one node. Nodes that share a gram form candidate
   groups (connected components); a group holds every partner of its members, while
   passages that many texts share rarely fill three neighbouring hashes alike. Tasks
   join the nodes of a batch first, so a gram leaves a batch once and a node has one
   link there, however many copies or near copies a batch holds. Large groups are split
   by grams of other hash orders.
2. Search. In a group, the sets of one block are an inverted index and others query
   it. A query needs at least T = ceil(0.85 |r|) common shingles with any partner.
   DivideSkip leaves the L longest lists out, heap-merges the short ones, skipping ids
   that can't reach T - L, and probes the long lists by binary search for the ids
   that did; those that reach the exact overlap of the pair are links.
3. Components of the links.

``linked`` finds every link and counts those of each row. ``near_duplicates`` only needs the
components, so a query that is already connected with an id passes over it. Its groups above a block (``block`` sets, ``SHINGLES`` shingles) are cut: all members query a hash-chosen pivot block
first, in parallel chunks. Only where a group is still in several parts are the sets
outside its largest part indexed in further blocks, with pairs inside one part
skipped. No pair between parts is left out, and no task holds more than two blocks.

Defined cases: null texts and texts without words have an empty set and link with
nothing; rows with equal sets are one group; repeated rows each get their row; the
component of rows that have no doc_id at all is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_side
from textloom.llm.graph import components

#: Links need at least PERCENT of the union in common.
PERCENT = 85
#: Sets in an index block, and in a chunk of queries.
BLOCK = 1500
#: Shingles in a block, as its sets are held by one task.
SHINGLES = 2_000_000
#: Grams that a task joins at a time.
GRAMS = 400_000
#: Neighbouring hashes of a sorted set that make a gram.
GRAM = 3
#: Constant of DivideSkip's rule for the number of long lists.
MU = 0.0085
#: Up to so many ids (about 100 bytes each as a hash table) are broadcast to find their texts.
MANY_IDS = 200_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _weigh(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for i, p in enumerate(parts):
        out = out * _K[1] + p * _K[i % 4]
    return _mix(out)


def shingle_sets(texts: list[str | None], words: int = 4, at_once: int = 400_000) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are hashed for many texts at
    a time."""
    def flush(docs):
        flat = [w for d in docs for w in d]
        hashes = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, dtype=np.uint64)
        grams = _weigh([hashes[i:len(hashes) - words + 1 + i] for i in range(words)]) if len(flat) >= words else None
        at = 0
        for d in docs:
            n = len(d)
            if n >= words:
                yield np.unique(grams[at:at + n - words + 1])
            elif n:
                yield _weigh([hashes[i:i + 1] for i in range(at, at + n)] + [np.full(1, n, dtype=np.uint64)])
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += n

    docs, held = [], 0
    for t in texts:
        d = t.encode().lower().split() if t else []      # bytes: ASCII case, ASCII blanks
        docs.append(d)
        held += len(d)
        if held >= at_once:
            yield from flush(docs)
            docs, held = [], 0
    yield from flush(docs)


def digest(s: np.ndarray) -> str | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None


def node_of(d: str) -> int:
    return int(d[:15], 16)


def most_broken(n: int, percent: int = PERCENT, gram: int = GRAM) -> int:
    """Most grams of a set of ``n`` that a linked set can break: a shingles of its own
    break ``gram`` each, b of the other one ``gram - 1`` each."""
    a = np.arange(0, (100 - percent) * n // 100 + 1)
    return int((gram * a + (gram - 1) * (((100 - percent) * n - 100 * a) // percent)).max())


def signatures(s: np.ndarray, order: int = 0) -> np.ndarray:
    """The grams of a set by which every linked set must meet it. ``order`` picks the
    hash by which the set is sorted."""
    if (100 - PERCENT) * len(s) < PERCENT:       # too short to link with another set
        return s[:0]
    if order:
        s = np.sort(_mix(s ^ np.uint64(order)))
    grams = _weigh([s[i:len(s) - GRAM + 1 + i] for i in range(GRAM)])
    most = most_broken(len(s))
    return np.partition(grams, most)[:most + 1]


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, ``h`` (hash of the text), ``n`` (set size) and ``digest`` (null for an empty
    set) of every row."""
    def run(batches):
        for b in batches:
            sets = [(len(s), digest(s)) for s in shingle_sets(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array([n for n, _ in sets], pa.int64()),
                 pa.array([d for _, d in sets], pa.string())], ["doc_id", "h", "n", "digest"])
    return _keyed(docs).mapInArrow(run, "doc_id long, h long, n long, digest string")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id, or of none, apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def join_batch(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes joined where they share a signature: distinct nodes and the least node of
    their part, and distinct signatures with the part that has them."""
    names, at = np.unique(nodes, return_inverse=True)
    order = np.lexsort((at, sigs))
    sigs, at = sigs[order], at[order]
    starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
    counts = np.diff(np.append(starts, len(sigs)))
    part = np.arange(len(names))
    shared = np.repeat(counts > 1, counts)       # the others join nothing
    some = at[shared]
    first = np.append(0, np.cumsum(counts[counts > 1]))[:-1]
    while len(some):
        least = np.repeat(np.minimum.reduceat(part[some], first), counts[counts > 1])
        new = part.copy()
        np.minimum.at(new, part[some], least)    # a part moves as a whole
        new = new[new]
        if np.array_equal(new, part):
            break
        part = new
    return names, names[part], sigs[starts], names[part[at[starts]]]


def candidate_groups(texts: DataFrame, order: int = 0) -> DataFrame:
    """(node, grp): nodes that share a signature, by connected group; ``texts`` has text
    and ``old``, a group from before within which signatures must meet."""
    def flush(sigs, nodes):
        names, parts, sig, owner = join_batch(np.concatenate(sigs), np.concatenate(nodes))
        own = names != parts
        n = int(own.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(sig, np.zeros(n, np.int64)), mask=np.append(np.zeros(len(sig), bool), np.ones(n, bool))),
             pa.array(np.append(owner, names[own])),
             pa.array(np.append(owner, parts[own]))], ["sig", "node", "part"])

    def run(batches):
        sigs, nodes, held = [], [], 0
        for b in batches:
            for s, old in zip(shingle_sets(b.column("text").to_pylist()), b.column("old").to_pylist()):
                g = signatures(s, order)
                if len(g):
                    sigs.append((g ^ _mix(np.array([old], dtype=np.int64).view(np.uint64))).view(np.int64))
                    nodes.append(np.full(len(g), node_of(digest(s))))
                    held += len(g)
                    if held >= GRAMS:
                        yield flush(sigs, nodes)
                        sigs, nodes, held = [], [], 0
        if sigs:
            yield flush(sigs, nodes)

    # a row with a signature, or without one a link inside a batch
    rows = texts.select("old", "text").mapInArrow(run, "sig long, node long, part long")
    least = F.when(F.col("sig").isNull(), F.col("part")).otherwise(F.min("node").over(Window.partitionBy("sig", F.when(
        F.col("sig").isNull(), F.col("node")))))
    met = materialize(rows.withColumn("least", least).where("least < node").select("node", "least").distinct())
    # one link a node, to the least it meets; the others it meets are linked to that one
    first = met.groupBy("node").agg(F.min("least").alias("first"))
    others = met.join(first, "node").where("first < least").select(F.col("least").alias("a"), F.col("first").alias("b")).distinct()
    links = first.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(others)
    return components(links).select("node", F.col("component").alias("grp"))


def candidates(docs: DataFrame, table: DataFrame, block: int) -> DataFrame:
    """(doc_id, h, digest, copies, grp, g, cuts): the sets that have candidates, one row each with
    a row that holds it, the rows of that set, their group, its size and the blocks it fills.

    Among very many sets, chance meetings chain strangers to one large group. Linked
    sets meet in any hash order, so groups above a block are split by signatures of
    further orders, as long as that makes them smaller."""
    classes = (table.where("digest is not null").groupBy("digest")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")).alias("r"), F.max("n").alias("n"),
                    F.count(F.lit(1)).alias("copies"))
               .select("digest", "r.doc_id", "r.h", "n", "copies")
               .withColumn("node", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")))

    def sized(groups: DataFrame) -> DataFrame:
        of = classes.join(groups, "node").select("doc_id", "h", "digest", "grp", "n", "copies")
        cuts = F.ceil(F.greatest(F.col("g") / block, F.col("m") / SHINGLES)).cast("int")
        sizes = (of.groupBy("grp").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("m")).where("g > 1")
                 .select("grp", "g", cuts.alias("cuts")))
        return materialize(of.drop("n").join(sizes, "grp"))

    found = sized(candidate_groups(docs.select(F.lit(0).cast("long").alias("old"), "text")))
    done, order, before = [], 0, None
    while True:
        large = found.where("cuts > 1")
        n = large.count()
        if n == 0 or (before is not None and n > 0.9 * before):
            return reduce(DataFrame.unionByName, [*done, found])
        done.append(found.where("cuts <= 1"))
        before, order = n, order + 1
        texts = _texts(docs, large.select("doc_id", "h", F.col("grp").alias("old")))
        found = sized(candidate_groups(texts, order))


class InvertedIndex:
    """Inverted lists of a block of sets; ids are their places in the block."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))
        self.ids = array("i", owner[order].astype(np.int32).tobytes())

    def search(self, query: np.ndarray, passed, after):
        """Ids that reach the overlap for a link with ``query``, in order.

        ``passed(id)``: the id needs no answer; ``after(id)``: the next id that does, or
        None. Both may change between answers."""
        n = len(query)
        need = -(-PERCENT * n // 100)
        if not len(self.tokens):
            return
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < need:
            return
        lens = self.ends[at] - self.starts[at]
        at = at[np.argsort(lens, kind="stable")]
        starts, ends = self.starts[at].tolist(), self.ends[at].tolist()
        longest = ends[-1] - starts[-1]
        n_long = min(need - 1, int(need / (MU * log2(max(longest, 2)) + 1)))
        n_short = len(starts) - n_long
        short, reach = list(range(n_short)), need - n_long
        ids = self.ids
        place = starts[:n_short]
        heap = [(ids[starts[k]], k) for k in short]
        heapq.heapify(heap)

        def move(k: int, target: int) -> None:   # list k on to the first id >= target
            place[k] = bisect_left(ids, target, place[k], ends[k])
            if place[k] < ends[k]:
                heapq.heappush(heap, (ids[place[k]], k))

        while len(heap) >= reach:
            top = heap[0][0]
            if passed(top):
                target = after(top)
                if target is None:
                    return
                while heap and heap[0][0] < target:
                    move(heapq.heappop(heap)[1], target)
                continue
            same = []
            while heap and heap[0][0] == top:
                same.append(heapq.heappop(heap)[1])
            if len(same) >= reach:
                exact = -(-PERCENT * (n + self.sizes[top]) // (100 + PERCENT))
                got, left = len(same), n_long
                for k in range(n_short, len(starts)):
                    if got + left < exact:
                        break
                    left -= 1
                    p = bisect_left(ids, top, starts[k], ends[k])
                    got += p < ends[k] and ids[p] == top
                if got >= exact:
                    yield top
                for k in same:
                    move(k, top + 1)
            else:                                # ids below the next top can't reach it
                while heap and len(same) < reach - 1:
                    same.append(heapq.heappop(heap)[1])
                if not heap:
                    return
                for k in same:
                    move(k, max(heap[0][0], top + 1))


class Parts:
    """Union-find over the sets of a block."""

    def __init__(self, labels: list) -> None:
        self.up = list(range(len(labels)))
        first: dict = {}
        for i, x in enumerate(labels):
            if x is not None:
                self.join(first.setdefault(x, i), i)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def block_links(sets: list[np.ndarray], index: list[int], queries: list[int], labels: list,
                every: bool = False) -> list[tuple[int, int]]:
    """Links that connect ``queries`` with ``index`` (places in ``sets``). Sets with one
    label are known to be connected and passed over, unless ``every`` link is asked for."""
    # neighbours in the order of their least hash are mostly copies, so known ones come in runs
    index, queries = (sorted(x, key=lambda i: (int(sets[i][0]), len(sets[i]))) for x in (index, queries))
    lists, parts, found = InvertedIndex([sets[i] for i in index]), Parts(labels), []
    place = {i: k for k, i in enumerate(index)}
    for q in queries:
        # two members of the index meet once, when the later one asks
        until = place.get(q, len(index))

        def after(k: int) -> int | None:
            if every:
                return k + 1 if k + 1 < until else None
            root = parts.find(q)
            for j in range(k + 1, until):
                if parts.find(index[j]) != root:
                    return j
            return None

        def passed(k: int) -> bool:
            return k >= until or (not every and parts.find(index[k]) == parts.find(q))

        if after(-1) is None:
            continue
        for k in lists.search(sets[q], passed, after):
            parts.join(q, index[k])
            found.append((q, index[k]))
    return found


def _in_blocks(docs: DataFrame, roles: DataFrame, answer, schema: str) -> DataFrame:
    """Rows of ``answer(names, sets, index, queries, labels)`` for each block of ``roles`` (doc_id, h,
    digest, block, asks, answers, label): names are digests, index and queries places in them."""
    def one(rows: list[tuple]) -> pd.DataFrame:
        seen: dict[str, int] = {}
        sets_, asks, answers, labels = [], [], [], []
        for ask, answers_, label, d, s in rows:
            if d in seen:                        # a repeated row, or both roles apart
                i = seen[d]
            else:
                i = seen[d] = len(sets_)
                sets_.append(np.frombuffer(s, dtype=np.uint64))
                labels.append(label)
            asks += [i] if ask else []
            answers += [i] if answers_ else []
        return answer(list(seen), sets_, sorted(set(answers)), sorted(set(asks)), labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, rows = None, []
        for b in batches:
            for key, *row in zip(b["block"], b["asks"], b["answers"], b["label"], b["digest"], b["s"]):
                if key != block and rows:
                    yield one(rows)
                    rows = []
                block = key
                rows.append(tuple(row))
        if rows:
            yield one(rows)

    roles = materialize(roles)
    sets = _with_sets(docs, roles.select("doc_id", "h", "digest").distinct())
    placed = sets.join(small_side(roles.drop("doc_id", "h"), MANY_IDS), "digest")
    return (placed.repartition("block").sortWithinPartitions("block", "digest")
            .select("block", "asks", "answers", "label", "digest", "s").mapInPandas(run, schema))


def _links(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """(a, b) digests of the links that connect the sets of each block."""
    def pairs(names, sets, index, queries, labels):
        return pd.DataFrame([(names[i], names[j]) for i, j in block_links(sets, index, queries, labels)], columns=["a", "b"])
    return _in_blocks(docs, roles, pairs, "a string, b string")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (doc_id, h, ...) with the text of their row; repeated rows come again."""
    names = [c for c in members.columns if c not in ("doc_id", "h")]
    members = small_side(materialize(members.withColumnsRenamed({"doc_id": "__d", "h": "__h"})), MANY_IDS)
    return (_keyed(docs).join(members, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d")))
            .select("text", *names))


def _with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(digest, s) of ``members`` (doc_id, h, digest): the hashes of their sets."""
    def run(batches):
        for b in batches:
            want = b.column("digest").to_pylist()
            got = [(d, s.tobytes()) for d, s in zip(want, shingle_sets(b.column("text").to_pylist())) if digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.string()), pa.array([s for _, s in got], pa.binary())], ["digest", "s"])
    return _texts(docs, members).select("text", "digest").mapInArrow(run, "digest string, s binary")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, ``n``, ``digest`` and ``part`` (the component's least digest; null for an
    empty set) of every row of ``docs`` (doc_id, text)."""
    table = materialize(set_table(docs))
    sized = candidates(docs, table, block)
    cuts = F.col("cuts")
    chunk = F.pmod(F.xxhash64(F.lit(1), "digest"), cuts).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit(2), "digest"), cuts) == 0
    key = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    none = F.lit(None).cast("string").alias("label")
    # small groups: one block, all ask and answer; large ones: pivots answer in each chunk
    asking = sized.select("doc_id", "h", "digest", key(F.col("grp"), chunk).alias("block"), F.lit(True).alias("asks"),
                          pivot.alias("answers"), none)
    pivots = (sized.where(pivot & (cuts > 1)).withColumn("c", F.explode(F.sequence(F.lit(0), cuts - 1)))
              .where(F.col("c") != chunk)
              .select("doc_id", "h", "digest", key(F.col("grp"), F.col("c")).alias("block"), F.lit(False).alias("asks"),
                      F.lit(True).alias("answers"), none))
    links = materialize(_links(docs, asking.unionByName(pivots)))
    parts = components(links).select(F.col("node").alias("digest"), F.col("component").alias("part"))
    large = sized.where("cuts > 1")
    if not large.isEmpty():
        links = materialize(links.unionByName(_second_pass(docs, large, parts, key)))
        parts = components(links).select(F.col("node").alias("digest"), F.col("component").alias("part"))
    return table.join(parts, "digest", "left").select("doc_id", "n", "digest", F.coalesce("part", "digest").alias("part"))


def _second_pass(docs: DataFrame, large: DataFrame, parts: DataFrame, key) -> DataFrame:
    """Links between the parts into which the pivots left a large group."""
    at = materialize(large.join(parts, "digest", "left").withColumn("label", F.coalesce("part", "digest")).drop("part"))
    most = (at.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("grp").agg(F.max(F.struct("k", "label")).alias("m"))
            .select("grp", F.col("m.k").alias("k"), F.col("m.label").alias("main")))
    open_ = at.join(most, "grp").where("k < g")
    rows = F.col("cuts")
    cols = F.ceil((F.col("g") - F.col("k")) * rows / F.col("g")).cast("int")
    me = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "digest"), n).cast("int")
    asks = (open_.withColumn("c", F.explode(F.sequence(F.lit(0), cols - 1)))
            .select("doc_id", "h", "digest", key(F.col("grp"), me(3, rows), F.col("c")).alias("block"),
                    F.lit(True).alias("asks"), F.lit(False).alias("answers"), "label"))
    answers = (open_.where("label <> main").withColumn("r", F.explode(F.sequence(F.lit(0), rows - 1)))
               .select("doc_id", "h", "digest", key(F.col("grp"), F.col("r"), me(4, cols)).alias("block"),
                       F.lit(False).alias("asks"), F.lit(True).alias("answers"), "label"))
    return _links(docs, asks.unionByName(answers))


def _two_chunks(sized: DataFrame) -> DataFrame:
    """Blocks in which each two sets of a group meet once; the label of a set is its number
    of rows. A group above a block is cut into chunks, and each two chunks are a block, so
    no task holds more than two."""
    cuts = F.greatest("cuts", F.lit(1))
    of = sized.withColumn("me", F.pmod(F.xxhash64(F.lit(5), "digest"), cuts).cast("int"))
    of = of.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    lo, hi = F.least("me", "other"), F.greatest("me", "other")
    block = F.concat_ws(":", *[c.cast("string") for c in (F.col("grp"), lo, hi)])
    return of.select("doc_id", "h", "digest", block.alias("block"), (F.col("me") == lo).alias("asks"),
                     (F.col("me") == hi).alias("answers"), F.col("copies").alias("label"))


def class_links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): every link between two different sets, by digest, each once with a < b."""
    def pairs(names, sets, index, queries, labels):
        found = block_links(sets, index, queries, [None] * len(sets), every=True)
        return pd.DataFrame([sorted((names[i], names[j])) for i, j in found], columns=["a", "b"])
    sized = candidates(docs, materialize(set_table(docs)), block)
    return _in_blocks(docs, _two_chunks(sized), pairs, "a string, b string")


def linked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, ``n``, ``digest``, ``part`` (as ``near_duplicates``) and ``links`` of every row of
    ``docs``: the other rows that a row links with, rows of an equal set included; 0 for an
    empty set. Links are counted inside their block; a block sends each set's count and
    the links that join its parts, not all pairs."""
    def counted(names, sets, index, queries, copies):
        found = block_links(sets, index, queries, [None] * len(sets), every=True)
        links, parts, rows = [0] * len(sets), Parts([None] * len(sets)), []
        for i, j in found:
            links[i] += copies[j]
            links[j] += copies[i]
            if parts.find(i) != parts.find(j):
                parts.join(i, j)
                rows.append((names[i], names[j], 0))
        rows += [(names[i], None, k) for i, k in enumerate(links) if k]
        return pd.DataFrame(rows, columns=["a", "b", "links"])

    table = materialize(set_table(docs))
    found = materialize(_in_blocks(docs, _two_chunks(candidates(docs, table, block)), counted, "a string, b string, links long"))
    parts = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("digest"), F.col("component").alias("part"))
    more = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("more"))
    size = table.where("digest is not null").groupBy("digest").agg((F.count(F.lit(1)) - 1).alias("same"))
    of = size.join(more, "digest", "left").join(parts, "digest", "left")
    return table.join(of, "digest", "left").select(
        "doc_id", "n", "digest", F.coalesce("part", "digest").alias("part"),
        (F.coalesce("same", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))


def component_ids(found: DataFrame) -> DataFrame:
    """doc_id, n, component_id (and ``links`` where they were counted) from the rows of
    ``near_duplicates`` or ``linked``; the component is the least doc_id of the part, and of
    an empty set its own doc_id."""
    more = [c for c in found.columns if c == "links"]
    least = found.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("first"))
    return (found.join(least, "part", "left")
            .select("doc_id", "n", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), *more))


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of linked rows: that of the least doc_id (then digest),
    with all columns; texts without words all stay. Where doc_id is unique, rows are
    dropped by an anti-join on it; null and repeated ids are settled by digest."""
    found = materialize(near_duplicates(docs.select("doc_id", "text"), block))
    full = found.where("part is not null")
    first = full.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "digest")).alias("f"))
    first = first.select("part", F.col("f.doc_id").alias("__d1"), F.col("f.digest").alias("__g1"))
    odd = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or doc_id is null").select("doc_id"))
    drop = (full.join(first, "part").where(~F.col("doc_id").eqNullSafe(F.col("__d1"))).select("doc_id"))
    out = materialize(drop.unionByName(odd).distinct().select(F.col("doc_id").alias("__d")))
    id_ = F.col("doc_id").cast("long")
    rest = docs.join(small_side(out, MANY_IDS), id_.eqNullSafe(F.col("__d")), "left_anti")
    if odd.isEmpty():
        return rest

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(s) for s in shingle_sets(list(texts))], dtype=object)

    some = (docs.join(small_side(odd.select(F.col("doc_id").alias("__d")), MANY_IDS), id_.eqNullSafe(F.col("__d")), "left_semi")
            .withColumn("__g", digests("text")))
    kept = first.select("__d1", "__g1")
    one = (some.join(kept, id_.eqNullSafe(F.col("__d1")) & (F.col("__g") == F.col("__g1")), "left_semi")
           .dropDuplicates(["doc_id", "__g"]))
    return rest.unionByName(one.drop("__g")).unionByName(some.where("__g is null").drop("__g"))
