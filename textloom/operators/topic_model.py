"""Latent topics by expectation maximisation, with every table of the model in Spark.

The model is mixtures of words with Dirichlet priors: p(word | doc) = sum over topics of
theta(doc, topic) * phi(topic, word). Documents are dealt into blocks of bounded tokens and words
into parts; the counts of a block are packed once in few bytes each. In a pass a part sends each
block the probabilities of its words as one value, a task shares the counts of its block out among the topics
and sends each part one value back, which it adds up. So what moves is a number a topic for each word
of a block, no row of it and no word. What a pass left on disk goes when the next has ended. Neither the
vocabulary nor a topic-by-word matrix reaches the driver,
which sees one number a pass, the objective. That never falls, as each pass is an exact step of
expectation maximisation for the posterior mode.

Rows without an id, null words and empty documents take no part. Starts are hashes of
(seed, word, topic), so a retried task draws the same."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.common import discard, materialize, packed, unpacked, with_one_row, without_shuffle_files
from textloom.operators.vocab import lookup

#: Tokens in a block, and counts that a task takes at a time.
BLOCK_COUNTS, AT_ONCE = 2_000_000, 250_000
#: Words of all blocks that a part sends, and parts at least.
PART_WORDS, PARTS = 2_000_000, 8


def _cols(name: str, k: int) -> list[str]:
    return [f"{name}{i}" for i in range(k)]


def _vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(word, part, pos) of every word, a part's words numbered in order; and the number of
    blocks."""
    words = materialize(docs.select(F.explode("tokens").alias("word")).where("word is not null").groupBy("word").agg(
        F.count(F.lit(1)).alias("n")))
    seen = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    blocks = max(1, ceil((seen.n or 0) / BLOCK_COUNTS))
    parts = max(PARTS, ceil(seen.words * blocks / PART_WORDS))
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part")
    dealt = words.select("word", part).withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1)
    out = materialize(dealt)
    discard(words)
    return out, blocks


def _blocks(docs: DataFrame, words: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each block of documents: its docs and how ``many`` words each has, the ids of its
    words, and the places ``w`` among them and the numbers ``n`` of the counts, document by document.
    A task packs the documents that it has looked up, so they don't move again."""
    ids = words.select("word", (F.col("part").cast("long") * (1 << 32) + F.col("pos")).alias("id"))
    tasks = max(n_blocks, docs.sparkSession.sparkContext.defaultParallelism)
    found = lookup(docs, ids, "id", "doc", "tokens", "ids").coalesce(tasks)

    def block(blk: int, docs_: list, of_doc: list) -> pd.DataFrame:
        d = np.repeat(np.arange(len(of_doc)), [len(x) for x in of_doc])
        kept, w = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *of_doc]), return_inverse=True)
        key, n = np.unique(d * max(1, len(kept)) + w, return_counts=True)
        d, w = np.divmod(key, max(1, len(kept)))
        return pd.DataFrame([(blk, docs_, packed(np.bincount(d, minlength=len(of_doc))), kept.tobytes(), packed(w), packed(n))],
                            columns=["blk", "docs", "many", "ids", "w", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blk, docs_, of_doc, held = TaskContext.get().partitionId(), [], [], 0
        for b in batches:
            for doc, x in zip(b["doc"].tolist(), b["ids"]):
                x = np.asarray(x, dtype=np.float64)
                x = x[~np.isnan(x)].astype(np.int64)                  # null words are NaN
                if not len(x):
                    continue
                docs_.append(doc)
                of_doc.append(x)
                held += len(x)
                if held >= BLOCK_COUNTS:
                    yield block(blk, docs_, of_doc)
                    blk, docs_, of_doc, held = blk + tasks, [], [], 0
        if held:
            yield block(blk, docs_, of_doc)
    kind = docs.schema["doc"].dataType.simpleString()
    return found.mapInPandas(run, f"blk int, docs array<{kind}>, many binary, ids binary, w binary, n binary")


def _members(blocks: DataFrame) -> DataFrame:
    """(blk, part, pos): the places in a part of the block's words of that part, in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blk, ids in zip(b["blk"], b["ids"]):
                ids = np.frombuffer(ids, np.int64)
                part, first = np.unique(ids >> 32, return_index=True)
                pos = [(x & 0xFFFFFFFF).astype(np.uint32).tobytes() for x in np.split(ids, first[1:])] if len(ids) else []
                yield pd.DataFrame({"blk": np.full(len(part), blk, dtype=np.int32), "part": part.astype(np.int32), "pos": pos})
    return blocks.select("blk", "ids").mapInPandas(run, "blk int, part int, pos binary")


def _with_totals(parts: DataFrame, k: int) -> DataFrame:
    """The parts with the totals ``t`` of the topics over all parts and the number ``all`` of words."""
    total = parts.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(k)]).alias("t"), F.sum("words").alias("all"))
    return with_one_row(parts.select("part", "v"), total)


def _phi(v: bytes, t: np.ndarray, n: int, k: int, eta: float) -> np.ndarray:
    """Each topic's probability of a part's words, from their counts ``v``, the topics' totals and
    the number of all words; a topic's probabilities sum to 1 over all parts."""
    return (np.frombuffer(v).reshape(-1, k) + eta) / (np.asarray(t) + n * eta)


_PARTS = "part int, v binary, sums array<double>, words long"
_SENT = "blk int, part int, rows binary, lp double"
_STATE = "blk int, part int, rows binary, ll double, lq double, lp double"


def _first(words: DataFrame, k: int, seed: int) -> DataFrame:
    """The parts before the first pass: counts are seeded hashes of the words."""
    def draw(i: int) -> Column:                  # exponential, so a word's start is a uniform mixture
        bits = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{i}"), "word")), 1, 8)
        return -F.log((F.conv(bits, 16, 10).cast("double") + 1) / float((1 << 32) + 1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("pos")[_cols("v", k)].to_numpy(dtype=np.float64)
        return _part(int(rows["part"].iloc[0]), v)
    return words.select("part", "pos", *[draw(i).alias(f"v{i}") for i in range(k)]).groupBy("part").applyInPandas(run, _PARTS)


def _part(part: int, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(part, np.ascontiguousarray(v).tobytes(), v.sum(0).tolist(), len(v))], columns=["part", "v", "sums", "words"])


def _sent(parts: DataFrame, members: DataFrame, k: int, eta: float) -> DataFrame:
    """What each part sends: to a block the probabilities of its words, and to none the sum of the
    logarithms of all its probabilities."""
    def run(key: tuple, own: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        p = _phi(own["v"].iloc[0], own["t"].iloc[0], own["all"].iloc[0], k, eta)
        out = [(blk, key[0], p[np.frombuffer(pos, np.uint32)].tobytes(), None) for blk, pos in zip(to["blk"], to["pos"])]
        return pd.DataFrame([*out, (-1, key[0], None, float(np.log(p).sum()))], columns=["blk", "part", "rows", "lp"]).astype({"lp": float})
    return _with_totals(parts, k).groupBy("part").cogroup(members.groupBy("part")).applyInPandas(run, _SENT)


def _one_pass(blocks: DataFrame, sent: DataFrame, shares: DataFrame | None, n_blocks: int, k: int, alpha: float) -> DataFrame:
    """What each block sends: to a part the counts of its words by topic, and to none (part -1) its
    documents' shares after the pass, with the log-likelihood ``ll`` and the sum ``lq`` of the shares'
    logarithms before it. No ``shares``: all topics alike. The sums ``lp`` of the parts are handed on."""
    def one(blk: int, b, q: bytes | None, probs: list) -> pd.DataFrame:
        many = unpacked(b.many, int(b.n_docs))
        total_ = int(many.sum())
        w, d, n = unpacked(b.w, total_), np.repeat(np.arange(len(many)), many), unpacked(b.n, total_).astype(np.float64)
        probs.sort()
        phi = np.concatenate([np.zeros((0, k)), *[np.frombuffer(x).reshape(-1, k) for _, x in probs]])
        q = np.full((len(many), k), 1 / k) if q is None else np.frombuffer(q).reshape(-1, k)
        by_word, by_doc, ll = np.zeros_like(phi), np.zeros((len(many), k)), 0.0
        for at in range(0, len(w), AT_ONCE):
            w_, d_, n_ = w[at:at + AT_ONCE], d[at:at + AT_ONCE], n[at:at + AT_ONCE]
            x = phi[w_] * q[d_]
            total = x.sum(1)
            ll += float((n_ * np.log(total)).sum())
            x *= (n_ / total)[:, None]
            for i in range(k):
                by_word[:, i] += np.bincount(w_, x[:, i], len(phi))
                by_doc[:, i] += np.bincount(d_, x[:, i], len(many))
        after = (by_doc + alpha) / (by_doc.sum(1, keepdims=True) + k * alpha)
        ends = np.cumsum([0, *[len(x) // (8 * k) for _, x in probs]])
        out = [(blk, part, by_word[i:j].tobytes(), None, None, None) for (part, _), i, j in zip(probs, ends, ends[1:])]
        return pd.DataFrame([*out, (blk, -1, after.tobytes(), ll, float(np.log(q).sum()), None)],
                            columns=["blk", "part", "rows", "ll", "lq", "lp"]).astype({c: float for c in ("ll", "lq", "lp")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for b in batches:
            for r in b.itertuples(index=False):
                if r.blk < 0:
                    yield pd.DataFrame([(-1, r.part, None, np.nan, np.nan, r.lp)], columns=["blk", "part", "rows", "ll", "lq", "lp"])
                    continue
                own = found.setdefault(int(r.blk), {"probs": [], "q": None})
                if r.many is not None:
                    own["b"] = r
                elif r.part < 0:
                    own["q"] = r.rows
                else:
                    own["probs"].append((int(r.part), r.rows))
        for blk in sorted(found):
            yield one(blk, **found.pop(blk))

    packed_ = blocks.select("blk", F.size("docs").alias("n_docs"), "many", "w", "n")
    both = packed_.unionByName(sent, allowMissingColumns=True)
    if shares is not None:
        both = both.unionByName(shares.select("blk", "part", "rows"), allowMissingColumns=True)
    # a task for each block; what goes to none is dealt out
    to = F.when(F.col("blk") >= 0, F.col("blk")).otherwise(F.pmod("part", F.lit(n_blocks)))
    return both.repartitionById(n_blocks, to.cast("int")).mapInPandas(run, _STATE)


def _added(state: DataFrame, members: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """The parts after a pass: the counts that the blocks sent, added up in order of the blocks."""
    sizes = parts.select("part", "words")
    sent = state.where("part >= 0 and blk >= 0").select("part", "blk", "rows")
    both = sent.withColumn("pos", F.lit(None).cast("binary")).unionByName(
        members.select("part", "blk", F.lit(None).cast("binary").alias("rows"), "pos"))

    def run(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((int(own["words"].iloc[0]), k))
        at = {blk: pos for blk, pos in zip(rows["blk"], rows["pos"]) if pos is not None}
        for blk, x in sorted((blk, x) for blk, x in zip(rows["blk"], rows["rows"]) if x is not None):
            v[np.frombuffer(at[blk], np.uint32)] += np.frombuffer(x).reshape(-1, k)
        return _part(int(key[0]), v)
    return sizes.groupBy("part").cogroup(both.groupBy("part")).applyInPandas(run, _PARTS)


def theta(blocks: DataFrame, shares: DataFrame | None, k: int) -> DataFrame:
    """(doc, q0, ..): each document's share of the topics, from the rows of its block."""
    def run(batches):
        for b in batches:
            for docs, q in zip(b["docs"], b["q"]):
                m = np.full((len(docs), k), 1 / k) if q is None else np.frombuffer(q, np.float64).reshape(len(docs), k)
                yield pd.DataFrame(m, columns=_cols("q", k)).assign(doc=docs)[["doc", *_cols("q", k)]]
    held = (blocks.withColumn("q", F.lit(None).cast("binary")) if shares is None else
            blocks.join(shares.select("blk", F.col("rows").alias("q")), "blk"))
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    return held.select("docs", "q").mapInPandas(run, f"doc {kind}, " + ", ".join(f"q{i} double" for i in range(k)))


def phi(words: DataFrame, parts: DataFrame, k: int, eta: float) -> DataFrame:
    """(word, p0, ..): each topic's probability of the word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                p = pd.DataFrame(_phi(r.v, r.t, r.all, k, eta), columns=_cols("p", k))
                yield p.assign(part=r.part, pos=np.arange(len(p)))
    of = _with_totals(parts, k).mapInPandas(run, ", ".join(f"p{i} double" for i in range(k)) + ", part int, pos int")
    return words.join(of, ["part", "pos"]).select("word", *_cols("p", k))


def train(docs: DataFrame, k: int = 4, passes: int = 20, tol: float = 1e-4, seed: int = 42, alpha: float = 0.1,
          eta: float = 0.01, id_col: str = "doc_id", tokens: str = "tokens",
          trace: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(word, p0, ..)`` and ``(doc, q0, ..)`` after ``passes`` passes, or fewer once the
    objective grows by less than ``tol`` of itself; ``trace`` receives the objective
    (log-likelihood and log-priors) before each pass."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(tokens).alias("tokens")).where("doc is not null")
    with without_shuffle_files(docs.sparkSession):
        words, n_blocks = _vocabulary(docs)
        blocks = materialize(_blocks(docs, words, n_blocks))
        n_blocks = 1 + (blocks.agg(F.max("blk")).first()[0] or 0)
        members = materialize(_members(blocks))
        parts = materialize(_first(words, k, seed))
        state, shares, before = None, None, None
        for _ in range(passes):
            new = materialize(_one_pass(blocks, _sent(parts, members, k, eta), shares, n_blocks, k, alpha))
            added = materialize(_added(new, members, parts, k))
            for old in (state, parts):
                if old is not None:
                    discard(old)
            state, parts = new, added
            shares = state.where("part = -1 and blk >= 0")
            sums = state.agg(F.sum("ll"), F.sum("lq"), F.sum("lp")).first()
            ll, of_docs, of_words = [x or 0.0 for x in sums]
            now = ll + eta * of_words + alpha * of_docs
            if trace is not None:
                trace.append(now)
            if before is not None and now - before < tol * abs(before):
                break
            before = now
    return phi(words, parts, k, eta), theta(blocks, shares, k)


def top_words(p: DataFrame, k: int, n: int = 10) -> DataFrame:
    """(topic, rank, word): each topic's ``n`` likeliest words from rank 0, ties by word."""
    long = p.select("word", F.posexplode(F.array(*_cols("p", k))).alias("topic", "_p"))
    w = Window.partitionBy("topic").orderBy(F.desc("_p"), "word")
    return long.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n).select("topic", "rank", "word")
