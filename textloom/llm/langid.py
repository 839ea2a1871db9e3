"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased letters with one space for each run of other characters, and
``ORDER - 1`` spaces before the first. Each language has one model of order ``ORDER``:

    P_k(c | h) = max(n(hc) - D, 0) / n(h.) + lambda(h) P_{k-1}(c | h without its first letter)

where n counts occurrences at the highest order and distinct left extensions below it, D
comes from the counts of counts of that order and language, and the unigram is
interpolated with a uniform distribution over all letters seen. Counts come from every
learning row: tasks add up windows batch by batch, Spark adds up the rest, and all lower
orders are aggregates of the highest one.

A model is four sorted arrays, keys (64-bit hashes of order and letters) and values, for
the discounted shares and for the back-off weights. They are broadcast, at most
``max_entries`` windows a language: beyond that, the windows of order 3 and more below
a count (a power of two) are left to the back-off, their mass included. 31 letters have no
more than a million windows of order 4, and a language uses a small part of those it
could, so alphabets stay whole; the bound is met by scripts of thousands of signs.

A text gets the language of the lowest cross-entropy a character. ``score`` is the
probability that this is right, a logistic of the log evidence against the runner-up;
``accepted`` is false where the cross-entropy lies beyond all but ``reject`` of the texts of
that language. Both are calibrated on every learning text: the rows are dealt into two
halves, and each half is scored with models of the other. The driver sees counts of rounded
evidence and a row a language.

Defined cases: null texts and texts without letters are "und" with score 0; so are all
texts if nothing was learned; null languages don't teach, an empty one is a language like
others; rows without doc_id are predicted as any other, whether they teach is up to the
condition; ties go to the smaller language; memory grows with the longest text; repeated
rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

ORDER = 4
#: Characters that are taken together.
AT_ONCE = 1_000_000
MAX_ENTRIES = 1_000_000
UNKNOWN = "und"
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0; made once in a worker."""
    if not _letters:
        t = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                t[i] = ord(c.lower()[0])
        _letters.append(t)
    return _letters[0]


def windows(texts: list[str | None], order: int = ORDER, at_once: int = AT_ONCE
            ) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Parts of the texts that hold letters: their places in ``texts``, how many windows
    each has, and the windows, one row of code points each."""
    space = np.uint32(32)

    def flush(held):
        at, sizes, parts = [], [], []
        for i, t in held:
            c = letters()[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]
            some = c != 0
            if some.any():
                keep = some.copy()
                keep[1:] |= some[:-1]            # the first other character after a letter
                c = c[keep]
                c[c == 0] = space
                if c[-1] != space:
                    c = np.append(c, space)
                at.append(i)
                sizes.append(len(c))
                parts += [np.full(order - 1, space, dtype=np.uint32), c]
        if at:
            flat = np.concatenate(parts)
            own = np.concatenate([np.arange(n) + start for n, start in zip(
                sizes, np.cumsum([0] + [n + order - 1 for n in sizes[:-1]]))])
            yield at, np.array(sizes), np.stack([flat[own + k] for k in range(order)], axis=1)

    held, size = [], 0
    for i, t in enumerate(texts):
        if t:
            held.append((i, t))
            size += len(t)
            if size >= at_once:
                yield from flush(held)
                held, size = [], 0
    yield from flush(held)


def fold(w: np.ndarray, tag: int) -> np.ndarray:
    """64-bit hashes of the rows of ``w``."""
    x = np.full(len(w), (tag + 1) * 0xC2B2AE3D27D4EB4F % 2 ** 64, dtype=np.uint64)
    for k in range(w.shape[1]):
        x = (x ^ w[:, k]) * _K
        x ^= x >> np.uint64(29)
    x *= _M
    return x ^ (x >> np.uint64(32))


def _distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``w``, and which of them each row is."""
    codes, uniques = pd.factorize(fold(w, 0))
    first = np.empty(len(uniques), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(w) - 1, -1, -1)
    return w[first], codes


def window_counts(rows: DataFrame) -> DataFrame:
    """lang, apart, g, n: how often each window of the highest order occurs in the texts
    of ``rows`` (lang, apart, text)."""
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            kinds: dict[tuple, list[str]] = {}
            for lang, apart, t in zip(b.column("lang").to_pylist(), b.column("apart").to_pylist(), texts):
                kinds.setdefault((lang, apart), []).append(t)
            for (lang, apart), mine in kinds.items():
                for _, _, w in windows(mine):
                    found, codes = _distinct(w)
                    g = np.ascontiguousarray(found).view(f"<U{ORDER}").ravel().tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g)), pa.array([apart] * len(g)), pa.array(g), pa.array(np.bincount(codes))],
                        ["lang", "apart", "g", "n"])
    return (rows.select("lang", "apart", "text").mapInArrow(run, "lang string, apart boolean, g string, n long")
            .groupBy("lang", "apart", "g").agg(F.sum("n").alias("n")))


def shares(top: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """lang, k, g, kind, value: the discounted share of each window g of order k (kind 0) and
    the weight of the back-off after each context g (kind 1), from the counts (lang, g, n)
    of the highest order; the share of a letter holds its part of the uniform."""
    orders = [top.select("lang", F.lit(ORDER).alias("k"), "g", "n")]
    for k in range(ORDER - 1, 0, -1):
        orders.append(orders[-1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n"))
                      .select("lang", F.lit(k).alias("k"), "g", "n"))
    grams = materialize(reduce(DataFrame.unionByName, orders))
    of = lambda c: F.sum(F.when(F.col("n") == c, 1).otherwise(0))
    counts = grams.groupBy("lang", "k").agg(of(1).alias("n1"), of(2).alias("n2"), F.count(F.lit(1)).alias("all"))
    # Ney's estimate; half a count where a corpus is too small for one
    discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    level = F.floor(F.log2(F.col("n"))).cast("int")
    above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("e")))
    cuts = (grams.where("k > 2").groupBy("lang", level.alias("e")).agg(F.count(F.lit(1)).alias("m"))   # 64 rows a language
            .withColumn("above", above).where(F.col("above") <= max_entries)
            .groupBy("lang").agg(F.pow(F.lit(2), F.min("e")).cast("long").alias("cut")))
    one = counts.join(cuts, "lang", "left").select(           # rows: languages x orders
        "lang", "k", discount.alias("d"), F.coalesce("cut", F.lit(2 ** 62)).alias("cut"))
    after = Window.partitionBy("lang", "k", "h")             # as many rows as letters
    kept = F.when((F.col("k") <= 2) | (F.col("n") >= F.col("cut")), F.greatest(F.col("n") - F.col("d"), F.lit(0.0)))
    placed = (grams.join(one, ["lang", "k"]).withColumn("h", F.expr("substring(g, 1, k - 1)"))
              .withColumn("a", kept / F.sum("n").over(after)))
    letters_ = grams.where("k = 1").agg((F.count_distinct("g") + 1).alias("letters")).withColumn("one", F.lit(1))
    rest = placed.groupBy("lang", "k", "h").agg((1 - F.coalesce(F.sum("a"), F.lit(0.0))).alias("value"))
    uniform = (rest.where("k = 1").withColumn("one", F.lit(1)).join(F.broadcast(letters_), "one")      # a row a language
               .select("lang", (F.col("value") / F.col("letters")).alias("u")))
    mine = (placed.where("a is not null").join(F.broadcast(uniform), "lang")
            .select("lang", "k", "g", F.lit(0).alias("kind"), F.when(F.col("k") == 1, F.col("a") + F.col("u")).otherwise(F.col("a")).alias("value")))
    weights = rest.where("k > 1").select("lang", (F.col("k") - 1).alias("k"), F.col("h").alias("g"), F.lit(1).alias("kind"), "value")
    floor = uniform.select("lang", F.lit(0).alias("k"), F.lit("").alias("g"), F.lit(1).alias("kind"), F.col("u").alias("value"))
    return mine.unionByName(weights).unionByName(floor)


def tag(kind: int, k: int) -> int:
    return 1 + 2 * k + kind


class Model:
    """The sorted hash arrays of one language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, floor: float) -> None:
        order = np.argsort(keys)
        self.keys, self.values, self.floor = keys[order], values[order].astype(np.float32), floor

    def find(self, keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(missing)).astype(np.float64)


def load_models(entries: DataFrame) -> dict[str, Model]:
    """Language -> model from the rows of ``shares``; keys are hashed in the tasks."""
    def run(batches):
        for b in batches:
            k, kind = b.column("k").to_numpy(), b.column("kind").to_numpy()
            keys = np.zeros(b.num_rows, dtype=np.uint64)
            g = np.array(b.column("g").to_pylist(), dtype=object)
            for size in np.unique(k[k > 0]):
                for which in (0, 1):
                    mine = np.flatnonzero((k == size) & (kind == which))
                    if len(mine):
                        w = np.frombuffer("".join(g[mine]).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
                        keys[mine] = fold(w, tag(which, int(size)))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("k"), pa.array(keys.view(np.int64)), b.column("value")],
                                             ["lang", "k", "key", "value"])
    got = entries.mapInArrow(run, "lang string, k int, key long, value double").toArrow().to_pandas()
    models = {}
    for lang, rows in got.groupby("lang", sort=True):
        floor = rows.loc[rows["k"] == 0, "value"]
        rest = rows[rows["k"] > 0]
        models[lang] = Model(rest["key"].to_numpy().view(np.uint64), rest["value"].to_numpy(), float(floor.iloc[0]))
    return models


def log_shares(w: np.ndarray, models: list[Model]) -> np.ndarray:
    """Log probability of the last letter of each window in each model: models x windows."""
    p = [np.full(len(w), m.floor) for m in models]
    for k in range(1, w.shape[1] + 1):
        grams = fold(w[:, w.shape[1] - k:], tag(0, k))
        back = fold(w[:, w.shape[1] - k:-1], tag(1, k - 1)) if k > 1 else None
        for i, m in enumerate(models):
            a = m.find(grams, 0.0)
            # a letter's share holds the uniform; an unseen context passes all on
            p[i] = np.where(a > 0, a, p[i]) if back is None else a + m.find(back, 1.0) * p[i]
    return np.log(np.array(p))


def cross_entropies(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of each text in each model (null without letters), and its length."""
    ce, size = np.full((len(texts), len(models)), np.nan), np.zeros(len(texts), dtype=np.int64)
    for at, sizes, w in windows(texts):
        found, codes = _distinct(w)
        logs = log_shares(found, models)
        starts = np.append(0, np.cumsum(sizes)[:-1])
        for i in range(len(models)):
            ce[at, i] = -np.add.reduceat(logs[i][codes], starts) / sizes
        size[at] = sizes
    return ce, size


def evidence(ce: np.ndarray, size: np.ndarray, letters_: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best model, its cross-entropy and the log of the evidence against the next; a lone
    model stands against uniform letters."""
    best = ce.argmin(1)
    rows = np.arange(len(ce))
    low = ce[rows, best]
    if ce.shape[1] > 1:
        other = ce.copy()
        other[rows, best] = np.inf
        second = other.min(1)
    else:
        second = np.maximum(low, letters_)
    return best, low, np.log1p((second - low) * size)


def fit_logistic(x: np.ndarray, hit: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 or more) and offset of P(hit | x) on smoothed targets (Platt), from ``n`` rows
    of each (x, hit). The slope is drawn to 1, as much as one row weighs, so it is defined
    where all rows hit."""
    good, bad = n[hit].sum(), n[~hit].sum()
    y = np.where(hit, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, w = n * (p - y), n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * x).sum() + a - 1, r.sum()])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return (a, b) if a > 0 else (0.0, float(np.log((good + 1) / (bad + 1))))


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
             reject: float = 0.001, max_entries: int = MAX_ENTRIES, seed: int = 5) -> DataFrame:
    """All columns of ``docs`` but the text and its language, with ``lang_pred``, ``score``,
    ``cross_entropy`` and ``accepted``. Rows where ``learn`` holds and the language is known
    teach; nothing but the text enters a prediction."""
    apart = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 0
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), apart.alias("apart"))
    counts = materialize(window_counts(known))
    whole = load_models(shares(counts.groupBy("lang", "g").agg(F.sum("n").alias("n")), max_entries))
    # models without the rows of a half, by which those are scored
    parts = {half: load_models(shares(counts.where(F.col("apart") != half).select("lang", "g", "n"), max_entries))
             for half in (False, True)}
    sc = docs.sparkSession.sparkContext
    names = sorted(whole)
    a, b, limits = 0.0, 0.0, {}
    if any(parts.values()):
        some = sc.broadcast(parts)

        def measure(batches):
            for t in batches:
                half = t.column("apart").to_numpy(zero_copy_only=False)
                texts, langs = t.column("text").to_pylist(), t.column("lang").to_pylist()
                for side, part in some.value.items():
                    mine = np.flatnonzero(half == side)
                    tried = sorted(part)
                    if not tried or not len(mine):
                        continue
                    ce, size = cross_entropies([texts[i] for i in mine], [part[x] for x in tried])
                    has = size > 0
                    if not has.any():
                        continue
                    best, _, x = evidence(ce[has], size[has], -np.log(part[tried[0]].floor))
                    truth = [langs[i] for i in mine[has]]
                    own = [float(ce[has][i, tried.index(y)]) if y in part else None for i, y in enumerate(truth)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(truth, pa.string()), pa.array([tried[i] == y for i, y in zip(best, truth)], pa.bool_()),
                         pa.array(x), pa.array(own, pa.float64()), pa.array(size[has])], ["lang", "hit", "x", "ce", "size"])
        tests = materialize(known.mapInArrow(measure, "lang string, hit boolean, x double, ce double, size long"))
        # thousandths: the evidence is a logarithm, so its distinct values are few at any number of rows
        seen = tests.groupBy(F.round("x", 3).alias("x"), "hit").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "hit").toPandas()
        if len(seen):
            a, b = fit_logistic(seen["x"].to_numpy(), seen["hit"].to_numpy(dtype=bool), seen["n"].to_numpy())
            told = tests.where("ce is not null")
            mid = told.groupBy("lang").agg(F.percentile(F.round("ce", 3), 0.5).alias("mid"))       # a row a language
            # the spread of short texts is wider; 256 letters and more count alike
            over = (F.col("ce") - F.col("mid")) * F.sqrt(F.least("size", F.lit(256)))
            top = told.join(F.broadcast(mid), "lang").groupBy("lang", "mid").agg(F.percentile(F.round(over, 3), 1 - reject).alias("over"))
            limits = {r["lang"]: (r["mid"], r["over"] * 1.5 + 1.0) for r in top.collect()}
    models = sc.broadcast([whole[x] for x in names])
    rest = [c for c in docs.columns if c not in (text, lang)]
    out = docs.select(*rest, F.col(text).alias("__text"))
    schema = out.drop("__text").schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("accepted", "boolean")

    def predict(batches):
        for t in batches:
            m = t.num_rows
            texts = t.column(t.num_columns - 1).to_pylist()
            pred, score = np.full(m, UNKNOWN, dtype=object), np.zeros(m)
            low_all, ok = np.full(m, np.nan), np.zeros(m, dtype=bool)
            if names:
                ce, size = cross_entropies(texts, models.value)
                has = np.flatnonzero(size > 0)
                if len(has):
                    best, low, x = evidence(ce[has], size[has], -np.log(models.value[0].floor))
                    pred[has] = np.array(names, dtype=object)[best]
                    score[has] = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                    low_all[has] = low
                    mid, top = np.array([limits.get(n, (0.0, np.inf)) for n in names]).T
                    ok[has] = (low - mid[best]) * np.sqrt(np.minimum(size[has], 256)) <= top[best]
            yield pa.RecordBatch.from_arrays(
                [*t.columns[:-1], pa.array(pred, pa.string()), pa.array(score),
                 pa.array(low_all, from_pandas=True), pa.array(ok)], schema.names)

    return out.mapInArrow(predict, schema)
