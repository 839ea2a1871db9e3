"""Whitening of embeddings by spectrum slicing.

Each vector c becomes the integers x = floor(64 c) + 1000000. The distinct x vectors are
the fit list; their covariance V (divisor n) is d x d, whatever the number of rows. Its
leading eigenvalues are found by slicing the spectrum: an LDL' factorisation of
V - s I has as many positive pivots as V has eigenvalues above s (Sylvester), so counts
at bisected shifts isolate the k-th largest one in an interval of its own. Inside it,
Rayleigh quotient iteration converges cubically, and two more counts, just above and
just below the value found, certify that it is the k-th.

Spark holds all that grows: the fit list is an aggregate, sums and centred products are
added up by (row, column) of V, and only d + 1 and d (d + 1) / 2 numbers reach the
driver. Products are of integers centred at the rounded mean, so their sums are exact in
doubles up to 2^53 and don't depend on the partitioning; what is left of the mean, at
most one half a dimension, is taken off afterwards.

Defined cases: vectors that are null, empty, hold null or non-finite entries or entries
of 2^40 or more, or have another length than the most common one (ties: the longer)
take no part; rows without a key do. Repeated vectors count once in the fit and get a
row each in the result. Components whose variance is below 1e-12 of the trace (fewer
distinct vectors than dimensions) are left out, so equal vectors alone give no rows, as
does an empty table. ``deviation`` is null where it doesn't fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on are no embeddings.
LARGEST = float(2 ** 40)
#: Components with less of the trace than this are rounding.
LEAST = 1e-12
#: Distinct vectors in a partition of the fit list, far more than it has sums.
FIT_ROWS = 100_000
_ALPHA = (1 + 17 ** 0.5) / 8


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``v`` above ``shift``: the positive part of the
    inertia of LDL' of ``v - shift I``, with complete 1 x 1 and 2 x 2 pivoting."""
    m = v - shift * np.eye(len(v))
    positive = 0
    while len(m):
        size, diagonal = np.abs(m), np.abs(np.diagonal(m))
        r = int(diagonal.argmax())
        largest = size.max()
        if largest == 0:                         # what is left lies on the shift
            break
        if diagonal[r] >= _ALPHA * largest:
            pivots = [r]
            positive += m[r, r] > 0
        else:                                    # an indefinite block: one of each sign
            pivots = sorted(divmod(int(size.argmax()), len(m)))
            positive += 1
        rest = np.delete(np.arange(len(m)), pivots)
        side = m[np.ix_(rest, pivots)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(pivots, pivots)], side.T)
        m = (m + m.T) / 2
    return int(positive)


class Slices:
    """Counts of eigenvalues above shifts, remembered."""

    def __init__(self, v: np.ndarray) -> None:
        radius = np.abs(v).sum(1) - np.abs(np.diagonal(v))
        low, high = float((np.diagonal(v) - radius).min()), float((np.diagonal(v) + radius).max())
        self.v, self.scale = v, max(abs(low), abs(high), np.finfo(float).tiny)
        edge = 1e-9 * self.scale
        self.known = {low - edge: len(v), high + edge: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = count_above(self.v, shift)
        return self.known[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The tightest known interval that holds the k-th largest eigenvalue."""
        return (max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k))

    def alone(self, k: int) -> bool:
        low, high = self.bracket(k)
        return self.above(low) == k and self.above(high) == k - 1

    def halve(self, k: int) -> bool:
        """Bisect the interval of the k-th; False once it is as narrow as doubles allow."""
        low, high = self.bracket(k)
        mid = (low + high) / 2
        if high - low <= 4 * np.finfo(float).eps * self.scale or not low < mid < high:
            return False
        self.above(mid)
        return True


def _rayleigh(v: np.ndarray, low: float, high: float, near: list[np.ndarray], seed: int, scale: float,
              rounds: int = 12) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from two inverse steps at the middle of an interval,
    orthogonal to ``near``. Returns value, unit vector and residual."""
    x = np.random.default_rng(seed).standard_normal(len(v))
    eps, best = np.finfo(float).eps, None
    shift = (low + high) / 2
    for step in range(rounds):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:            # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (shift + eps * scale) * np.eye(len(v)), x)
        for _ in range(2):
            for q in near:
                y = y - (q @ y) * q
        x = y / np.linalg.norm(y)
        value = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - value * x))
        if best is None or residual < best[2]:
            best = value, x, residual
        elif residual <= 64 * eps * scale:
            break
        if step:                                 # from the third solve on, shifted by the quotient
            shift = value
    return best


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``v`` and unit eigenvectors as
    columns, numbered by certified counts. Equal eigenvalues get orthogonal vectors."""
    slices = Slices(v)
    eps = np.finfo(float).eps * slices.scale * len(v)
    values, vectors = [], []
    for j in range(1, k + 1):
        while not slices.alone(j) and slices.halve(j):
            pass
        while True:
            low, high = slices.bracket(j)
            near = [q for e, q in zip(values, vectors) if e - high <= 1e-3 * slices.scale]
            value, x, residual = _rayleigh(v, low, high, near, j, slices.scale)
            slack = 4 * eps + residual
            inside = low - slack <= value <= high + slack
            if inside and slices.above(value + slack) < j <= slices.above(value - slack):
                break
            if not slices.halve(j):              # the interval itself is the certificate
                value = (low + high) / 2
                break
        values.append(value)
        vectors.append(x)
    return np.array(values), np.array(vectors).reshape(len(values), len(v)).T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and ``x`` of the rows that take part."""
    v = F.transform(vector, lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    width = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), F.desc("d")).limit(1).select("d"))
    return (rows.join(F.broadcast(width), F.size("v") == F.col("d"))        # one row
            .select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c).cast("long") + SHIFT).alias("x")))


def _summed(fit: DataFrame, width: int, part, kind: str) -> dict[int, float]:
    """Sums by place of what ``part`` (x -> flat array) gives for the batches of a partition."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column("x"), width))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "s"])
    sums = fit.mapInArrow(run, f"at int, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()
    return {r["at"]: r["s"] for r in sums}


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row
    that takes part, its place along the leading ``components`` of the fit list."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    none = vectors.sparkSession.createDataFrame([], schema)
    rows = materialize(integers(vectors, key, vector))
    some = rows.select(F.size("x").alias("d")).head()
    if some is None:
        return none
    d = some["d"]
    fit = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("k")).select("x"))
    fit = fit.coalesce(max(1, -(-fit.count() // FIT_ROWS)))          # d^2 / 2 sums a partition
    sums = _summed(fit, d, lambda x: np.append(x.sum(0), len(x)), "long")
    n, total = int(sums[d]), [int(sums[i]) for i in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)       # the rounded mean
    rest = [s - n * int(m) for s, m in zip(total, middle)]                           # n (mean - middle), exact
    off = np.array([r / n for r in rest])
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - middle).astype(np.float64)
        return (y.T @ y)[upper]
    got = _summed(fit, d, products, "double")
    v = np.zeros((d, d))
    v[upper] = [got[i] / n for i in range(len(upper[0]))]
    v = v + np.triu(v, 1).T - np.outer(off, off)
    trace = float(np.trace(v))
    values, axes = leading(v, min(components, d))
    use = values > LEAST * trace
    values, axes = values[use], axes[:, use]
    if not len(values):
        return none
    turn = axes / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle).astype(np.float64) - off) @ turn

    k = len(values)
    pairs = np.triu_indices(k)

    def second(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.append(w.sum(0), (w.T @ w)[pairs])
    got = _summed(fit, d, second, "double")
    mean = np.array([got[i] / n for i in range(k)])
    cov = np.zeros((k, k))
    cov[pairs] = [got[k + i] / n for i in range(len(pairs[0]))]
    error = float(np.abs((cov - np.outer(mean, mean) - np.eye(k))[pairs]).max())
    share = values / trace
    largest_rest = max(abs(r) for r in rest)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), d)
            y, w = x - middle, project(x)
            wide = (n * int(np.abs(y).max()) + largest_rest) ** 2 * d >= 2 ** 63
            z = (y.astype(object) if wide else y) * n - np.array(rest, dtype=object if wide else np.int64)
            far = (z * z).sum(1).tolist()
            m = b.num_rows
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array([f if f < 2 ** 63 else None for f in far], pa.int64()).take(pa.array(at)),
                pa.array(w.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(out, schema)
