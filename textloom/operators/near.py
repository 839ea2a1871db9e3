"""The k nearest rows within a block of vectors, or between two, by Euclidean distance.

A matrix product in single precision gives a lower bound of every distance: it is lowered
by more than its rounding can be. Only pairs whose bound doesn't exceed what one of its
rows still needs are measured, by direct differences in double precision, once for both
rows. A row needs at most its k-th distance known before or, without one, that to a part of
the other rows. Equal vectors of a block are measured once and stand for all their rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Rows and columns of a tile of bounds, and vectors that a first limit is taken from.
TILE, SAMPLE = (1024, 1024), 4096
#: Pairs measured at a time, and rows gathered before all but the best are dropped.
MEASURED, GATHERED = 1 << 14, 1 << 21


def _place(new: np.ndarray) -> np.ndarray:
    """Place of each item in its run; ``new`` marks the first of each."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class Rows:
    """The rows of a block that are finite: distinct vectors ``m``, the rows of each, and the
    ids that it offers to others. No row needs an id more than k times, and it skips
    but its own, so the 2k smallest do."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, limit: np.ndarray | None, k: int) -> None:
        ok = np.isfinite(m).all(axis=1) if m.size else np.zeros(len(m), dtype=bool)
        m = np.ascontiguousarray(m[ok] + 0.0)    # no -0.0
        self.ids = ids[ok]
        self.limit = np.full(len(m), np.inf) if limit is None else limit[ok]
        if not len(m):
            self.m = m
            return
        _, first, of = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.m, n = m[first], len(first)
        self.n_rows = np.bincount(of, minlength=n)
        self.row_at = np.cumsum(self.n_rows) - self.n_rows
        self.row = np.argsort(of, kind="stable")
        self.widest = np.maximum.reduceat(self.limit[self.row], self.row_at)
        order = np.lexsort((self.ids, of))
        order = order[_place(_changes(of[order], self.ids[order])) < k]
        order = order[_place(_changes(of[order])) < 2 * k]
        self.offered = self.ids[order]
        self.n_offered = np.bincount(of[order], minlength=n)
        self.offered_at = np.cumsum(self.n_offered) - self.n_offered

    def met(self, other: Rows) -> np.ndarray:
        """For each distinct vector, the most rows of ``other`` that have the id of one of its rows."""
        known, count = np.unique(other.ids, return_counts=True)
        at = np.minimum(np.searchsorted(known, self.ids), len(known) - 1)
        same = np.where(known[at] == self.ids, count[at], 0)
        return np.maximum.reduceat(same[self.row], self.row_at)


class Bounds:
    """Lower bounds of half the squared distances of ``a`` to ``b``, centred and scaled."""

    def __init__(self, a: Rows, b: Rows) -> None:
        size = max(np.abs(x.m).max(initial=0.0) for x in (a, b)) or 1.0
        u, v = a.m / size, b.m / size
        centre = (u.sum(0) + v.sum(0)) / (len(u) + len(v))
        u, v = u - centre, v - centre
        far = np.sqrt(max((x * x).sum(1).max() for x in (u, v))) or 1.0
        dim = u.shape[1]
        self.scale = size, far
        self.rounding = (2 * dim + 40) * 2.0 ** -24
        self.lost = 16 * np.sqrt(dim) * 2.0 ** -52 / far      # to scaling and centring
        u, v = u / far, v / far
        self.hu, self.hv = (u * u).sum(1) / 2, (v * v).sum(1) / 2
        low = 1 - self.rounding
        self.u = np.column_stack([u, self.hu * low, np.ones(len(u))]).astype(np.float32)
        self.v = np.ascontiguousarray(np.column_stack([-v, np.ones(len(v)), self.hv * low]).astype(np.float32).T)

    def scaled(self, d: np.ndarray) -> np.ndarray:
        """The bound that no pair within ``d`` exceeds."""
        size, far = self.scale
        with np.errstate(over="ignore"):
            half = (d / size / far) ** 2 / 2 * (1 + 1e-5) + 1e-30 + self.lost
            return np.nextafter(half.astype(np.float32), np.float32(np.inf))

    def limits(self, a: Rows, b: Rows, k: int, turned: bool = False) -> np.ndarray:
        """``scaled`` of what each vector of ``a`` needs of ``b``; where nothing is known,
        the k-th distance to a part of ``b`` not counting rows with its ids, from above."""
        out = self.scaled(a.widest)
        u, v = (np.ascontiguousarray(self.v.T), self.u.T) if turned else (self.u, self.v)
        hu, hv = (self.hv, self.hu) if turned else (self.hu, self.hv)
        open_ = np.flatnonzero(np.isinf(out))
        if not len(open_):
            return out
        cols = np.arange(0, v.shape[1], -(-v.shape[1] // SAMPLE))
        part, part_h = np.ascontiguousarray(v[:, cols]), hv[cols]
        place = k - 1 + a.met(b)[open_]
        for p in np.unique(place[place < len(cols)]):
            these = open_[place == p]
            for at in range(0, len(these), TILE[0]):
                r = these[at:at + TILE[0]]
                above = u[r] @ part + 2 * self.rounding * (hu[r][:, None] + part_h[None, :])
                half = np.partition(above, p, axis=1)[:, p]
                out[r] = np.maximum(half, 0) * (1 + 1e-5) + 1e-30 + self.lost
        return out

    def distance(self, half: np.ndarray) -> np.ndarray:
        """A distance that no pair within the bound ``half`` exceeds."""
        size, far = self.scale
        with np.errstate(over="ignore"):
            return np.sqrt(2 * half.astype(np.float64) + 2 * self.lost) * far * size * (1 + 1e-5)


class Best:
    """The k nearest (neighbour, distance) of each row so far; ties to smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0

    def add(self, row: np.ndarray, nbr: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((row, nbr, d))
        self.size += len(row)
        if self.size > GATHERED:
            self.parts = [self.rows()]
            self.size = len(self.parts[0][0]) // 2            # what stays is sorted again only with as much new

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, nbr, d = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((nbr, d, row))
        order = order[_place(_changes(row[order])) < self.k] if len(order) else order
        return row[order], nbr[order], d[order]

    def take(self, a: Rows, b: Rows, u: np.ndarray, v: np.ndarray, d: np.ndarray, most: np.ndarray) -> None:
        """Pairs of distinct vectors to rows of ``a`` and ids of ``b``, a bounded number at a time."""
        keep = d <= most[u]
        u, v, d = u[keep], v[keep], d[keep]
        n = a.n_rows[u] * b.n_offered[v]
        part = np.cumsum(n) // GATHERED
        for at in np.split(np.arange(len(u)), np.flatnonzero(np.diff(part)) + 1):
            p = np.repeat(at, n[at])
            i, j = np.divmod(np.arange(len(p)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]), b.n_offered[v[p]])
            row, nbr, dist = a.row[a.row_at[u[p]] + i], b.offered[b.offered_at[v[p]] + j], d[p]
            ok = (a.ids[row] != nbr) & (dist <= a.limit[row])
            self.add(row[ok], nbr[ok], dist[ok])

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"id": ids[:0], "nbr": ids[:0], "sim": np.zeros(0)})
        row, nbr, d = self.rows()
        return pd.DataFrame({"id": ids[row], "nbr": nbr, "sim": d})


def _open_pairs(bounds: Bounds, tu: np.ndarray, tv: np.ndarray, within: bool):
    """(u, v) of the pairs that a limit leaves open, tile by tile; within a block, u <= v."""
    rows, cols = TILE
    for top in range(0, len(tu), rows):
        left, limit = bounds.u[top:top + rows], tu[top:top + rows, None]
        for at in range(top if within else 0, len(tv), cols):
            half = left @ bounds.v[:, at:at + cols]
            hit = half <= limit
            hit |= half <= tv[at:at + cols]
            u, v = np.divmod(np.flatnonzero(hit), hit.shape[1])
            u, v = u + top, v + at
            if within:
                u, v = u[u <= v], v[u <= v]
            for i in range(0, len(u), MEASURED):
                yield u[i:i + MEASURED], v[i:i + MEASURED]


def nearest(ids: np.ndarray, m: np.ndarray, k: int) -> list[pd.DataFrame]:
    """(id, nbr, sim) of each row's k nearest rows with another id in its block."""
    a = Rows(ids, m, None, k)
    return _nearest(a, a, k) if len(a.m) else []


def nearest_between(ids, m, limit, ids2, m2, limit2, k: int) -> list[pd.DataFrame]:
    """The same between two blocks, for the rows of both; neighbours beyond a row's limit,
    where it has a finite one, are left out."""
    a, b = Rows(ids, m, limit, k), Rows(ids2, m2, limit2, k)
    return _nearest(a, b, k) if len(a.m) and len(b.m) else []


def _nearest(a: Rows, b: Rows, k: int) -> list[pd.DataFrame]:
    within = a is b
    bounds, best, best2 = Bounds(a, b), Best(k), Best(k)
    tu = bounds.limits(a, b, k)
    tv = tu if within else bounds.limits(b, a, k, turned=True)
    most, most2 = bounds.distance(tu), bounds.distance(tv)
    for u, v in _open_pairs(bounds, tu, tv, within):
        d = np.sqrt(((a.m[u] - b.m[v]) ** 2).sum(1))
        ok = np.isfinite(d)
        u, v, d = u[ok], v[ok], d[ok]
        best.take(a, b, u, v, d, most)
        if within:
            u, v, d = u[u < v], v[u < v], d[u < v]
        (best if within else best2).take(b, a, v, u, d, most2)
    return [best.frame(a.ids)] if within else [best.frame(a.ids), best2.frame(b.ids)]
