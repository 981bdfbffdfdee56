"""The nearest vectors of some queries, seen a block at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 6
#: As much as rounding two squared distances to DIGITS can hide.
SLACK = 1e-6
#: Queries and vectors that meet at once, and pairs that are subtracted at once.
ROWS, COLUMNS, AT_ONCE = 512, 4096, 1 << 16


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of lists of one length as rows of doubles."""
    values = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if vectors.num_chunks else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def finite(vectors: np.ndarray) -> np.ndarray:
    """Which rows have a finite length; no distance to another is one."""
    return np.isfinite((vectors * vectors).sum(axis=1))


class Nearest:
    """Of up to ROWS queries the k nearest of those seen with an id below the query's minus
    exclusion; ties go to the smaller id. bound: the squared distance within which they are
    known to be. A product of matrices leaves few pairs; their distances are sums of squared
    differences, rounded to DIGITS."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int, exclusion: int, bound: np.ndarray | None = None):
        self.vectors, self.ids, self.k, self.exclusion = vectors, ids, k, exclusion
        self.norms = (vectors * vectors).sum(axis=1)
        self.own = np.hstack([-2 * vectors, np.ones((len(vectors), 1))])
        self.bound = np.full(len(ids), np.inf) if bound is None else bound.copy()
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # the id of the k-th, where there are k
        self.held = tuple(np.zeros(0, dtype=t) for t in ("int64", "float64", "int64"))  # query, distance, id
        self.fresh, self.waiting = [], 0

    def see(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Queries of these numbers see up to COLUMNS vectors of finite length."""
        if not len(rows) or not len(ids):
            return
        squares = (vectors * vectors).sum(axis=1)
        scores = self.own[rows] @ np.hstack([vectors, squares[:, None]]).T  # squared distances less the query's norm
        if ids.max() >= self.ids[rows].min() - self.exclusion:
            scores[ids[None] >= (self.ids[rows] - self.exclusion)[:, None]] = np.inf
        blur = 1e-12 * (self.norms[rows] + squares.max())
        limit = self.bound[rows] + SLACK + blur - self.norms[rows]
        near = scores <= limit[:, None]
        if len(ids) > self.k and np.count_nonzero(near) > 2 * self.k * len(rows):
            kth = np.partition(scores, self.k - 1, axis=1)[:, self.k - 1]
            near = scores <= np.minimum(limit, kth + SLACK + 2 * blur)[:, None]
        r, c = np.nonzero(near)
        s = scores[r, c]
        below = (self.bound[rows] - SLACK / 2 + blur - self.norms[rows])[r]  # what isn't may tie with the k-th, at best
        kept = np.isfinite(s) & ((s < below) | (ids[c] < self.last[rows][r]))
        r, c = r[kept], c[kept]
        for at in range(0, len(r), AT_ONCE):
            i, j = rows[r[at : at + AT_ONCE]], c[at : at + AT_ONCE]
            gap = self.vectors[i] - vectors[j]
            d2 = np.round(np.einsum("ij,ij->i", gap, gap), DIGITS)
            ok = d2 <= self.bound[i]
            self.fresh.append((i[ok], d2[ok], ids[j[ok]]))
            self.waiting += int(ok.sum())
        if self.waiting > self.k * len(self.ids) // 2:
            self._keep()

    def _keep(self) -> None:
        query, d2, ids = (np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        order = np.lexsort((ids, d2, query))
        query, d2, ids = query[order], d2[order], ids[order]
        starts = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - starts[query]
        full = rank == self.k - 1
        self.bound[query[full]] = np.minimum(self.bound[query[full]], d2[full])
        self.last[query[full]] = ids[full]
        best = rank < self.k
        self.held, self.fresh, self.waiting = (query[best], d2[best], ids[best]), [], 0

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """Query id and the k-th squared distance of those that have k."""
        self._keep()
        full = np.isfinite(self.bound)
        return self.ids[full], self.bound[full]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, id and squared distance of the k nearest, or of all that are fewer."""
        self._keep()
        query, d2, ids = self.held
        return self.ids[query], ids, d2
