"""Collision counting over single projections: the index of a shard and the search of a batch of queries in it.

Every vector is projected on PROJECTIONS random directions, and each direction keeps the shard's vectors in the order of
their projections. A query's window on a direction is centred on its own projection; all its windows grow together
(virtual rehashing: one order serves every width), and only the rings that a step adds are counted. A vector that lies in
THRESHOLD windows is verified with its exact distance.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np

#: Directions, the windows that a vector must lie in, and how a step widens a query's windows.
PROJECTIONS, THRESHOLD, GROWTH = 64, 42, 1.5
#: Chance that a vector as near as the last of a query's best is missed when its search ends.
MISSED = 0.02
#: Queries times vectors that are counted at a time, and vectors that are verified at a time.
COUNTED, VERIFIED = 1 << 24, 1 << 14


def final_width(projections: int = PROJECTIONS, threshold: int = THRESHOLD, missed: float = MISSED) -> float:
    """Half a window over a distance, at which a vector of that distance lies in too few windows with the chance `missed`.

    Two vectors' projections differ by their distance times a standard normal, independently for each direction.
    """
    low, high = 0.0, 9.0
    for _ in range(60):
        z = (low + high) / 2
        p = erf(z / sqrt(2))
        few = sum(comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold))
        low, high = (z, high) if few > missed else (low, z)
    return high


WIDTH = final_width()


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).normal(size=(dims, PROJECTIONS))


class Shard:
    """Distinct vectors, each with the smallest ids that it has, and their order on every direction."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, orders: np.ndarray):
        self.vectors, self.ids, self.starts, self.orders = vectors, ids, starts, orders
        values = self._scaled(vectors) @ directions(vectors.shape[1])
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), orders.astype(np.int64), axis=1)

    @staticmethod
    def _scaled(v: np.ndarray) -> np.ndarray:
        return np.clip(v.astype(np.float64), -1e150, 1e150)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, most: int) -> Shard:
        """At most 65,536 vectors. Equal vectors are one, with their `most` smallest distinct ids: no more can be among the best."""
        vectors = np.ascontiguousarray(vectors) + 0  # minus zero becomes zero
        raw = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((which.ravel(), ids)), axis=1)  # by vector, then by id
        place = np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0])
        pairs = pairs[:, place < most]
        starts = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        distinct = vectors[first]
        orders = np.argsort(cls._scaled(distinct) @ directions(vectors.shape[1]), axis=0, kind="stable").T
        return cls(distinct, pairs[1].astype(np.int64), starts, np.ascontiguousarray(orders, dtype=np.uint16))

    def dumps(self) -> dict[str, bytes]:
        return {"vectors": self.vectors.tobytes(), "ids": self.ids.tobytes(), "starts": self.starts.astype(np.int32).tobytes(), "orders": self.orders.tobytes()}

    @classmethod
    def loads(cls, row: dict, kind: np.dtype, dims: int) -> Shard:
        vectors = np.frombuffer(row["vectors"], kind).reshape(-1, dims)
        return cls(vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int32), np.frombuffer(row["orders"], np.uint16).reshape(PROJECTIONS, -1))

    def distances(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Euclidean distances of vectors from one query, in double precision."""
        with np.errstate(over="ignore"):
            return np.concatenate([np.sqrt(np.square(self.vectors[rows[a : a + VERIFIED]].astype(np.float64) - q).sum(1)) for a in range(0, len(rows), VERIFIED)])

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Brings each query's best (distances, ids) up to date with this shard; the id `own` isn't a candidate."""
        step = max(1, COUNTED // max(1, len(self.vectors)))
        for a in range(0, len(queries), step):
            some = best[a : a + step]
            self._search(queries[a : a + step].astype(np.float64), own[a : a + step], some, k)
            best[a : a + step] = some

    def _search(self, queries: np.ndarray, own: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        n = len(self.vectors)
        centre = self._scaled(queries) @ directions(queries.shape[1])
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) / 16
        slack = 1e-9 * (np.abs(centre).max(1) + spread)  # equal vectors may be projected with different rounding
        needed = np.array([WIDTH * d[k - 1] if len(d) >= k else np.inf for d, _ in best]) + slack
        width = np.minimum(spread or np.inf, needed)
        counts, tested = np.zeros((len(queries), n), np.uint8), np.zeros((len(queries), n), bool)
        left, right = (np.empty((PROJECTIONS, len(queries)), np.int64) for _ in range(2))
        for i in range(PROJECTIONS):  # empty windows where the query lies
            left[i] = right[i] = np.searchsorted(self.sorted[i], centre[:, i])
        active = np.arange(len(queries))
        while len(active):
            lo, hi = (np.empty((PROJECTIONS, len(active)), np.int64) for _ in range(2))
            for i in range(PROJECTIONS):
                lo[i] = np.searchsorted(self.sorted[i], centre[active, i] - width[active], "left")
                hi[i] = np.searchsorted(self.sorted[i], centre[active, i] + width[active], "right")
            for j, q in enumerate(active):
                rings = [self.orders[i, a:b] for i, (a, b) in enumerate(zip(lo[:, j], left[:, q], strict=True)) if b > a]
                rings += [self.orders[i, a:b] for i, (a, b) in enumerate(zip(right[:, q], hi[:, j], strict=True)) if b > a]
                if rings:
                    counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.uint8)
                fresh = np.flatnonzero((counts[q] >= THRESHOLD) & ~tested[q])
                if len(fresh):
                    tested[q, fresh] = True
                    best[q] = self._better(best[q], fresh, queries[q], own[q], k)
                    if len(best[q][0]) >= k:
                        needed[q] = WIDTH * best[q][0][k - 1] + slack[q]
            left[:, active], right[:, active] = np.minimum(left[:, active], lo), np.maximum(right[:, active], hi)
            # a query is done when its windows are as wide as its best ask for, or hold all there is
            done = (width[active] >= needed[active]) | ((left[:, active] == 0) & (right[:, active] == n)).all(0)
            active = active[~done]
            width[active] = np.minimum(width[active] * GROWTH, needed[active])

    def _better(self, best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        far = self.distances(rows, q)
        if len(best[0]) >= k:
            near = far <= best[0][k - 1]
            rows, far = rows[near], far[near]
        elif len(rows) > 2 * k + 2:  # k + 1 vectors are enough, as one of them may be the query's own row
            near = far <= np.partition(far, k + 1)[k + 1]
            rows, far = rows[near], far[near]
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        ids, far = self.ids[at], np.repeat(far, sizes)
        other = ids != own
        ids, far = np.concatenate((best[1], ids[other])), np.concatenate((best[0], far[other]))
        order = np.lexsort((ids, far))[:k]
        return far[order], ids[order]
