"""NumPy kernels on Arrow batches.

Integer vectors: values are within +-10000 and vectors short, so distances by matrix products are exact in
64-bit floats. Float vectors: squared differences are added in the order of the dimensions.

`TopK.show` compares all with all. `TopK.search` gives the same for integer vectors, but compares a group of near queries
only with those boxes of rows that may hold one of a query's k nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE = 4096
GROUP, LEAF = 32, 256


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array<int> column, all of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n) if n else np.zeros((0, 0))


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", r, r)[None, :] - 2 * (q @ r.T)


def float_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        out += np.square(q[:, j, None] - r[None, :, j])
    return out


def boxed(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows in which runs of at most `most` lie together, the runs' bounds, and the least and greatest values of each run.

    A run is halved at the median of the dimension that varies most; equal values stay on one side, so that boxes are narrow."""
    order, ends, todo = np.arange(len(v)), [], [(0, len(v))]
    while todo:
        a, b = todo.pop()
        own = order[a:b]
        c = np.zeros(0)
        if b - a > most:
            x = v[own]
            c = x[:, int(x.var(axis=0).argmax())]
        if not len(c) or c.min() == c.max():  # equal rows: any cut will do
            ends += [*range(a + most, b, most), b]
            continue
        middle = np.partition(c, len(c) // 2)[len(c) // 2]
        left = c < middle
        if not left.any():
            left = c <= middle
        order[a:b] = np.concatenate([own[left], own[~left]])
        at = a + int(left.sum())
        todo += [(at, b), (a, at)]
    cuts = np.array([0, *ends] if len(v) else [0])
    x = v[order]
    return order, cuts, np.minimum.reduceat(x, cuts[:-1]) if len(v) else x, np.maximum.reduceat(x, cuts[:-1]) if len(v) else x


def first_of_equals(ids: np.ndarray, v: np.ndarray, k: int, not_self: bool) -> np.ndarray:
    """Places of rows among which are, of all rows of one vector, the k of least ids, with not_self also when any one id is left out.
    Of equal hashes only neighbours that are equal count as copies, so a collision keeps more rows."""
    odd = np.random.default_rng(1).integers(1, 1 << 62, v.shape[1], dtype=np.int64) | 1
    o = np.lexsort((ids, (v.astype(np.int64) * odd).sum(axis=1)))
    new = np.ones(len(o), bool)
    new[1:] = (v[o[1:]] != v[o[:-1]]).any(axis=1)
    start = np.flatnonzero(new)
    if not_self:  # an id may be repeated
        new[1:] |= ids[o[1:]] != ids[o[:-1]]
        k += int(np.diff([*np.flatnonzero(new), len(o)]).max())
    return o[np.arange(len(o)) - np.repeat(start, np.diff([*start, len(o)])) < k]


class TopK:
    """The k nearest of all rows shown, for each query, by (distance, id)."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, not_self: bool, floats: bool = False):
        self.qid, self.q, self.k, self.not_self = qid, q, k, not_self
        self.between, self.kind = (float_distances, np.float64) if floats else (distances, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.worst = np.full(len(qid), np.inf)
        self.groups: list[tuple[TopK, np.ndarray, np.ndarray]] | None = None

    def search(self, ids: np.ndarray, r: np.ndarray, fraud: np.ndarray) -> None:
        """show() of integer vectors, best of many rows at once; not to be mixed with it."""
        if self.groups is None:
            order, cuts, mn, mx = boxed(self.q, GROUP)
            runs = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            self.groups = [(TopK(self.qid[g], self.q[g], self.k, self.not_self), mn[i], mx[i]) for i, g in enumerate(runs)]
        if not len(ids):
            return
        some = first_of_equals(ids, r, self.k, self.not_self)
        order, cuts, low, high = boxed(r[some], LEAF)
        ids, r, fraud = (x[some][order] for x in (ids, r, fraud))
        for top, mn, mx in self.groups:
            gap = np.maximum(np.maximum(low - mx, mn - high), 0)
            bound = np.einsum("ij,ij->i", gap, gap)
            near = np.flatnonzero(bound <= top.worst.max())
            near = near[np.argsort(bound[near], kind="stable")]
            at, n = 0, 4
            while at < len(near) and bound[near[at]] <= top.worst.max():
                part = near[at : at + n]
                part = part[bound[part] <= top.worst.max()]
                rows = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in part])
                top.show(ids[rows], r[rows], fraud[rows])
                at, n = at + n, min(2 * n, 32)

    def show(self, ids: np.ndarray, r: np.ndarray, fraud: np.ndarray) -> None:
        for i in range(0, len(ids), TILE):
            part = slice(i, i + TILE)
            for j in range(0, len(self.qid), 1024):
                d = self.between(self.q[j : j + 1024], r[part])
                if self.not_self:
                    d[self.qid[j : j + 1024, None] == ids[None, part]] = np.inf
                most = self.worst[j : j + 1024]
                if d.shape[1] > self.k and np.count_nonzero(d <= most[:, None]) > 4 * self.k * len(d):
                    most = np.minimum(most, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
                a, b = np.nonzero((d <= most[:, None]) & np.isfinite(d))
                new = (a + j, d[a, b].astype(self.kind), ids[part][b], fraud[part][b])
                self.rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
            self._keep()

    def _keep(self) -> None:
        q, d, ids, fraud = self.rows
        o = np.lexsort((ids, d, q))
        q = q[o]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        o, q, rank = o[rank < self.k], q[rank < self.k], rank[rank < self.k]
        self.rows = [x[o] for x in (self.rows[0], d, ids, fraud)]
        last = rank == self.k - 1
        self.worst[q[last]] = self.rows[1][last]

    def batch(self) -> pa.RecordBatch:
        if self.groups:
            return pa.Table.from_batches([g.batch() for g, _, _ in self.groups]).combine_chunks().to_batches()[0]
        q, d, ids, fraud = self.rows
        return pa.RecordBatch.from_arrays([pa.array(self.qid[q]), pa.array(d), pa.array(ids), pa.array(fraud.astype(np.int32))], ["qid", "dist", "ref_id", "fraud"])
