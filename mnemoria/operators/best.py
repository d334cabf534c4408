"""The best rows of each query, in memory that neither rows nor queries make larger: products of small blocks, lists of k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Numbers of a matrix of queries by rows: 4 MB in double precision.
CELLS = 1 << 19
#: Products of matrices differ in their last digits by where a row stands in them; what is this close to the edge is scored again by itself.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dims) of an array column without nulls, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


#: Stands for a null id, behind all others.
NONE = np.iinfo(np.int64).max


def numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(NONE).to_numpy(zero_copy_only=False)


def slices(rows: int, queries: int) -> list[slice]:
    """Slices of so many rows that a matrix by all queries has ``CELLS`` numbers at most."""
    step = max(1, CELLS // max(queries, 1))
    return [slice(at, at + step) for at in range(0, rows, step)]


def cosines(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of pairs of unit vectors, each summed in one order: equal vectors score equally."""
    out = np.empty(len(r))
    for at in range(0, len(r), 8192):
        part = slice(at, at + 8192)
        out[part] = (q[r[part]] * x[c[part]]).sum(1)
    return out


class Best:
    """For each of ``n`` queries the ``k`` rows that are least far, ties by id. Where a row may come up to ``copies`` times, it counts once."""

    def __init__(self, n: int, k: int, copies: int = 1) -> None:
        self.k, self.copies, self.edge = k, copies, np.full(n, np.inf)
        none = np.zeros(0, np.int64)
        self.held, self.waiting, self.n_waiting = (none, none, np.zeros(0), np.zeros(0)), [], 0

    def within(self, far: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) of what could be among the best, for a matrix of queries by rows."""
        few = self.k * self.copies
        hit = far <= self.edge[:, None] + slack
        hit &= far < np.inf
        if far.shape[1] > few and np.count_nonzero(hit) > 2 * few * len(far):
            hit &= far <= np.partition(far, few - 1, axis=1)[:, few - 1][:, None] + slack
        return np.nonzero(hit)

    def add(self, query: np.ndarray, ids: np.ndarray, far: np.ndarray, score: np.ndarray) -> None:
        """Take rows in; lists are cut once as many wait as they hold."""
        self.waiting.append((query, ids, far, score))
        self.n_waiting += len(query)
        if self.n_waiting > max(len(self.held[0]), 1 << 15):
            self._cut()

    def _cut(self) -> None:
        query, ids, far, score = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((ids, far, query))
        query, ids = query[order], ids[order]
        if self.copies > 1:
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
            query, ids, order = query[new], ids[new], order[new]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = nth < self.k
        self.held = query[kept], ids[kept], far[order[kept]], score[order[kept]]
        full = nth[kept] == self.k - 1
        self.edge[self.held[0][full]] = self.held[2][full]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        self._cut()
        query, ids, far, score = self.held
        return pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(ids, mask=ids == NONE), pa.array(far), pa.array(score)], names=["query_id", "id", "far", "score"])
