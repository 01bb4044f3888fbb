"""Cells of the exact neighbour search: cuts of a k-d tree, the box of each cell, and bounds on distances to a box.

A distance here is a sum of per-feature terms that grow with |difference|, so the nearest and the farthest point of a box bound
the distance to every vector inside it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Bounds are compared with this much room, as sums of many terms may round differently.
SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Metric:
    """Squared Euclidean distance, or Gower's mean of |difference| / range and 0/1 mismatches."""

    scale: np.ndarray
    is_cat: np.ndarray
    power: int
    mean: bool

    @staticmethod
    def squared(n: int) -> Metric:
        return Metric(np.ones(n), np.zeros(n, dtype=bool), 2, False)

    @staticmethod
    def gower(ranges: list[float], is_cat: list[bool]) -> Metric:
        r = np.asarray(ranges, dtype=np.float64)
        return Metric(np.where(r > 0, r, 1.0), np.asarray(is_cat, dtype=bool), 1, True)

    def _total(self, gap: np.ndarray) -> np.ndarray:
        """Distances from non-negative per-feature differences (last axis)."""
        if self.power == 2:
            return (gap ** 2).sum(axis=-1)
        return np.where(self.is_cat, (gap > 0).astype(np.float64), gap / self.scale).mean(axis=-1)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._total(np.abs(a - b))

    def least(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """No vector in the box is nearer than this."""
        return self._total(np.maximum(np.maximum(lo - x, x - hi), 0.0))

    def most(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """No vector in the box is farther than this."""
        return self._total(np.maximum(np.abs(x - lo), np.abs(x - hi)))

    def spread(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.where(self.is_cat, (hi > lo).astype(np.float64), (hi - lo) / self.scale)


@dataclass(frozen=True)
class Cells:
    """Nodes in breadth-first order: node i splits on `dim[i]` at `cut[i]` into `child[i]` (<=) and `child[i]` + 1 (>), or is
    cell number `cell[i]` (dim -1). `lo`, `hi`: box of each node; `size`: vectors of each cell."""

    metric: Metric
    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    cell: np.ndarray
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    size: np.ndarray | None = None

    @property
    def count(self) -> int:
        return int((self.dim < 0).sum())

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell that each row of x falls into."""
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while len(rows := rows[self.dim[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = self.child[at] + (x[rows, self.dim[at]] > self.cut[at])
        return self.cell[node]

    def with_boxes(self, cell: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Cells:
        """Boxes of the cells as counted over all their vectors; a node's box holds those of its children."""
        d = len(self.metric.scale)
        los, his = np.full((len(self.dim), d), np.inf), np.full((len(self.dim), d), -np.inf)
        sizes = np.zeros(self.count, dtype=np.int64)
        node_of = np.empty(self.count, dtype=np.int64)
        node_of[self.cell[self.dim < 0]] = np.flatnonzero(self.dim < 0)
        los[node_of[cell]], his[node_of[cell]], sizes[cell] = lo, hi, size
        for i in range(len(self.dim) - 1, -1, -1):
            if self.dim[i] >= 0:
                c = self.child[i]
                los[i], his[i] = np.minimum(los[c], los[c + 1]), np.maximum(his[c], his[c + 1])
        return replace(self, lo=los, hi=his, size=sizes)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, cell) whose box is no farther than the row's bound, by a walk down the tree for all rows at once."""
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        found_rows, found = [], []
        while len(rows):
            near = self.metric.least(x[rows], self.lo[node], self.hi[node]) <= bound[rows] * SLACK
            rows, node = rows[near], node[near]
            leaf = self.dim[node] < 0
            found_rows.append(rows[leaf])
            found.append(self.cell[node[leaf]])
            rows = np.repeat(rows[~leaf], 2)
            node = (self.child[node[~leaf]][:, None] + np.arange(2)).ravel()
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(found_rows), np.concatenate(found)

    def sure_bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which at least k vectors lie, from the boxes' far ends and sizes; infinite if there are fewer."""
        used = np.flatnonzero((self.dim < 0) & (self.hi >= self.lo).all(axis=1))
        if not len(used):
            return np.full(len(x), np.inf)
        far = self.metric.most(x[:, None, :], self.lo[None, used], self.hi[None, used])
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(self.size[self.cell[used]][order], axis=1) >= k
        at = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
        return np.where(enough[:, -1], at, np.inf)


def grow(sample: np.ndarray, wanted: int, metric: Metric) -> Cells:
    """Cuts for about `wanted` cells: level by level, each node is cut near the median of its widest feature, while it has more
    sample rows than its share and not all of them are equal."""
    share = max(1, len(sample) // max(1, wanted))
    dim, cut, child = [], [], []
    level = [sample]
    made = 1
    while level:
        following = []
        for rows in level:
            lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            if len(rows) <= share or (lo == hi).all():
                dim.append(-1), cut.append(0.0), child.append(0)
                continue
            d = int(np.argmax(metric.spread(lo, hi)))
            values = np.sort(rows[:, d])
            at = values[(len(values) - 1) // 2]
            if at == values[-1]:  # more than half are the largest value: cut below it
                at = values[np.searchsorted(values, at) - 1]
            dim.append(d), cut.append(float(at)), child.append(made)
            made += 2
            right = rows[:, d] > at
            following += [rows[~right], rows[right]]
        level = following
    dims = np.asarray(dim, dtype=np.int64)
    cell = np.where(dims < 0, np.cumsum(dims < 0) - 1, 0)
    return Cells(metric, dims, np.asarray(cut), np.asarray(child, dtype=np.int64), cell)
