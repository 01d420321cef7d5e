"""Gradient-boosted regression trees over binned features, and isotonic calibration. Small enough to be trained in one process."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 at a leaf), threshold, left child, right child, value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            down = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
            at = np.where(inner, down, at)


class BoostedTrees:
    """Least-squares boosting; each tree is grown level by level from histograms of the residuals."""

    def __init__(self, *, trees: int = 80, depth: int = 3, rate: float = 0.1, least_rows: int = 8):
        self.n_trees, self.depth, self.rate, self.least_rows = trees, depth, rate, least_rows
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        cell = binned + np.arange(m) * BINS
        self.base = float(y.mean())
        now = np.full(n, self.base)
        for _ in range(self.n_trees):
            residual = y - now
            tree = Tree()
            level = [(tree.add(float(residual.mean())), np.arange(n))]
            for _ in range(self.depth):
                below = []
                for node, rows in level:
                    best = self._split(cell[rows], residual[rows], m)
                    if best is None:
                        continue
                    j, b = best
                    tree.feature[node], tree.threshold[node] = j, float(edges[j][b])
                    go = binned[rows, j] <= b
                    for side, part in (("left", rows[go]), ("right", rows[~go])):
                        child = tree.add(float(residual[part].mean()))
                        getattr(tree, side)[node] = child
                        below.append((child, part))
                level = below
            now = now + self.rate * tree.predict(x)
            self.trees.append(tree)
        return self

    def _split(self, cell: np.ndarray, residual: np.ndarray, m: int) -> tuple[int, int] | None:
        n = len(residual)
        if n < 2 * self.least_rows:
            return None
        flat = cell.ravel()
        count = np.bincount(flat, minlength=m * BINS).reshape(m, BINS).cumsum(axis=1)
        total = np.bincount(flat, weights=np.repeat(residual, m), minlength=m * BINS).reshape(m, BINS).cumsum(axis=1)
        rest, whole = n - count, total[:, -1:]
        fits = (count >= self.least_rows) & (rest >= self.least_rows)
        gain = np.where(fits, total**2 / np.maximum(count, 1) + (whole - total) ** 2 / np.maximum(rest, 1), -np.inf)
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, b] <= residual.sum() ** 2 / n + 1e-9:
            return None
        # where few rows leave room between the two sides, the middle of the room
        tied = np.flatnonzero(gain[j] >= gain[j, b] * (1 - 1e-12))
        return int(j), int(tied[(len(tied) - 1) // 2])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function of x that fits y best (pool adjacent violators); read between them by interpolation."""
    order = np.argsort(x, kind="stable")
    means: list[float] = []
    weights: list[int] = []
    places: list[float] = []
    for i in order:
        means.append(float(y[i]))
        weights.append(1)
        places.append(float(x[i]))
        while len(means) > 1 and means[-2] >= means[-1]:
            w = weights[-2] + weights[-1]
            m = (means[-2] * weights[-2] + means[-1] * weights[-1]) / w
            p = (places[-2] * weights[-2] + places[-1] * weights[-1]) / w
            del means[-2:], weights[-2:], places[-2:]
            means.append(m)
            weights.append(w)
            places.append(p)
    return np.array(places), np.array(means)
