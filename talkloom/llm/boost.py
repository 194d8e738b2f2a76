"""Gradient-boosted trees for two classes, fitted on a bounded sample and scored as a Column.

The sample is small by contract (the caller bounds it), so fitting runs in NumPy on the
driver; scoring is a sum of CASE expressions and runs inside code generation on every row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F


#: Stands for null and NaN in scoring.
BELOW_ALL = -1e300


class Boosted:
    """Trees over named features. NaN and null go to a bin of their own, below all values."""

    def __init__(self, features: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20):
        self.features, self.n_trees, self.depth, self.rate, self.bins, self.least = features, trees, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """x: rows by features, y: 0 or 1. With no rows, or with one class only, the score is constant."""
        x, y = np.asarray(x, float).reshape(-1, len(self.features)), np.asarray(y, float)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if len(y) < 2 * self.least or y.min() == y.max():
            return self
        self.cuts = [self._cuts(c) for c in x.T]
        binned = np.stack([np.where(np.isnan(c), 0, np.searchsorted(k, c, side="left") + 1) for c, k in zip(x.T, self.cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            score += self._values(tree, binned)
        return self

    def _cuts(self, c: np.ndarray) -> np.ndarray:
        """Values v of which "x <= v" may be asked."""
        there = c[~np.isnan(c)]
        return np.unique(np.quantile(there, np.linspace(0, 1, self.bins), method="lower"))[:-1] if len(there) else there

    def _leaf(self, g: float, h: float) -> float:
        return float(self.rate * g / (h + 1.0))

    def _grow(self, b, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if depth and len(rows) >= 2 * self.least:
            for f in range(b.shape[1]):
                size = len(self.cuts[f]) + 2
                col = b[rows, f]
                n, gl, hl = (np.cumsum(np.bincount(col, w, size))[:-1] for w in (None, g[rows], h[rows]))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k))
        if best[1] is None:
            return self._leaf(gs, hs)
        f, k = best[1]
        left = b[rows, f] <= k
        return (f, k, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _values(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, k, low, high = tree
        return np.where(b[:, f] <= k, self._values(low, b), self._values(high, b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.features))
        if not self.trees:
            return np.full(len(x), self.base)
        b = np.stack([np.where(np.isnan(c), 0, np.searchsorted(k, c, side="left") + 1) for c, k in zip(x.T, self.cuts)], 1)
        return self.base + sum(self._values(t, b) for t in self.trees)

    @staticmethod
    def ready(feature: str) -> Column:
        """A feature's column as score(prefix) expects it: a double, with BELOW_ALL for null and NaN."""
        c = F.col(feature).cast("double")
        return F.when(c.isNull() | F.isnan(c), BELOW_ALL).otherwise(c)

    def score(self, prefix: str = "") -> Column:
        """The log odds as a Column over the columns prefix + feature, which hold what ready() gives.

        Nulls are told by one comparison per node, as they are written out once per feature before.
        """
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, k, low, high = tree
            asked = F.col(prefix + self.features[f]) <= F.lit(float(self.cuts[f][k - 1]) if k else BELOW_ALL)
            return F.when(asked, node(low)).otherwise(node(high))

        return reduce(lambda a, b: a + b, [node(t) for t in self.trees], F.lit(self.base))
