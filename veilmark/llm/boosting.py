"""Gradient-boosted regression trees for binary labels, small enough for the driver and fast on arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, depth-limited trees grown level by level on quantile bins, Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.edges = 0.0, []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b, n, width = self._binned(x), len(y), self.bins + 1
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-9)
                for k in range(b.shape[1]):
                    key = (node - first) * width + b[:, k]
                    gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                    hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best = np.where(better, top, best)
                    feature[first : first + count] = np.where(better, k, feature[first : first + count])
                    cut[first : first + count] = np.where(better, at, cut[first : first + count])
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return f
