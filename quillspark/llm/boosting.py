"""Gradient-boosted trees for two classes, small enough to be fitted on the driver and sent to the executors."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[dict[int, tuple]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        width = max((len(e) for e in self.edges), default=0) + 1
        codes = b + np.arange(b.shape[1]) * width  # the bins of all columns side by side
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: dict[int, tuple] = {}
            node = np.ones(len(y), np.int64)
            for level in range(self.depth + 1):
                for k in range(1 << level, 1 << (level + 1)):
                    rows = np.flatnonzero(node == k)
                    if len(rows):
                        tree[k] = self._node(codes[rows], width, grad[rows], hess[rows], level == self.depth)
                for k, t in tree.items():
                    if t[0] == "split" and (1 << level) <= k < (1 << (level + 1)):
                        rows = np.flatnonzero(node == k)
                        node[rows] = 2 * k + (b[rows, t[1]] > t[2])
            self.trees.append(tree)
            score += self._leaves(b, tree)
        return self

    def _node(self, codes: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, leaf: bool) -> tuple:
        total, weight = g.sum(), h.sum() + 1.0
        if not leaf and len(g) >= 2 * self.least:
            columns = codes.shape[1]
            flat, size = codes.ravel(), columns * width
            gs, hs, cs = (np.cumsum(np.bincount(flat, v, size).reshape(columns, width), 1)[:, :-1] for v in (np.repeat(g, columns), np.repeat(h, columns), None))
            fits = (cs >= self.least) & (len(g) - cs >= self.least)
            if fits.any():
                gain = np.where(fits, gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs) - total**2 / weight, -1)
                k, at = divmod(int(gain.argmax()), width - 1)
                if gain[k, at] > 1e-6:
                    return ("split", k, at)
        return ("leaf", self.rate * total / weight)

    def _leaves(self, b: np.ndarray, tree: dict[int, tuple]) -> np.ndarray:
        """Values of the rows' leaves: all rows go down level by level; from a leaf above the last level they go left."""
        size = 1 << (self.depth + 1)
        column, cut, value = np.zeros(size, np.int64), np.full(size, self.bins, np.int64), np.zeros(size)
        for k, t in tree.items():
            if t[0] == "leaf":
                value[k << (self.depth + 1 - k.bit_length())] = t[1]
            else:
                column[k], cut[k] = t[1], t[2]
        node, flat, start = np.ones(len(b), np.int64), b.ravel(), np.arange(len(b)) * b.shape[1]
        for _ in range(self.depth):
            node = 2 * node + (flat[start + column[node]] > cut[node])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        return 1 / (1 + np.exp(-sum((self._leaves(b, t) for t in self.trees), np.full(len(b), self.base))))
