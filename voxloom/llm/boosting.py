"""Histogram-based gradient boosting for a binary label, fitted on counts of the different binned rows.

Spark counts the rows, so the fit in numpy on the driver sees all of them and holds each different one once; scoring runs
inside Spark tasks on whole Arrow batches.
"""

from __future__ import annotations

import numpy as np


BINS = 24


def bin_edges(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Inner cut points of one feature at its quantiles, from its different values in order and how often each occurs; values
    equal to a cut fall above it."""
    if not len(values):
        return np.zeros(0)
    upto = np.cumsum(counts)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, k(at), side="right")] for k in (np.floor, np.ceil))
    return np.unique(low + (at - np.floor(at)) * (high - low))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class BoostedTrees:
    """Depth-limited regression trees on binned features, logistic loss."""

    def __init__(self, edges: list[np.ndarray], rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0):
        self.edges, self.rounds, self.depth, self.rate, self.ridge = edges, rounds, depth, rate, ridge
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, b: np.ndarray, y: np.ndarray, n: np.ndarray) -> BoostedTrees:
        """``b``: binned rows, each of which occurs ``n`` times with label ``y``."""
        p = ((n * y).sum() + 0.5) / (n.sum() + 1.0)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(z)
            tree, step = self._grow(b, n * (y - p), n * p * (1 - p))
            self.trees.append(tree)
            z += step
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """One complete binary tree: node k has children 2k+1 and 2k+2."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(g), int)
        width = max((len(e) for e in self.edges), default=0) + 1
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = self.rate * gs / (hs + self.ridge)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                cg = np.bincount(b[rows, j], g[rows], width).cumsum()[: len(e)]
                ch = np.bincount(b[rows, j], h[rows], width).cumsum()[: len(e)]
                gain = cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - gs**2 / (hs + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        return (feature, cut, value), value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        return self.predict_binned(binned(x, self.edges)) if len(x) else np.zeros(0)

    def predict_binned(self, b: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(b), self.base), np.arange(len(b))
        for feature, cut, value in self.trees:
            at = np.zeros(len(b), int)
            for _ in range(self.depth):
                f = feature[at]
                down = f >= 0
                at = np.where(down, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]), at)
            z += value[at]
        return sigmoid(z)
