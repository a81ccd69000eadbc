"""Histogram gradient-boosted trees for a binary outcome, kept as flat arrays and walked by numpy for all rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete trees of one depth: node i's children are 2i+1 and 2i+2; a node without a split sends all rows left."""

    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows, z = np.arange(len(x)), np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            z += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> FlatTrees:
    """Newton boosting of the logistic loss, level by level, over quantile bins.

    No rows, or one class only, give no splits and the smoothed share of the positive class.
    """
    n = len(y)
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if n == 0 or y.min() == y.max():
        return FlatTrees(0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), start)
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])  # bin b: edges[b-1] < x <= edges[b]
    z = np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node, best = at - first, np.full(width, 1e-6)
            for j in range(k):
                cell = node * bins + binned[j]
                gs, hs, cs = (np.bincount(cell, w, minlength=width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(cs < least) | (ct - cs < least)] = -1
                gain[:, len(edges[j]) :] = -1
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                for i in np.nonzero(top > best)[0]:
                    best[i], feature[first + i], threshold[first + i] = top[i], j, edges[j][b[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        cell = at - (2**depth - 1)
        leaf = rate * np.bincount(cell, g, minlength=2**depth) / (np.bincount(cell, h, minlength=2**depth) + ridge)
        z += leaf[cell]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return FlatTrees(depth, np.array(features), np.array(thresholds), np.array(leaves), start)
