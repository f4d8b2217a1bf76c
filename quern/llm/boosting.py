"""Gradient-boosted trees for two classes: histogram splits, logistic loss, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees: inner nodes in level order, then leaves; a row goes right if its feature exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Trees fitted to labels 0 and 1."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    score = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            for j in range(width):
                if not len(edges[j]):
                    continue
                size = len(edges[j]) + 1
                at = (node - first) * size + binned[:, j]
                g = np.bincount(at, gradient, count * size).reshape(count, size).cumsum(1)
                h = np.bincount(at, weight, count * size).reshape(count, size).cumsum(1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
                gain = gain[:, :-1]
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = j
                threshold[first : first + count][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        leaf = rate * np.bincount(own, gradient, leaves) / (np.bincount(own, weight, leaves) + ridge)
        score += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return BoostedTrees(np.array(features), np.array(thresholds), np.array(values), base, depth)
