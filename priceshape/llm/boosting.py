"""Histogram gradient-boosted trees in numpy, stored as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, level by level; a closed node sends everything left."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # same shape; x > threshold goes right
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all rows of a tree level at once."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def splits(left_g: np.ndarray, left_h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and bin of the best split of each node, and whether it gains anything; the sums (nodes,
    features, bins) are over the bins up to each."""
    nodes, _, bins = left_g.shape
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    gain = (left_g**2 / (left_h + ridge)
            + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge))
    gain[(left_h < least) | (all_h - left_h < least)] = -1
    gain = gain[:, :, :-1].reshape(nodes, -1)
    best = gain.argmax(1)
    return *np.divmod(best, bins - 1), gain[np.arange(nodes), best] > 1e-6


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, bins: int = 48,
        rate: float = 0.15, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order splits on quantile bins; ``least`` is the hessian of a child."""
    n, features = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0:
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower").T
    binned = np.empty((n, features), dtype=np.int64)
    for f in range(features):
        binned[:, f] = np.searchsorted(cuts[f], x[:, f], side="left")  # bin b holds x <= cuts[b]
    flat = binned + np.arange(features) * bins
    margin = np.full(n, base)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = (flat + (node * (features * bins))[:, None]).ravel()
            shape = (nodes, features, bins)
            size = nodes * features * bins
            left_g = np.bincount(key, np.repeat(g, features), size).reshape(shape).cumsum(2)
            left_h = np.bincount(key, np.repeat(h, features), size).reshape(shape).cumsum(2)
            f, b, good = splits(left_g, left_h, ridge, least)
            feature[first:first + nodes] = np.where(good, f, 0)
            threshold[first:first + nodes] = np.where(good, cuts[f, b], np.inf)
            node = 2 * node + (x[np.arange(n), feature[first + node]] > threshold[first + node])
        sum_g = np.bincount(node, g, inner + 1)
        sum_h = np.bincount(node, h, inner + 1)
        leaf = -rate * sum_g / (sum_h + ridge)
        margin += leaf[node]
        made.append((feature, threshold, leaf))
    return Trees(base, *(np.array([m[i] for m in made]) for i in range(3)))
