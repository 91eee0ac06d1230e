"""Small linear models on dense rows: softmax regression and support vector machines."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (columns and constant, classes) by accelerated gradient steps on the weighted loss; every
    class has the same weight."""
    x = with_one(x)
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)[y] / classes
    goal = np.eye(classes)[y] * share[:, None]
    # The curvature is at most half the greatest eigenvalue of the weighted second moments.
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v)
    step = 1 / (0.5 * np.linalg.norm(x.T @ (share * (x @ v))) + penalty)
    w = ahead = np.zeros((x.shape[1], classes))
    for k in range(rounds):
        slope = x.T @ (softmax(x @ ahead) * share[:, None] - goal) + penalty * ahead
        new = ahead - step * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights and constant of the squared-hinge machine for labels -1 and 1, by dual coordinate descent."""
    x = with_one(x)
    price = cost * len(y) / (2 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))
    diagonal = (x * x).sum(axis=1) + 1 / (2 * price)
    dual, w = np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            slope = y[i] * (x[i] @ w) - 1 + dual[i] / (2 * price[i])
            new = max(dual[i] - slope / diagonal[i], 0.0)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return w
