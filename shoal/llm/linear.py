"""Small linear models fitted on bounded samples, and per-document sums over token chunks."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft targets, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum()

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(rounds):
        p = sigmoid(x @ b)
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-3 and (new := loss(b - size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - new < 1e-7 * max(1.0, abs(now)):
            break
        b, now = b - size * step, new
    return b


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, scale) of each column; constant columns keep scale 1."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    s = x.std(axis=0)
    return x.mean(axis=0), np.where(s > 1e-9, s, 1.0)


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve, ties at half."""
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    v, at, n = np.unique(s[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(at + (n + 1) / 2, n)
    pos = y == 1
    a, b = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - a * (a + 1) / 2) / (a * b)) if a and b else float("nan")


def per_row(mask: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) mask over each row's range, rel being the bounds."""
    run = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=run[1:])
    return run[rel[1:]] - run[rel[:-1]]
