"""Linear models on sparse indicators, for bounded training samples.

A sample is a list of arrays of feature numbers; everything here is NumPy over
arrays that fit in one process, because the size of the sample is a parameter of
the operator that calls it.
"""

from __future__ import annotations

import math

import numpy as np


class Sparse:
    """Rows of distinct feature numbers, with extra dense columns."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray | None = None):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.known, at = np.unique(np.concatenate([*rows, np.zeros(0, np.int32)]), return_inverse=True)
        self.at = at.astype(np.int32)
        self.dense = np.zeros((len(rows), 0)) if dense is None else dense

    def take(self, rows: np.ndarray, dense: np.ndarray | None = None) -> "Sparse":
        out = object.__new__(Sparse)
        out.lengths = self.lengths[rows]
        out.starts = np.concatenate([[0], np.cumsum(out.lengths)])
        pieces = [self.at[self.starts[i] : self.starts[i + 1]] for i in rows]
        out.at = np.concatenate([*pieces, np.zeros(0, np.int32)])
        out.known, out.dense = self.known, self.dense[rows] if dense is None else dense
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = len(self.known)
        sums, full = np.zeros(len(self.lengths)), self.lengths > 0
        if full.any():
            sums[full] = np.add.reduceat(w[:k][self.at], self.starts[:-1][full])
        return sums + self.dense @ w[k:-1] + w[-1]

    def transposed(self, g: np.ndarray) -> np.ndarray:
        k = len(self.known)
        return np.concatenate([np.bincount(self.at, np.repeat(g, self.lengths), k), self.dense.T @ g, [g.sum()]])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product in this thread alone: a task has one core, and threads of a
    library would wait for those that other tasks hold."""
    return float((a * b).sum())


def fit_logistic(x: Sparse, y: np.ndarray, l2: float = 1e-3, steps: int = 40, scale: np.ndarray | None = None) -> np.ndarray:
    """Weights (features, dense columns, bias) of a logistic regression with an
    L2 penalty, by limited-memory BFGS. y is 0 or 1; its mean decides the bias
    where there is nothing else. With scale, a feature's value is its scale."""
    size = len(x.known) + x.dense.shape[1] + 1
    sizes = np.ones(size)
    if scale is not None:
        sizes[: len(x.known)] = scale
    w = np.zeros(size)
    n = max(1, len(y))

    def loss(w):
        z = x.dot(w * sizes)
        p = sigmoid(z)
        value = np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * _dot(w[:-1], w[:-1])
        grad = x.transposed((p - y) / n) * sizes
        grad[:-1] += l2 * w[:-1]
        return value, grad

    if not len(y):
        return w
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, d, rho in reversed(past):
            alphas.append(rho * _dot(s, q))
            q -= alphas[-1] * d
        if past:
            s, d, rho = past[-1]
            q *= _dot(s, d) / _dot(d, d)
        else:
            q *= 1 / max(1e-12, math.sqrt(_dot(grad, grad)))
        for (s, d, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * _dot(d, q))
        step, slope = 1.0, -_dot(grad, q)
        if slope >= 0:
            break
        while True:
            new = w - step * q
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, d = new - w, new_grad - grad
        if _dot(s, d) > 1e-12:
            past = [*past[-7:], (s, d, 1 / _dot(s, d))]
        done = value - new_value < 1e-6 * max(1, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w * sizes


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each feature's share among rows with y > 0 to that among the rest."""
    p, q = np.full(size, smooth), np.full(size, smooth)
    for row, sign in zip(rows, y):
        (p if sign > 0 else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_hinge(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 0.01, epochs: int = 12, seed: int = 0):
    """Linear support vectors (hinge loss) on indicators scaled by `scale`, by
    dual coordinate descent. y is 1 or -1. Returns the weights of the unscaled
    indicators and the bias."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = [v @ v + 1 for v in values]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slack = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost)
            change = (new - alpha[i]) * y[i]
            if change:
                w[r] += change * v
                bias += change
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w * scale, bias


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid from margins to the share of y = 1."""
    pos, neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margin + b)
        g = np.array([np.sum((p - target) * margin), np.sum(p - target)])
        v = p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * margin**2) + 1e-6, np.sum(v * margin)], [np.sum(v * margin), np.sum(v) + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -5, 5), b - np.clip(d[1], -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)
