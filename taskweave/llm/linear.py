"""Logistic regression on sparse binary features, for a bounded sample in one task."""

from __future__ import annotations

import numpy as np


class Rows:
    """Binary feature rows: the features of all rows, one after another, and where each row starts."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.features = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.features], minlength=len(self))

    def turned(self, values: np.ndarray, n: int) -> np.ndarray:
        """Of each feature the sum of its rows' values."""
        return np.bincount(self.features, weights=values[self.row], minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, n: int, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights of ``n`` sparse features, then of the columns of ``dense``, then the intercept: nonlinear conjugate gradients with a line search."""
    x = np.concatenate([dense, np.ones((len(rows), 1))], axis=1)
    sign = np.where(y > 0, 1.0, -1.0)

    def margins(w: np.ndarray) -> np.ndarray:
        return rows.dot(w[:n]) + x @ w[n:]

    def slope(w: np.ndarray, m: np.ndarray) -> np.ndarray:
        r = -weight * sign * sigmoid(-sign * m)
        return np.concatenate([rows.turned(r, n), x.T @ r]) + penalty * np.append(w[:-1], 0.0)

    def loss(w: np.ndarray, m: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * m)).sum() + penalty / 2 * (w[:-1] @ w[:-1]))

    w = np.zeros(n + x.shape[1])
    m = margins(w)
    gradient = slope(w, m)
    scale = 1 / (np.concatenate([rows.turned(weight / 4, n), (x**2).T @ weight / 4]) + penalty)
    ahead = -scale * gradient
    for _ in range(steps):
        if not (gradient @ ahead < 0):
            ahead = -scale * gradient
        along, now = margins(ahead), loss(w, m)
        p = sigmoid(-sign * m)
        curve = (weight * p * (1 - p) * along**2).sum() + penalty * (ahead[:-1] @ ahead[:-1])
        down = gradient @ ahead
        step = min(-down / max(curve, 1e-12), 4.0)
        while step > 1e-8 and loss(w + step * ahead, m + step * along) > now + 1e-4 * step * down:
            step /= 2
        if step <= 1e-8:
            break
        w, m = w + step * ahead, m + step * along
        new = slope(w, m)
        if np.abs(new).max() < 1e-5 * max(1.0, weight.sum()):
            break
        turn = max(0.0, (scale * new) @ (new - gradient) / max((scale * gradient) @ gradient, 1e-30))
        ahead, gradient = -scale * new + turn * ahead, new
    return w
