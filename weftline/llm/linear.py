"""Small dense linear models, fitted by Newton's method."""

from __future__ import annotations

import numpy as np

#: Rows of a block of the support vector machine.
ROWS = 1024


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights with the bias last; the bias is not penalised.  Soft labels are allowed."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, weight: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Linear support vector machine with squared hinge loss; y is -1 or 1; the bias is last.

    Sums go over blocks of rows: beside ``x`` no copy of all of it is made.
    """
    weight = np.full(len(x), c) if weight is None else weight * c
    w = np.zeros(x.shape[1] + 1)
    eye = np.eye(len(w))
    eye[-1, -1] = 1e-6
    before = np.inf
    for _ in range(rounds):
        slack = 1 - y * apply(w, x)
        on = np.flatnonzero(slack > 0)
        loss = w @ eye @ w + (weight[on] * slack[on] ** 2).sum()
        if before - loss < 1e-6 * max(1.0, before):
            break
        before = loss
        curvature, target = eye.copy(), np.zeros(len(w))
        for lo in range(0, len(on), ROWS):
            some = on[lo : lo + ROWS]
            xa = np.c_[x[some], np.ones(len(some))]
            weighted = xa * weight[some][:, None]
            curvature += weighted.T @ xa
            target += weighted.T @ y[some]
        w = np.linalg.solve(curvature, target)
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
