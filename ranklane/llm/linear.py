"""Ridge-penalised logistic regression, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np

L2 = 1.0


def fit(x: np.ndarray, y: np.ndarray, l2: float = L2, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept last) of a logistic regression with a ridge around ``prior`` (else 0), by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    ridge = np.full(x.shape[1], l2)
    if not prior.any():
        ridge[-1] = 1e-6  # without a prior the intercept is free
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
