"""Small dense problems that remain on the driver once the data are compressed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MAX_STEP = 5.0
PROBABILITY_MARGIN = 1e-9
LOG_RATE_BOUND = 30.0


def wls(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted least squares by the minimum-norm solution of the scaled design."""
    root = np.sqrt(np.asarray(n, dtype=float))
    y = np.asarray(y, dtype=float)
    return np.linalg.lstsq(x * root[:, None], y * (root if y.ndim == 1 else root[:, None]), rcond=None)[0]


def ridge_closed_form(x: np.ndarray, y: np.ndarray, n: np.ndarray, lam: float, penalize: np.ndarray | None = None) -> np.ndarray:
    """Minimises sum n (y - x b)^2 + lam sum b^2; ``penalize`` marks the coefficients in the penalty (default all)."""
    root = np.sqrt(np.asarray(n, dtype=float))[:, None]
    y = np.asarray(y, dtype=float)
    y = y[:, None] if y.ndim == 1 else y
    p = x.shape[1]
    marks = np.ones(p) if penalize is None else np.asarray(penalize, dtype=float)
    design = np.vstack([x * root, np.sqrt(lam) * np.diag(marks)])
    out = np.linalg.lstsq(design, np.vstack([y * root, np.zeros((p, y.shape[1]))]), rcond=None)[0]
    return out[:, 0] if out.shape[1] == 1 else out


def ridge_closed_form_batch(x: np.ndarray, y: np.ndarray, n: np.ndarray, lams: Sequence[float], penalize: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (penalties, terms) for all penalties."""
    if penalize is not None and not np.all(penalize):
        return np.array([ridge_closed_form(x, y, n, lam, penalize) for lam in lams])
    root = np.sqrt(np.asarray(n, dtype=float))
    u, s, vt = np.linalg.svd(x * root[:, None], full_matrices=False)
    uy = u.T @ (np.asarray(y, dtype=float) * root)
    keep = s > s.max(initial=0) * max(x.shape) * np.finfo(float).eps
    return np.array([vt.T @ np.where(keep | (lam > 0), s / np.maximum(s * s + lam, 1e-300) * uy, 0.0) for lam in lams])


def sigmoid(z: np.ndarray) -> np.ndarray:
    """Logistic function without overflow."""
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def softmax(z: np.ndarray) -> np.ndarray:
    """Row-wise softmax without overflow."""
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def newton_step(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solution of h d = g; a singular h is made definite by a small ridge."""
    try:
        return np.linalg.solve(h, g)
    except np.linalg.LinAlgError:
        return np.linalg.solve(h + 1e-10 * np.eye(len(h)), g)


def iterate(beta, parts, max_iter, tol):
    """Newton steps of bounded size from ``beta`` until one is below ``tol``."""
    for _ in range(max_iter):
        g, h = parts(beta)
        step = newton_step(h, g)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, MAX_STEP / size if size > 0 else 1.0)
        if size < tol:
            break
    return beta


def logistic_parts(x, n, s, beta):
    """Score and information of grouped binary outcomes."""
    p = np.clip(sigmoid(x @ beta), PROBABILITY_MARGIN, 1 - PROBABILITY_MARGIN)
    return x.T @ (s - n * p), (x * (n * p * (1 - p))[:, None]).T @ x


def poisson_parts(x, n, s, beta):
    """Score and information of grouped counts."""
    m = n * np.exp(np.clip(x @ beta, -LOG_RATE_BOUND, LOG_RATE_BOUND))
    return x.T @ (s - m), (x * m[:, None]).T @ x


def logistic_newton(x, n, s, max_iter=100, tol=1e-10):
    """Maximum likelihood from successes s among n trials per design row."""
    return iterate(np.zeros(x.shape[1]), lambda b: logistic_parts(x, n, s, b), max_iter, tol)


def poisson_newton(x, n, s, max_iter=100, tol=1e-10):
    """Maximum likelihood from sums s of n counts per design row; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(s.sum() / max(n.sum(), 1e-300), 1e-8))
    return iterate(beta, lambda b: poisson_parts(x, n, s, b), max_iter, tol)


def multinomial_parts(x, counts, flat):
    """Score and information of all but the last (baseline) class, stacked by class."""
    k, p = counts.shape[1] - 1, x.shape[1]
    total = counts.sum(axis=1)
    prob = softmax(np.column_stack((x @ flat.reshape(k, p).T, np.zeros(len(x)))))[:, :k]
    g = ((counts[:, :k] - total[:, None] * prob).T @ x).ravel()
    h = np.empty((k * p, k * p))
    for a in range(k):
        for b in range(a, k):
            w = total * prob[:, a] * ((a == b) - prob[:, b])
            h[a * p : (a + 1) * p, b * p : (b + 1) * p] = block = (x * w[:, None]).T @ x
            h[b * p : (b + 1) * p, a * p : (a + 1) * p] = block.T
    return g, h


def multinomial_newton(x, counts, max_iter=100, tol=1e-10):
    """Coefficients (classes - 1, terms) relative to the last class, by joint Newton steps."""
    k, p = counts.shape[1] - 1, x.shape[1]
    return iterate(np.zeros(k * p), lambda b: multinomial_parts(x, counts, b), max_iter, tol).reshape(k, p)


def gram_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of normal equations."""
    return np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
