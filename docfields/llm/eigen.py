"""Leading eigenpairs of a small symmetric matrix: Householder tridiagonalisation, Sturm-count
bisection for the eigenvalues, inverse iteration with reorthogonalisation inside clusters.

The matrix is a covariance of vector components: its size is the length of one vector, whatever the
number of rows.
"""
from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Neighbouring eigenvalues closer than this part of the norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors with Q^T A Q = T, Q = H_0 H_1 ... (H_k on rows > k)."""
    a = np.array(a, float)
    m = len(a)
    reflectors = []
    for k in range(m - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size == 0.0:
            reflectors.append(v)
            continue
        v /= size
        reflectors.append(v)
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = x - 2.0 * (v @ x) * v
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def back(reflectors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Q y."""
    y = y.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        y[k + 1:] -= 2.0 * (v @ y[k + 1:]) * v
    return y


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: eigenvalues of T below each entry of ``x`` (negative pivots of T - x)."""
    tiny = max(EPS * EPS * float(np.max(e * e, initial=0.0)), np.finfo(float).tiny * 4)
    q = d[0] - x
    n = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] * e[i - 1] / q
        n += q < 0
    return n


def bounds(d: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    """Gershgorin interval that holds every eigenvalue of T."""
    r = np.zeros(len(d))
    r[:-1] += np.abs(e)
    r[1:] += np.abs(e)
    lo, hi = float((d - r).min()), float((d + r).max())
    slack = 2 * EPS * max(abs(lo), abs(hi)) * len(d) + np.finfo(float).tiny
    return lo - slack, hi + slack


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of T, falling, all bisected at once down to neighbouring doubles."""
    lo, hi = bounds(d, e)
    rank = len(d) - 1 - np.arange(k)  # the eigenvalue with this many below it
    low, high = np.full(k, lo), np.full(k, hi)
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        more = count_below(d, e, mid) > rank
        high, low = np.where(more, mid, high), np.where(more, low, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a zero pivot counts as ``tiny``."""
    m = len(d)
    main, up, up2, x = d - shift, np.append(e, 0.0), np.zeros(m), b.copy()
    for i in range(m - 1):
        below = e[i]
        if abs(main[i]) >= abs(below):
            if main[i] == 0.0:
                main[i] = tiny
            f = below / main[i]
            main[i + 1] -= f * up[i]
        else:
            f = main[i] / below
            main[i], up[i], main[i + 1] = below, main[i + 1], up[i] - f * main[i + 1]
            if i + 1 < m - 1:
                up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= f * x[i]
    for i in range(m - 1, -1, -1):
        if i + 1 < m:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < m:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i])
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T (columns) for falling ``values``; each is made orthogonal to those of its cluster."""
    m = len(d)
    norm = max(abs(v) for v in bounds(d, e))
    tiny = max(EPS * norm, np.finfo(float).tiny)
    rng = np.random.default_rng(0)
    out = np.zeros((m, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues get slightly different shifts, so that they give different vectors
        shift = min(float(value), shift - 10 * tiny) if j > first else float(value)
        x = rng.uniform(-1.0, 1.0, m)
        for _ in range(5):
            x = _solve(d, e, shift, x / np.linalg.norm(x), tiny)
            x /= np.abs(x).max()
            for _ in range(2):
                for i in range(first, j):
                    x -= (out[:, i] @ x) * out[:, i]
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric matrix ``a``, falling, and unit eigenvectors as rows."""
    k = min(k, len(a))
    if k == 0:
        return np.zeros(0), np.zeros((0, len(a)))
    d, e, reflectors = tridiagonal(a)
    values = leading_values(d, e, k)
    y = inverse_iteration(d, e, values)
    return values, np.stack([back(reflectors, y[:, j]) for j in range(k)])
