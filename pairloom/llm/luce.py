"""Iterative Luce spectral ranking of one bounded block of a comparison graph, in NumPy."""

from __future__ import annotations

import numpy as np

#: Krylov vectors before a restart.
KRYLOV = 30
#: Sizes of the mixed answers' weights together; their sum is 1.
MOST_WEIGHT = 30.0


def stationary(src: np.ndarray, dst: np.ndarray, step: np.ndarray, start: np.ndarray, inflow: np.ndarray, tolerance: float, most: int = 100) -> np.ndarray:
    """Flow x with x = P'x + inflow by restarted GMRES, from ``start``.

    ``step`` are the jump chain's probabilities from ``src`` to ``dst``.  Without
    inflow every Krylov vector sums to nought on each component, so the flow of
    each component stays what it is in ``start``.
    """
    n = len(start)

    def apply(v: np.ndarray) -> np.ndarray:
        return v - np.bincount(dst, v[src] * step, n)

    x = start.copy()
    size = np.abs(x).sum()
    for _ in range(most):
        residual = inflow - apply(x)
        norm = np.linalg.norm(residual)
        if np.abs(residual).sum() <= tolerance * size or norm == 0:
            break
        basis = np.zeros((KRYLOV + 1, n))
        h = np.zeros((KRYLOV + 1, KRYLOV))
        basis[0] = residual / norm
        used = 0
        for k in range(KRYLOV):
            v = apply(basis[k])
            for _ in range(2):
                before = np.linalg.norm(v)
                dots = basis[: k + 1] @ v
                v -= dots @ basis[: k + 1]
                h[: k + 1, k] += dots
                h[k + 1, k] = np.linalg.norm(v)
                if h[k + 1, k] > 0.7 * before:  # little was taken away, so what is left is orthogonal; else once more
                    break
            used = k + 1
            if h[k + 1, k] <= 1e-10 * np.abs(h[: k + 1, k]).max():
                break
            basis[k + 1] = v / h[k + 1, k]
        rhs = np.zeros(used + 1)
        rhs[0] = norm
        y = np.linalg.lstsq(h[: used + 1, :used], rhs, rcond=None)[0]
        x = x + y @ basis[:used]
    return x


def mixture(gram: np.ndarray) -> np.ndarray:
    """Weights of sum 1 whose combination of changes is least, from the changes' products; the last change is the newest."""
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    if size[-1] <= 1e-300 or size[-1] > 10 * size.min():  # thrown back: start again from the newest answer
        return np.eye(len(gram))[-1]
    scaled = gram / np.outer(size, size)
    z = np.linalg.lstsq(scaled + 1e-12 * np.eye(len(gram)), 1 / size, rcond=1e-12)[0] / size
    total = abs(z.sum())
    # weights that are large against their sum would throw the strengths about
    return z / z.sum() if np.isfinite(z).all() and np.abs(z).sum() <= MOST_WEIGHT * total else np.eye(len(gram))[-1]


def strengths(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: np.ndarray, ext_node: np.ndarray, ext_strength: np.ndarray, ext_out: np.ndarray, ext_in: np.ndarray, tolerance: float = 1e-9, most: int = 200) -> tuple[np.ndarray, bool]:
    """Maximum-likelihood strengths of a block's nodes, and whether they came to rest.

    ``weight`` is what ``dst`` won over ``src``.  For comparisons with nodes
    outside, whose strengths are held: ``ext_node`` lost ``ext_out`` and won
    ``ext_in`` against ``ext_strength``.  Each round rebuilds the transition
    rates weight / (sum of both strengths) and solves for the stationary flow.
    """
    n, pi = len(start), start.copy()
    if not len(src) and not len(ext_node):
        return pi, True
    inner = 1e-3
    for _ in range(most):
        rate = weight / (pi[src] + pi[dst])
        out = np.bincount(src, rate, n)
        inflow = np.zeros(n)
        if len(ext_node):
            held = ext_strength + pi[ext_node]
            out += np.bincount(ext_node, ext_out / held, n)
            inflow = np.bincount(ext_node, ext_in * ext_strength / held, n)
        out = np.where(out > 0, out, 1.0)
        step = rate / out[src]
        x = stationary(src, dst, step, pi * out, inflow, inner)
        if (x <= 0).any():  # not yet close: plain damped steps stay positive
            x = pi * out
            for _ in range(20):
                x = 0.5 * (x + np.bincount(dst, x[src] * step, n) + inflow)
        new = x / out
        change = np.abs(np.log(new) - np.log(pi)).max()
        pi = new
        if change < tolerance and inner <= tolerance * 1e-2:
            return pi, True
        inner = max(min(inner * 0.1, change * 1e-2), tolerance * 1e-2)
    return pi, False
