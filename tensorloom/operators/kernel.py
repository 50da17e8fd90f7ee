"""Non-negative CP of an array that fits a task, by multiplicative updates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np

EPS = float(np.finfo(float).eps)


@dataclass
class Fit:
    weights: np.ndarray
    factors: list[np.ndarray]
    errors: list[float] = field(default_factory=list)


def start(shape: tuple[int, ...], rank: int, seed: int) -> list[np.ndarray]:
    """Random factors in [0, 1): RandomState(seed).random_sample of each mode in turn."""
    rng = np.random.RandomState(seed)
    return [rng.random_sample((n, rank)) for n in shape]


def product(x: np.ndarray, factors: list[np.ndarray], mode: int) -> np.ndarray:
    """MTTKRP by contracting one mode after another, the largest first; no Khatri-Rao matrix."""
    letters = "abcdefghijklmnop"[: x.ndim]
    held, names = x, letters
    for k in sorted((k for k in range(x.ndim) if k != mode), key=lambda k: -x.shape[k]):
        rest = names.replace(letters[k], "").replace("z", "")
        if "z" in names:
            held = np.einsum(f"{names},{letters[k]}z->{rest}z", held, factors[k])
        else:
            held = np.tensordot(held, factors[k], ([names.index(letters[k])], [0]))
        names = rest + "z"
    return held


def decompose(x: np.ndarray, rank: int, max_iter: int = 500, tol: float = 1e-5, seed: int = 0) -> Fit:
    """Fit one start; errors holds the relative error after each iteration.

    Stops when two errors differ by less than tol, from the second iteration on.
    """
    x = np.asarray(x, float)
    factors = start(x.shape, rank, seed)
    grams = [f.T @ f for f in factors]
    norm2 = float(np.vdot(x, x))
    fit = Fit(np.ones(rank), factors)
    last = x.ndim - 1
    for _ in range(max_iter):
        for mode in range(x.ndim):
            m = product(x, factors, mode)
            others = reduce(np.multiply, [g for k, g in enumerate(grams) if k != mode])
            factors[mode] *= np.maximum(m, EPS) / np.maximum(factors[mode] @ others, EPS)
            grams[mode] = factors[mode].T @ factors[mode]
        model = float(reduce(np.multiply, grams).sum())
        error = np.sqrt(abs(norm2 + model - 2.0 * float((m * factors[last]).sum()))) / np.sqrt(norm2) if norm2 else 0.0
        fit.errors.append(float(error))
        if len(fit.errors) > 1 and abs(fit.errors[-2] - fit.errors[-1]) < tol:
            break
    return fit


def degeneracy(grams: list[np.ndarray]) -> float:
    """Least product over the modes of the cosines of two components, from the modes' Grams; 1 for a single component."""
    total = np.ones_like(grams[0])
    for g in grams:
        norm = np.sqrt(np.diag(g))
        norm = np.where(norm > 0, norm, 1.0)
        total = total * (g / norm[:, None] / norm[None, :])
    off = total[~np.eye(len(total), dtype=bool)]
    return float(off.min()) if off.size else 1.0


def status(errors: list[float], grams: list[np.ndarray], max_iter: int) -> str:
    """accepted, or why not: a start that used all iterations counts as not converged."""
    if errors and not np.isfinite(errors[-1]):
        return "not finite"
    if len(errors) > max_iter - 1:
        return "not converged"
    return "degenerate" if degeneracy(grams) < -0.85 else "accepted"


def match_score(cosines: np.ndarray) -> tuple[float, list[int]]:
    """Best one-to-one matching of components: mean product of |cosines| over the modes (modes x R x R).

    Exact, by the Hungarian method: rows are matched one after another along shortest
    augmenting paths over reduced costs, in O(R^3).
    """
    c = np.abs(np.asarray(cosines)).prod(axis=0)
    cost, rank = -c, len(c)
    row_price, col_price = np.zeros(rank), np.zeros(rank)
    row_of = np.full(rank, -1)
    for row in range(rank):
        least, came, done = np.full(rank, np.inf), np.full(rank, -1), np.zeros(rank, bool)
        path, col, far, r = [], -1, 0.0, row
        while True:  # grow the tree of tight edges until it meets a free column
            reach = far + cost[r] - row_price[r] - col_price
            better = ~done & (reach < least)
            least[better], came[better] = reach[better], col
            col = int(np.where(done, np.inf, least).argmin())
            far, r = least[col], row_of[col]
            done[col] = True
            path.append(col)
            if r < 0:
                break
        for k in path[:-1]:
            row_price[row_of[k]] += far - least[k]
            col_price[k] -= far - least[k]
        row_price[row] += far
        while col >= 0:
            before = came[col]
            row_of[col] = row_of[before] if before >= 0 else row
            col = before
    order = np.argsort(row_of).tolist()
    return float(c[np.arange(rank), order].mean()), order
