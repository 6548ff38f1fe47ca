"""Non-negative least squares of many rows at once by block principal pivoting, for any number of components.

Each row has a passive set of components that may be positive. A round solves the normal equations of every row on its
set, then exchanges the components that break the optimality conditions: all of them as long as their number falls,
the last one only when it has not fallen for three rounds, which cannot cycle. Rows with the same set share a solution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Amounts and gradients beyond this share of a row's scale count as negative.
TOLERANCE = 1e-12
Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _steady(gram: np.ndarray) -> np.ndarray:
    """Gram matrices with a ridge of 1e-13 of their scale where components are so alike that solutions are not unique."""
    k = gram.shape[-1]
    with np.errstate(all="ignore"):
        shaky = ~(np.linalg.cond(gram) < 1e12)
    scale = np.maximum(np.trace(gram, axis1=-2, axis2=-1) / max(k, 1), 1e-300)
    return gram + (np.where(shaky, 1e-13 * scale, 0.0) + 1e-300)[..., None, None] * np.eye(k)


def _pivot(solve: Solver, product: Solver, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of all rows and which rows are optimal; `solve(rows, passive)` and `product(rows, c)` know the matrices."""
    n, k = rhs.shape
    c = np.zeros((n, k))
    passive = np.zeros((n, k), dtype=bool)
    fewest, chances = np.full(n, k + 1), np.full(n, 3)
    level = np.abs(rhs).max(axis=1, initial=0.0)
    gradient = -rhs
    live = np.arange(n)
    for _ in range(30 + k):  # a few rounds do, unless components are so alike that rounding decides
        own = passive[live]
        top = np.abs(c[live]).max(axis=1, initial=0.0)
        wrong = np.where(own, c[live] < -TOLERANCE * top[:, None], gradient[live] < -TOLERANCE * level[live][:, None])
        count = wrong.sum(axis=1)
        live, wrong, count = live[count > 0], wrong[count > 0], count[count > 0]
        if not len(live):
            break
        fell = count < fewest[live]
        fewest[live] = np.where(fell, count, fewest[live])
        chances[live] = np.where(fell, 3, chances[live] - 1)
        alone = chances[live] < 0
        last = np.zeros_like(wrong)
        last[np.arange(len(live)), k - 1 - wrong[:, ::-1].argmax(axis=1)] = True
        passive[live] ^= np.where(alone[:, None], last, wrong)
        c[live] = solve(live, passive[live])
        gradient[live] = product(live, c[live]) - rhs[live]
    good = np.ones(n, dtype=bool)
    good[live] = False
    return np.maximum(c, 0.0), good


def _one_by_one(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """One row by the active-set method that lets in the steepest component and never leaves the feasible region."""
    k = len(rhs)
    c, passive = np.zeros(k), np.zeros(k, dtype=bool)
    barred = np.zeros(k, dtype=bool)
    for _ in range(3 * k):
        down = rhs - gram @ c
        down[passive | barred] = -np.inf
        j = int(down.argmax())
        if down[j] <= 1e-10 * max(np.abs(rhs).max(), 1e-300):
            break
        passive[j] = True
        first = True
        while passive.any():
            z = np.zeros(k)
            z[passive] = np.linalg.solve(gram[np.ix_(passive, passive)], rhs[passive])
            if first and z[j] <= 0:  # rounding let it in; it waits until another component has moved
                passive[j], barred[j] = False, True
                break
            first = False
            out = passive & (z <= 0)
            if not out.any():
                c, barred[:] = z, False
                break
            ratio = np.where(out, c / np.maximum(c - z, 1e-300), np.inf)
            c = np.maximum(c + ratio.min() * (z - c), 0.0)
            passive &= (c > 0) & (ratio > ratio.min())  # at least one leaves, whatever rounding says
            c[~passive] = 0.0
    return c


def nnls_gram(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Rows c >= 0 that minimise c G c' / 2 - c rhs', for all rows of `rhs` and one matrix G = B B'."""
    n, k = rhs.shape
    if not n or not k:
        return np.zeros((n, k))
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))  # components of equal length, so that one tolerance fits all
    scale[np.diag(gram) <= 0] = 0.0
    unit = _steady(gram * scale[:, None] * scale[None, :])
    r = rhs * scale

    def solve(rows: np.ndarray, passive: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), k))
        packed = np.packbits(passive, axis=1)
        _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(which.ravel()))
        for at, begin, end in zip(first, ends - np.bincount(which.ravel()), ends):
            on = np.flatnonzero(passive[at])
            if len(on):
                mine = order[begin:end]
                out[np.ix_(mine, on)] = np.linalg.solve(unit[np.ix_(on, on)], r[rows[mine]][:, on].T).T
        return out

    c, good = _pivot(solve, lambda rows, own: own @ unit, r)
    for i in np.flatnonzero(~good):
        c[i] = _one_by_one(unit, r[i])
    return c * scale


def nnls_rows(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows c >= 0 that minimise |x - c B|, for all rows at once and any number of components."""
    return nnls_gram(basis @ basis.T, x @ basis.T)


def nnls_each(x: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """The same for rows that each have a basis of their own (rows x components x channels)."""
    n, k = bases.shape[:2]
    if not n or not k:
        return np.zeros((n, k))
    gram, rhs = np.einsum("rin,rjn->rij", bases, bases), np.einsum("rn,rin->ri", x, bases)
    size = np.einsum("rii->ri", gram)
    scale = np.where(size > 0, 1.0 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
    unit = _steady(gram * scale[:, :, None] * scale[:, None, :])
    r = rhs * scale
    eye = np.eye(k)

    def solve(rows: np.ndarray, passive: np.ndarray) -> np.ndarray:
        both = passive[:, :, None] & passive[:, None, :]
        return np.linalg.solve(np.where(both, unit[rows], eye), np.where(passive, r[rows], 0.0)[:, :, None])[:, :, 0]

    c, good = _pivot(solve, lambda rows, own: np.einsum("ri,rij->rj", own, unit[rows]), r)
    for i in np.flatnonzero(~good):
        c[i] = _one_by_one(unit[i], r[i])
    return c * scale


def kkt_residual(c: np.ndarray, x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """How far each row is from optimal: the largest negative amount, downhill gradient or product of both, by scale."""
    size = np.sqrt(np.maximum(np.diag(basis @ basis.T), 1e-300))
    gradient = ((c @ basis - x) @ basis.T) / size
    amount = c * size
    level = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-150)[:, None]
    worst = np.maximum(np.maximum(-gradient / level, -amount / level), np.abs(gradient * amount) / level ** 2)
    return worst.max(axis=1, initial=0.0)
