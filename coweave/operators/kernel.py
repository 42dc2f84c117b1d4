"""Coordinate descent for one target item: min 1/2 |x_i - X w|^2 + lambd sum(w) + beta/2 sum(w^2), w >= 0, w_i = 0.

Plain numpy; nothing here knows of Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: From so many candidates on, full passes look for the next change in vectors instead of one coordinate at a time.
WIDE = 24


def solve(
    start: np.ndarray,
    diag: np.ndarray,
    row: Callable[[int], np.ndarray],
    lambd: float,
    beta: float,
    max_iter: int,
    tol: float,
) -> tuple[np.ndarray, int, bool]:
    """Weights per candidate, passes used, and whether the optimality check was met.

    ``start`` holds P_ik of the candidates k in ascending order, ``diag`` their P_kk, and ``row(t)`` gives P_kj of
    the t-th candidate over all candidates (its own place included); rows are asked for once and only when that weight moves.

    Full passes run over all candidates until weights settle, passes in between over the positive ones only. The
    problem counts as solved when a quiet full pass also meets the optimality conditions: no positive weight
    wants to move and no zero weight wants to enter by ``tol`` or more. A pass over either set uses up budget; the
    check does not.
    """
    m = len(start)
    w = np.zeros(m)
    if not m or not max_iter:
        return w, 0, not m
    residual = start.astype(np.float64, copy=True)
    curvature = diag + beta
    usable = curvature > 0
    divisor = np.where(usable, curvature, 1.0)
    rows: dict[int, np.ndarray] = {}

    def move(t: int, target: float) -> float:
        step = target - w[t]
        w[t] = target
        line = rows.get(t)
        if line is None:
            line = rows[t] = row(t)
        np.subtract(residual, line * step, out=residual)
        return abs(step)

    def wanted(t: int) -> float:
        return max(0.0, (float(residual[t]) + float(diag[t]) * float(w[t]) - lambd) / float(divisor[t]))

    def sweep(coords: np.ndarray) -> float:
        largest = 0.0
        for t in coords.tolist():
            if usable[t] and (target := wanted(t)) != w[t]:
                largest = max(largest, move(t, target))
        return largest

    def sweep_all() -> float:
        if m < WIDE:
            return sweep(np.arange(m))
        largest, at = 0.0, 0
        while at < m:
            target = np.maximum(0.0, (residual[at:] + diag[at:] * w[at:] - lambd) / divisor[at:])
            moving = np.flatnonzero((target != w[at:]) & usable[at:])
            if not len(moving):
                break
            t = at + int(moving[0])
            largest = max(largest, move(t, float(target[moving[0]])))
            at = t + 1
        return largest

    everything, active = True, np.empty(0, dtype=np.int64)
    passes = 0
    while passes < max_iter:
        passes += 1
        if not everything:
            everything = sweep(active) < tol
            continue
        if sweep_all() < tol:
            free = (residual - lambd - beta * w) / divisor  # the step of a weight that may also fall below zero
            violation = np.where(usable, np.where(w > 0, np.abs(free), np.maximum(free, 0.0)), 0.0)
            if violation.max() < tol:
                return w, passes, True
            active = np.flatnonzero(violation * usable + (w > 0) * usable > 0)
        else:
            active = np.flatnonzero(w > 0)
        everything = not len(active)
    return w, passes, False
