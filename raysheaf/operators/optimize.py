"""Bounded fluence optimization: L-BFGS on the driver over bixel weights, evaluations on Spark.

The driver holds vectors with one number per bixel, a plan's few thousand parameters, and
nothing of voxel size. The matrix is packed to row blocks once and kept (``rowblocks``); a step of
the line search is evaluated together with those that may follow it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .objectives import Hotspot
from .rowblocks import Evaluate, Objective


@dataclass
class Result:
    weights: np.ndarray
    objective: float
    iterations: int
    converged: bool
    log: list[float] = field(default_factory=list)


def direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """AK-25: two loops over (s, y) pairs, the oldest first."""
    q, alphas = g.copy(), []
    for s, y in reversed(steps):
        a = s @ q / (y @ s)
        alphas.append(a)
        q -= a * y
    if steps:
        s, y = steps[-1]
        q *= s @ y / (y @ y)
    for (s, y), a in zip(steps, reversed(alphas), strict=True):
        q += (a - y @ q / (y @ s)) * s
    return -q


def minimise(evaluate: Evaluate, n: int, low: float, high: float, iterations: int = 400, memory: int = 10, tolerance: float = 1e-5, evaluations: int = 20, start: np.ndarray | None = None) -> Result:
    """AK-24 to AK-28: from zeros; projected directions, Wolfe line search with the best Armijo step as a fallback, reset of the memory up to five times."""
    x = np.full(n, max(low, 0.0)) if start is None else np.clip(start, low, high)
    f, g = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    log, resets, stalls = [f], 0, 0
    for it in range(1, iterations + 1):
        norm = float(np.abs(x - np.clip(x - g, low, high)).max(initial=0.0))
        if norm < tolerance:
            return Result(x, f, it - 1, True, log)
        d = direction(g, steps)
        d[((x <= low + 1e-10) & (d < 0)) | ((x >= high - 1e-10) & (d > 0))] = 0.0  # AK-26
        if d @ g >= 0:
            steps, d = [], -g
            d[((x <= low + 1e-10) & (d < 0)) | ((x >= high - 1e-10) & (d > 0))] = 0.0
        found = _search(evaluate, x, f, g, d, low, high, evaluations, 1.0 if steps else min(1.0, 1.0 / max(np.abs(d).max(), 1e-12)))
        if found is None:
            resets += 1
            if resets > 5 or not steps:
                return Result(x, f, it, norm < 100 * tolerance, log)
            steps = []
            continue
        x1, f1, g1 = found
        s, y = x1 - x, g1 - g
        if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps, (s, y)][-memory:]
        stalls = stalls + 1 if abs(f - f1) <= 1e-12 * max(1.0, abs(f)) else 0
        small = abs(f - f1) < 1e-7 * max(abs(f), 1e-12)
        x, f, g = x1, f1, g1
        log.append(f)
        if len(log) > 16 and abs(log[-16] - f) < 1e-9 * max(abs(log[-16]), 1e-12):  # WN-10
            steps = []
        if stalls >= 15 or (small and float(np.abs(x - np.clip(x - g, low, high)).max(initial=0.0)) < 100 * tolerance):
            return Result(x, f, it, True, log)
    return Result(x, f, iterations, False, log)


def _search(evaluate: Evaluate, x, f, g, d, low, high, evaluations, step, c1=1e-4, c2=0.9):
    """AK-27: bisection and doubling to a step with sufficient decrease and curvature. If ``evaluate`` takes ``many`` at once, a step is evaluated together with the two that may follow it."""
    slope, bottom, top, best, known = float(g @ d), 0.0, np.inf, None, {}

    def shorter(s: float) -> float:
        return (bottom + s) / 2

    def longer(s: float) -> float:
        return 2 * s if np.isinf(top) else (s + top) / 2

    for _ in range(evaluations):
        if step not in known:
            steps = list(dict.fromkeys((step, shorter(step), longer(step)))) if hasattr(evaluate, "many") else [step]
            points = [np.clip(x + s * d, low, high) for s in steps]
            values = evaluate.many(points) if len(points) > 1 else [evaluate(points[0])]
            known |= {s: (p, *found) for s, p, found in zip(steps, points, values, strict=True)}
        x1, f1, g1 = known[step]
        if f1 > f + c1 * step * slope:
            step, top = shorter(step), step
        else:
            if best is None or f1 < best[1]:
                best = (x1, f1, g1)
            if float(g1 @ d) >= c2 * slope:
                return best
            step, bottom = longer(step), step
    return best


def most_fluence(dij: DataFrame, prescription: float) -> float:
    """SF-24: upper bound of the weights."""
    top = dij.agg(F.max("value")).first()[0] or 0.0
    return 2 * prescription / top if top > 0 else 1000.0


def optimised(dij: DataFrame, bixels: list[int], voxels: DataFrame, objectives: DataFrame, goals: DataFrame, spot: Hotspot | None = None, prescription: float = 66.0, iterations: int = 400, tolerance: float = 1e-5, **penalties) -> Result | None:
    """AK-29: weights of a plan, None without objectives. The hot-spot penalty is part of it only if ``spot`` is given."""
    evaluate = Objective(dij, bixels, voxels, objectives, goals, spot, **penalties)
    try:
        return minimise(evaluate, len(bixels), 0.0, most_fluence(dij, prescription), iterations=iterations, tolerance=tolerance) if evaluate.lines else None
    finally:
        evaluate.release()
