"""A quasi-Newton minimiser whose function is an aggregation over a table."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

Parameters = dict[str, np.ndarray]


class Minimum(NamedTuple):
    x: Parameters
    value: float
    iterations: int
    converged: bool


def minimize(function: Callable[[Parameters], tuple[float, Parameters]], start: Parameters, iterations: int = 100, tolerance: float = 1e-6, memory: int = 10) -> Minimum:
    """L-BFGS with backtracking.  ``function`` gives a value and gradients by name; only those reach the driver.

    It has converged when no gradient is beyond ``tolerance``, or when no step lowers the value any more.
    """
    shapes = {k: np.shape(v) for k, v in start.items()}

    def flat(p: Parameters) -> np.ndarray:
        return np.concatenate([np.ravel(np.asarray(p[k], dtype=float)) for k in shapes])

    def named(x: np.ndarray) -> Parameters:
        out, i = {}, 0
        for k, shape in shapes.items():
            n = int(np.prod(shape))
            out[k], i = x[i : i + n].reshape(shape), i + n
        return out

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = function(named(x))
        return float(value), flat(gradient)

    x, pairs = flat(start), deque(maxlen=memory)
    value, g = at(x)
    for i in range(iterations):
        if np.max(np.abs(g), initial=0.0) <= tolerance:
            return Minimum(named(x), value, i, True)
        d, used = -g, []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            used.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        if g @ d >= 0:
            d = -g
        step = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(g))
        while step > 1e-12:
            new, ng = at(x + step * d)
            if np.isfinite(new) and new <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return Minimum(named(x), value, i, True)
        if step * (d @ (ng - g)) > 1e-12:
            pairs.append((step * d, ng - g))
        x, value, g = x + step * d, new, ng
    return Minimum(named(x), value, iterations, bool(np.max(np.abs(g), initial=0.0) <= tolerance))
