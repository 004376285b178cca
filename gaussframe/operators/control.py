"""Conditionals that a function controls: p(y|x, u) = N(M(u)x + b(u), Sigma).

``controlled`` gives one conditional for each control; all operators of ``conditional`` (points, ``set_y``, joint,
marginal, conditional, entropy, expected logs) take the result, whose r is that of the control.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .conditional import conditional

Function = Callable[[np.ndarray], np.ndarray]  # (n, Du) to (n, Dy * (Dx + 1))


def network(layers: list[tuple[list[list[float]], list[float]]]) -> Function:
    """Layers (weights, offset) with tanh between them."""
    own = [(np.array(w, dtype=float), np.array(b, dtype=float)) for w, b in layers]

    def apply(u: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(own):
            u = (np.tanh(u) if i else u) @ w.T + b
        return u

    return apply


def controlled(u: DataFrame, function: Function, du: int, dx: int, dy: int, sigma: list[list[float]]) -> DataFrame:
    """Conditionals (r, M, b, Sigma, Lambda, ln_det_Sigma) for controls (r, u): the function's values are M row by row, then b.

    A function of another width raises ValueError before anything runs.  Controls go to it in Arrow batches; a null
    control gives a null M and b.
    """
    width = dy * (dx + 1)
    if np.shape(function(np.zeros((1, du)))) != (1, width):
        raise ValueError(f"the control function must give {width} values a row")

    def values(batch: pa.Array) -> pa.Array:
        kept = np.asarray(batch.is_valid())
        x = np.asarray(batch.flatten(), dtype=float).reshape(-1, du)
        ends = np.concatenate(([0], np.cumsum(kept * width))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(function(x), dtype=float).ravel()), mask=pa.array(~kept))

    values.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    own = u.select("r", F.arrow_udf(values, "array<double>")(F.col("u").cast("array<double>")).alias("__f"))
    rows = F.array(*(F.slice("__f", i * dx + 1, dx) for i in range(dy)))
    return conditional(own.select("r", F.when(F.col("__f").isNotNull(), rows).alias("M"), F.slice("__f", dy * dx + 1, dy).alias("b"), L.mat(sigma).alias("Sigma")))
