"""Matrices of more than about eight dimensions: NumPy on Arrow batches instead of expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _inverse(a: pa.Array) -> pa.Array:
    sizes = np.array([0 if n is None else n for n in a.value_lengths().to_pylist()], dtype=np.int64)
    flat = np.asarray(a.flatten().flatten(), dtype=float)
    ends = np.concatenate(([0], np.cumsum(sizes * sizes)))
    out, log_det, valid = np.full(len(flat), np.nan), np.full(len(a), np.nan), np.zeros(len(a), dtype=bool)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        at = ends[rows][:, None] + np.arange(n * n)
        values, vectors = np.linalg.eigh(flat[at].reshape(-1, n, n))
        good = values[:, 0] > 0
        own = values[good]
        out[at[good]] = ((vectors[good] / own[:, None, :]) @ np.swapaxes(vectors[good], 1, 2)).reshape(len(own), n * n)
        log_det[rows[good]], valid[rows] = np.log(own).sum(axis=1), good
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.repeat(sizes, sizes)))).astype(np.int32)), pa.array(out))
    empty = pa.array(sizes == 0)
    outer = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), inner, mask=empty)
    return pa.StructArray.from_arrays([outer, pa.array(log_det), pa.array(valid)], names=["inv", "ln_det", "valid"])


_inverse.__annotations__ = {"a": pa.Array, "return": pa.Array}


def inverse(a: Column) -> Column:
    """As ``linalg.inverse``: struct(inv, ln_det, valid).  Of a matrix that isn't positive definite, entries and log determinant are NaN; of a null one, inv is null."""
    return F.arrow_udf(_inverse, "inv array<array<double>>, ln_det double, valid boolean")(a)
