"""Kalman filters a key: an ordered fold over each key's events in batch (scalar, JVM-side), and with held state in streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kalman_filter(df: DataFrame, key: str, order: list[str], value: str, a: float, q: float, c: float, s: float, m0: float = 0.0, p0: float = 1.0) -> DataFrame:
    """Last mean, variance and log likelihood of each key; state z' = az + N(0, q), x = cz + N(0, s).

    A key's events are one sequential fold, which the recursion needs.
    """

    def step(acc, e):
        m, p = a * acc["m"], a * a * acc["p"] + q
        v = c * c * p + s
        d = e[value] - c * m
        k = p * c / v
        return F.struct((m + k * d).alias("m"), (p - k * c * p).alias("p"), (acc["ll"] - (F.log(F.lit(2 * 3.141592653589793) * v) + d * d / v) / 2).alias("ll"), (acc["n"] + 1).alias("n"))

    seq = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias(value))))
    start = F.struct(F.lit(m0).alias("m"), F.lit(p0).alias("p"), F.lit(0.0).alias("ll"), F.lit(0).cast("long").alias("n"))
    folded = df.filter(F.col(value).isNotNull()).groupBy(key).agg(seq.alias("seq")).withColumn("f", F.aggregate("seq", start, step))
    return folded.select(key, F.col("f.n").alias("n"), F.col("f.m").alias("mean"), F.col("f.p").alias("variance"), F.col("f.ll").alias("log_likelihood"))


def kalman_stream(events: DataFrame, key: str, order: list[str], value: str, a, q, c, s, m0=None, p0=None) -> DataFrame:
    """The filter of a stream, for states and values of any dimensions: mean, variance and log likelihood a key after each batch.

    ``a``, ``q``, ``c``, ``s`` are matrices; ``value`` is an array column.  The state is held by Spark (a mean, a
    covariance, two numbers a key), so a key's history is never gathered.  Within a batch, events go by ``order``; the
    source must deliver batches in that order.  Null values are left out.
    """
    a, q, c, s = (np.atleast_2d(np.asarray(x, dtype=float)) for x in (a, q, c, s))
    dims = len(a)
    first = (0, np.zeros(dims) if m0 is None else np.asarray(m0, dtype=float), np.eye(dims) if p0 is None else np.asarray(p0, dtype=float), 0.0)

    def update(of, frames, state):
        n, m, p, ll = first
        if state.exists:
            n, m, p, ll = state.get
            m, p = np.array(m), np.array(p).reshape(dims, dims)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            m, p = a @ m, a @ p @ a.T + q
            v, d = c @ p @ c.T + s, np.asarray(x, dtype=float) - c @ m
            gain = np.linalg.solve(v, c @ p).T
            m, p = m + gain @ d, p - gain @ c @ p
            ll -= (len(d) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + d @ np.linalg.solve(v, d)) / 2
            n += 1
        state.update((n, m.tolist(), p.ravel().tolist(), float(ll)))
        yield pd.DataFrame({key: [of[0]], "n": [n], "mean": [m.tolist()], "variance": [p.ravel().tolist()], "log_likelihood": [ll]})

    own = events.select(key, *order, F.col(value).cast("array<double>").alias(value)).filter(F.col(value).isNotNull())
    held = "n bigint, mean array<double>, variance array<double>, log_likelihood double"
    return own.groupBy(key).applyInPandasWithState(update, f"{key} {own.schema[key].dataType.simpleString()}, {held}", held, "update", "NoTimeout")
