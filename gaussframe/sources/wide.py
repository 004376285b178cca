"""Gaussians of a vector column with many dimensions, as embeddings have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_wide(df: DataFrame, by: str, vector: str, dims: int, ridge: float = 0.0) -> DataFrame:
    """r, n, mu, Sigma of each group (population moments); ``ridge`` is added to the diagonal.

    A task adds up its rows' 1 + dims + dims^2 sums a group, so what is shuffled doesn't grow with a group's rows: a hot
    group is combined before the shuffle.  Rows with a null vector, or one of another length, are left out.  Sums
    lose digits where means are far beyond the spread: centre such columns first.
    """
    width = 1 + dims + dims * dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            x = np.asarray(batch.column(1).flatten(), dtype=float).reshape(-1, dims)
            at = np.asarray(codes.indices.fill_null(len(codes.dictionary)))
            keys = [*codes.dictionary.to_pylist(), None]
            for i in np.unique(at):
                own = x[at == i]
                sums[keys[i]] = sums.get(keys[i], 0.0) + np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=batch.schema.field(0).type), pa.array([s.tolist() for s in sums.values()], type=pa.list_(pa.float64()))], names=["r", "s"])

    vectors = df.select(F.col(by).alias("r"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dims)
    parts = vectors.mapInArrow(partial, vectors.select("r", F.col("v").alias("s")).schema).select("r", F.posexplode("s").alias("i", "x"))
    sums = parts.groupBy("r", "i").agg(F.sum("x").alias("x")).groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    own = sums.withColumn("n", F.get("s", F.lit(0))).withColumn("mu", F.transform(F.slice("s", 2, dims), lambda x: x / F.col("n"))).filter(F.size("s") == width)
    cell = lambda i, j: F.get("s", 1 + dims + i * dims + j) / F.col("n") - F.get("mu", i) * F.get("mu", j) + F.when(i == j, ridge).otherwise(0.0)
    at = F.sequence(F.lit(0), F.lit(dims - 1))
    return own.select("r", F.col("n").cast("long").alias("n"), "mu", F.transform(at, lambda i: F.transform(at, lambda j: cell(i, j))).alias("Sigma"))
