"""Gaussians from tables: sufficient statistics a group, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, by: str, cols: list[str], ridge: float = 0.0) -> DataFrame:
    """r, n, mu, Sigma of each group (population moments); ``ridge`` is added to the diagonal."""
    c = [F.col(x).cast("double") for x in cols]
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(c)]
    aggs += [(F.var_pop(x) if i == j else F.covar_pop(x, y)).alias(f"s{i}_{j}") for i, x in enumerate(c) for j, y in enumerate(c) if j >= i]
    g = df.groupBy(F.col(by).alias("r")).agg(F.count("*").alias("n"), *aggs)
    k = range(len(cols))
    sigma = F.array(*(F.array(*(F.col(f"s{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for j in k)) for i in k))
    return g.select("r", "n", F.array(*(F.col(f"m{i}") for i in k)).alias("mu"), sigma.alias("Sigma"))
