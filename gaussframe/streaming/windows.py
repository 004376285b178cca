"""Gaussian moments of event-time windows, in batch and in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, ts: str, key: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """start, key, n, mu and sigma2 of each window; ``late`` sets the watermark of a stream."""
    df = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        df = df.withWatermark("__ts", late)
    out = df.groupBy(F.window("__ts", width), F.col(key)).agg(F.count("*").alias("n"), F.avg(value).alias("mu"), F.var_pop(value).alias("sigma2"))
    return out.select(F.col("window.start").alias("start"), key, "n", "mu", "sigma2")
