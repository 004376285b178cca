"""Tables of factors, measures, densities and conditionals: labels, files and parameters by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that define each kind of object.
PARAMETERS = {
    "factor": ("Lambda", "nu", "ln_beta"),
    "measure": ("Lambda", "nu", "ln_beta"),
    "density": ("Sigma", "mu", "Lambda", "ln_det_Sigma"),
    "conditional": ("M", "b", "Sigma", "Lambda", "ln_det_Sigma"),
}
TYPES = {"Lambda": "array<array<double>>", "Sigma": "array<array<double>>", "M": "array<array<double>>", "nu": "array<double>", "mu": "array<double>", "b": "array<double>", "ln_beta": "double", "ln_det_Sigma": "double"}
MAX_OBJECTS = 10_000


def label(kind: str) -> Column:
    """A row's name: its kind, r and dimensions.  Unknown kinds raise KeyError."""
    first = PARAMETERS[kind][0]
    size = F.concat_ws("x", F.size(F.col(first)).cast("string"), F.size(F.get(F.col(first), F.lit(0))).cast("string"))
    return F.concat(F.lit(f"{kind} "), F.col("r").cast("string"), F.lit(" of "), size)


def save(df: DataFrame, kind: str, path: str) -> None:
    """r and the kind's parameters as Parquet; a folder that exists raises."""
    df.select("r", *PARAMETERS[kind]).write.parquet(path)


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.parquet(path).select("r", *PARAMETERS[kind])


def to_dict(df: DataFrame, kind: str) -> dict[str, list]:
    """Parameters by name, rows in the order of r; more than ``MAX_OBJECTS`` rows raise ValueError (``save`` takes any number)."""
    names = ("r", *PARAMETERS[kind])
    rows = df.select(*names).orderBy("r").limit(MAX_OBJECTS + 1).collect()
    if len(rows) > MAX_OBJECTS:
        raise ValueError(f"more than {MAX_OBJECTS} objects")
    return {n: [r[n] for r in rows] for n in names}


def from_dict(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """Rows from parameters by name; r counts from 0 where it lacks."""
    names = [n for n in parameters if n != "r"]
    keys = parameters.get("r") or list(range(len(parameters[names[0]])))
    of = "bigint" if all(isinstance(k, int) for k in keys) else "string"
    return spark.createDataFrame(list(zip(keys, *(parameters[n] for n in names), strict=True)), f"r {of}, " + ", ".join(f"{n} {TYPES[n]}" for n in names))
