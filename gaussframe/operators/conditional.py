"""Conditional densities p(y|x) = N(Mx + b, Sigma), and truncated one-dimensional measures.

The joint's log determinant is that of Sigma plus that of Sigma_x; the constant of ``set_y`` is that of
a density in y; ``mutual_information`` is positive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L


def conditional(df: DataFrame) -> DataFrame:
    """Add Lambda and ln_det_Sigma to M, b, Sigma."""
    return df.withColumn("__i", L.inverse(F.col("Sigma"))).withColumn("Lambda", F.col("__i.inv")).withColumn("ln_det_Sigma", F.col("__i.ln_det")).drop("__i")


def identity(df: DataFrame) -> DataFrame:
    """The conditional of a Sigma with M = I and b = 0."""
    n = F.size("Sigma")
    return conditional(df.withColumn("M", L.identity(n)).withColumn("b", F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(0.0))))


def condition_on_x(cond: DataFrame, x: DataFrame) -> DataFrame:
    """A density in y for each conditional and point (n, x)."""
    return cond.crossJoin(x).select("r", "n", L.add(L.matvec(F.col("M"), F.col("x")), F.col("b")).alias("mu"), "Sigma")


def set_y(cond: DataFrame, y: DataFrame) -> DataFrame:
    """The likelihood factor in x for each conditional and observation (n, y)."""
    d = cond.crossJoin(y).withColumn("__d", L.add(F.col("y"), L.scale(F.col("b"), -1.0))).withColumn("__t", L.transpose(F.col("M"))).withColumn("__w", L.matvec(F.col("Lambda"), F.col("__d")))
    ln = -(L.quad(F.col("Lambda"), F.col("__d")) + F.size("b") * L.LN2PI + F.col("ln_det_Sigma")) / 2
    return d.select("r", "n", L.matmul(L.matmul(F.col("__t"), F.col("Lambda")), F.col("M")).alias("Lambda"), L.matvec(F.col("__t"), F.col("__w")).alias("nu"), ln.alias("ln_beta"))


def _with_x(cond: DataFrame, p: DataFrame) -> DataFrame:
    x = p.select(F.col("r").alias("x_r"), F.col("mu").alias("x_mu"), F.col("Sigma").alias("x_S"))
    return cond.crossJoin(x).withColumn("MS", L.matmul(F.col("M"), F.col("x_S"))).withColumn("y_mu", L.add(L.matvec(F.col("M"), F.col("x_mu")), F.col("b"))).withColumn("y_S", L.madd(F.col("Sigma"), L.matmul(F.col("MS"), L.transpose(F.col("M")))))


def affine_marginal(cond: DataFrame, p: DataFrame) -> DataFrame:
    return _with_x(cond, p).select("r", "x_r", F.col("y_mu").alias("mu"), F.col("y_S").alias("Sigma"))


def affine_joint(cond: DataFrame, p: DataFrame) -> DataFrame:
    """p(x, y), in this order."""
    j = _with_x(cond, p)
    top = F.zip_with("x_S", L.transpose(F.col("MS")), lambda a, b: F.concat(a, b))
    low = F.zip_with("MS", "y_S", lambda a, b: F.concat(a, b))
    return j.select("r", "x_r", F.concat("x_mu", "y_mu").alias("mu"), F.concat(top, low).alias("Sigma"))


def affine_conditional(cond: DataFrame, p: DataFrame) -> DataFrame:
    """p(x|y) by Bayes: gain, mean offset and covariance."""
    j = _with_x(cond, p).withColumn("Si", L.inverse(F.col("y_S"))["inv"]).withColumn("G", L.matmul(L.transpose(F.col("MS")), F.col("Si")))
    s = L.madd(F.col("x_S"), L.mscale(L.matmul(F.col("G"), F.col("MS")), -1.0))
    return j.select("r", "x_r", F.col("G").alias("M"), L.add(F.col("x_mu"), L.scale(L.matvec(F.col("G"), F.col("y_mu")), -1.0)).alias("b"), s.alias("Sigma"))


def conditional_entropy() -> Column:
    return (F.size("b") * (1 + L.LN2PI) + F.col("ln_det_Sigma")) / 2


def mutual_information(cond: DataFrame, p: DataFrame) -> DataFrame:
    """I(x; y), not negative."""
    j = _with_x(cond, p)
    return j.select("r", "x_r", ((L.inverse(F.col("y_S"))["ln_det"] - F.col("ln_det_Sigma")) / 2).alias("mutual_information"))


def log_conditional_y(cond: DataFrame, p: DataFrame, y: Column) -> DataFrame:
    """The expectation over x of ln p(y|x)."""
    j = _with_x(cond, p).withColumn("__d", L.add(y, L.scale(F.col("y_mu"), -1.0)))
    spread = L.trace(L.matmul(F.col("Lambda"), L.matmul(F.col("MS"), L.transpose(F.col("M")))))
    return j.select("r", "x_r", (-(L.quad(F.col("Lambda"), F.col("__d")) + spread + F.size("b") * L.LN2PI + F.col("ln_det_Sigma")) / 2).alias("value"))


def log_conditional(cond: DataFrame, joint: DataFrame) -> DataFrame:
    """The expectation of ln p(y|x) over joint densities (r, mu, Sigma) of (y, x), in this order."""
    x = joint.select(F.col("r").alias("x_r"), F.col("mu").alias("x_mu"), F.col("Sigma").alias("x_S"))
    n = F.size("b")
    own = cond.crossJoin(x).withColumn("__a", F.transform("M", lambda row, i: F.concat(F.transform("b", lambda _, j: F.when(i == j, 1.0).otherwise(0.0)), L.scale(row, -1.0))))
    own = own.withColumn("__d", L.add(L.matvec(F.col("__a"), F.col("x_mu")), L.scale(F.col("b"), -1.0)))
    spread = L.trace(L.matmul(F.col("Lambda"), L.matmul(L.matmul(F.col("__a"), F.col("x_S")), L.transpose(F.col("__a")))))
    return own.select("r", "x_r", (-(spread + L.quad(F.col("Lambda"), F.col("__d")) + n * L.LN2PI + F.col("ln_det_Sigma")) / 2).alias("value"))


def update_sigma(cond: DataFrame, new: DataFrame) -> DataFrame:
    """Conditionals with the Sigma that ``new`` (r, Sigma) has for them, others as they are."""
    n = new.select("r", F.col("Sigma").alias("__s"))
    return conditional(cond.select("r", "M", "b", "Sigma").join(n, "r", "left").select("r", "M", "b", F.coalesce("__s", "Sigma").alias("Sigma")))


def diagonal_conditional(df: DataFrame) -> DataFrame:
    """Lambda and ln_det_Sigma for M, b and variances ``var``, by reciprocals instead of an inverse."""
    out = df.withColumn("Sigma", L.diagonal(F.col("var"))).withColumn("Lambda", L.diagonal(F.transform("var", lambda x: 1 / x)))
    return out.withColumn("ln_det_Sigma", L.total(F.transform("var", lambda x: F.ln(x)))).drop("var")


def identity_diagonal(df: DataFrame) -> DataFrame:
    """The conditional of variances ``var`` with M = I and b = 0."""
    return diagonal_conditional(df.withColumn("M", L.identity(F.size("var"))).withColumn("b", F.transform("var", lambda _: F.lit(0.0))))


def truncated_density(x: Column, mu: Column, sigma: Column, lower: Column, upper: Column) -> Column:
    """The truncated density at x: 0 outside its limits."""
    a, b = F.coalesce((lower - mu) / sigma, F.lit(float("-inf"))), F.coalesce((upper - mu) / sigma, F.lit(float("inf")))
    u = (x - mu) / sigma
    return F.when((u >= a) & (u <= b), L.normal_pdf(u) / sigma / L.normal_mass(a, b)).otherwise(0.0)


#: Integrals over a measure of one dimension between two limits, from mass, mean and variance of the truncated density.
TRUNCATED = {"1": lambda t: F.lit(1.0), "x": lambda t: t["mean"], "x**2": lambda t: t["variance"] + t["mean"] * t["mean"]}


def integrate_truncated(expr: str, z: Column, mu: Column, sigma: Column, lower: Column, upper: Column, k: int | None = None) -> Column:
    """The integral of an expression ("x**k" takes k) over a measure with integral ``z``; unknown expressions raise KeyError, limits that aren't in order raise."""
    of = (lambda t: truncated_moment(mu, sigma, lower, upper, k)) if expr == "x**k" and k is not None else TRUNCATED[expr]
    t = truncated(mu, sigma, lower, upper)
    value = F.when(t["mass"] <= 0, 0.0).otherwise(z * t["mass"] * of(t))
    return F.when(lower.isNull() & upper.isNull(), F.raise_error(F.lit("a truncated measure needs a limit")).cast("double")).when(lower >= upper, F.raise_error(F.lit("the lower limit isn't under the upper one")).cast("double")).otherwise(value)


def truncated(mu: Column, sigma: Column, lower: Column, upper: Column) -> dict[str, Column]:
    """Mass, mean and variance of N(mu, sigma^2) on [lower, upper]; a null limit is infinite; no mass gives 0."""
    a, b = F.coalesce((lower - mu) / sigma, F.lit(float("-inf"))), F.coalesce((upper - mu) / sigma, F.lit(float("inf")))
    mass = L.normal_mass(a, b)
    fa, fb = F.when(F.abs(a) > 38, 0.0).otherwise(L.normal_pdf(a)), F.when(F.abs(b) > 38, 0.0).otherwise(L.normal_pdf(b))
    afa, bfb = F.when(F.abs(a) > 38, 0.0).otherwise(a * fa), F.when(F.abs(b) > 38, 0.0).otherwise(b * fb)
    d = (fa - fb) / mass
    return {"mass": mass, "mean": F.when(mass <= 0, 0.0).otherwise(mu + sigma * d), "variance": F.when(mass <= 0, 0.0).otherwise(sigma * sigma * (1 + (afa - bfb) / mass - d * d))}


def truncated_moment(mu: Column, sigma: Column, lower: Column, upper: Column, k: int) -> Column:
    """The k-th moment of the truncated density, by recursion over standardised moments."""
    a, b = F.coalesce((lower - mu) / sigma, F.lit(float("-inf"))), F.coalesce((upper - mu) / sigma, F.lit(float("inf")))
    mass = L.normal_mass(a, b)

    def edge(x: Column, n: int) -> Column:
        return F.when(F.abs(x) > 38, 0.0).otherwise(F.pow(x, F.lit(float(n))) * L.normal_pdf(x))

    own = [F.lit(1.0)]
    for i in range(1, k + 1):
        own.append((edge(a, i - 1) - edge(b, i - 1)) / mass + ((i - 1) * own[i - 2] if i > 1 else F.lit(0.0)))
    total = sum((math.comb(k, i) * F.pow(sigma, F.lit(float(i))) * F.pow(mu, F.lit(float(k - i))) * own[i] for i in range(k + 1)), F.lit(0.0))
    return F.when(mass <= 0, 0.0).otherwise(total)
