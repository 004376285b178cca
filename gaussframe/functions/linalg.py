"""Column builders for small dense vectors (array<double>) and matrices (array<array<double>>)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2PI = math.log(2 * math.pi)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def vec(*xs: float) -> Column:
    return F.array(*(F.lit(float(x)) for x in xs))


def mat(rows) -> Column:
    return F.array(*(vec(*r) for r in rows))


def scale(a: Column, s: Column | float) -> Column:
    return F.transform(a, lambda x: x * s)


def mscale(a: Column, s: Column | float) -> Column:
    return F.transform(a, lambda r: F.transform(r, lambda x: x * s))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def madd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, q: F.zip_with(r, q, lambda x, y: x + y))


def matvec(a: Column, v: Column) -> Column:
    return F.transform(a, lambda r: dot(r, v))


def transpose(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda j: F.transform(a, lambda r: F.get(r, j)))


def matmul(a: Column, b: Column) -> Column:
    t = transpose(b)
    return F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c)))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def trace(a: Column) -> Column:
    return total(F.transform(a, lambda r, i: F.get(r, i)))


def quad(a: Column, x: Column, y: Column | None = None) -> Column:
    """x'Ay."""
    return dot(x, matvec(a, x if y is None else y))


def pick(v: Column, dims) -> Column:
    return F.array(*(F.get(v, F.lit(i)) for i in dims))


def block(a: Column, rows, cols) -> Column:
    return F.array(*(pick(F.get(a, F.lit(i)), cols) for i in rows))


def identity(n: Column) -> Column:
    s = F.sequence(F.lit(0), n - 1)
    return F.transform(s, lambda i: F.transform(s, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def inverse(a: Column) -> Column:
    """struct(inv, ln_det, valid) of a positive definite matrix, by sweeping each dimension."""

    def step(acc: Column, k: Column) -> Column:
        m = acc["m"]
        p = F.get(F.get(m, k), k)
        row = F.get(m, k)

        def cell(v: Column, j: Column, r: Column, i: Column) -> Column:
            return F.when((i == k) & (j == k), -1 / p).when(i == k, v / p).when(j == k, v / p).otherwise(v - F.get(r, k) * F.get(row, j) / p)

        new = F.transform(m, lambda r, i: F.transform(r, lambda v, j: cell(v, j, r, i)))
        return F.struct(new.alias("m"), (acc["ld"] + F.ln(p)).alias("ld"), (acc["ok"] & (p > 0)).alias("ok"))

    start = F.struct(a.alias("m"), F.lit(0.0).alias("ld"), F.lit(True).alias("ok"))
    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, lambda acc: F.struct(mscale(acc["m"], -1.0).alias("inv"), acc["ld"].alias("ln_det"), acc["ok"].alias("valid")))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def diagonal(v: Column) -> Column:
    """The matrix with ``v`` on its diagonal."""
    return F.transform(v, lambda x, i: F.transform(v, lambda _, j: F.when(i == j, x).otherwise(0.0)))


def diagonal_of(a: Column) -> Column:
    return F.transform(a, lambda r, i: F.get(r, i))


def cholesky(a: Column) -> Column:
    """The lower factor of a positive definite matrix, a row after the other; row i has i + 1 entries."""

    def row(rows: Column, i: Column) -> Column:
        def entry(r: Column, j: Column) -> Column:
            left = F.get(F.get(a, i), j)
            own = left - total(F.zip_with(r, F.slice(F.get(rows, j), F.lit(1), j), lambda x, y: x * y))
            return F.concat(r, F.array(F.when(j < i, own / F.get(F.get(rows, j), j)).otherwise(F.sqrt(left - total(F.transform(r, lambda x: x * x))))))

        return F.aggregate(F.sequence(F.lit(0), i), F.expr("cast(array() as array<double>)"), entry)

    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.expr("cast(array() as array<array<double>>)"), lambda rows, i: F.concat(rows, F.array(row(rows, i))))


def normal_tail(x: Column) -> Column:
    """The mass beyond x of 2.5 or more, by a continued fraction, with full relative precision."""
    c = F.greatest(x, F.lit(2.5))
    return normal_pdf(c) / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), c, lambda acc, k: c + k / acc)


def normal_cdf(x: Column) -> Column:
    """A series between -2.5 and 2.5, the tails beyond; infinite limits included."""
    c = F.least(F.greatest(x, F.lit(-2.5)), F.lit(2.5))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(c.alias("t"), c.alias("s")), lambda acc, n: F.struct((acc["t"] * c * c / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * c * c / (2 * n + 1)).alias("s")), lambda acc: acc["s"])
    return F.when(x < -2.5, normal_tail(-x)).when(x > 2.5, 1 - normal_tail(x)).otherwise(0.5 + normal_pdf(c) * series)


def normal_mass(a: Column, b: Column) -> Column:
    """The mass between a and b; on the right of 0 from the mirrored tails, so that nothing cancels."""
    return F.when(a > 0, normal_cdf(-a) - normal_cdf(-b)).otherwise(normal_cdf(b) - normal_cdf(a))
