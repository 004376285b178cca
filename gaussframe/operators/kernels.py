"""Conditionals with kernels: p(y|x) = N(M phi(x) + b, S), phi(x) = (x, k_1(x), ..., k_n(x)).

A radial kernel is exp(-|(x - centre) / length|^2 / 2), a ridge exp(-(weights'x + offset)^2 / 2).  Its expectation,
and that of its products with x and other kernels of its kind, are Gaussian integrals; moments of y follow by
matching.  Kernels are a short list that the caller gives, so each is a column expression and nothing is joined.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L

class Radial(NamedTuple):
    centre: list[float]
    length: list[float]


class Ridge(NamedTuple):
    weights: list[float]
    offset: float


Kernel = Radial | Ridge | tuple[list[float], list[float]]  # a plain tuple is radial
MAX_KERNELS = 1000


def from_table(kernels: DataFrame) -> list[Kernel]:
    """Kernels of a table (k, kind, centre, length_scale, w, w0), by k; more than ``MAX_KERNELS`` raise ValueError."""
    rows = kernels.orderBy("k").limit(MAX_KERNELS + 1).collect()
    if len(rows) > MAX_KERNELS:
        raise ValueError(f"more than {MAX_KERNELS} kernels")
    return [Ridge(list(r.w), r.w0) if r.kind == "ridge" else Radial(list(r.centre), list(r.length_scale)) for r in rows]


def product(a: Kernel, b: Kernel) -> tuple[float, Kernel]:
    """Two radial kernels' product as a factor and a kernel."""
    centre, length, ln = [], [], 0.0
    for s, p, t, q in zip(a[0], a[1], b[0], b[1], strict=True):
        u, v = 1 / p**2, 1 / q**2
        centre.append((s * u + t * v) / (u + v))
        length.append((u + v) ** -0.5)
        ln -= (s - t) ** 2 / (p**2 + q**2) / 2
    return math.exp(ln), (centre, length)


def _radial(own: DataFrame, k: Kernel, name: str, factor: float = 1.0) -> DataFrame:
    """The expectation of a radial kernel as column k<name>, and g<name>: Cov(u, k) is k times Cov(u, x) g for any u jointly Gaussian with x."""
    n, length = len(k[0]), [abs(x) for x in k[1]]
    own = own.withColumn("__i", L.inverse(L.madd(F.col("Sigma"), L.mat([[length[i] ** 2 if i == j else 0.0 for j in range(n)] for i in range(n)]))))
    own = own.withColumn("__d", L.add(L.vec(*k[0]), L.scale(F.col("mu"), -1.0))).withColumn(f"g{name}", L.matvec(F.col("__i.inv"), F.col("__d")))
    value = F.exp(math.fsum(math.log(x) for x in length) - F.col("__i.ln_det") / 2 - L.dot(F.col("__d"), F.col(f"g{name}")) / 2)
    return own.withColumn(f"k{name}", value * factor).drop("__i", "__d")


def with_kernels(p: DataFrame, kernels: list[Kernel]) -> DataFrame:
    """Densities with phi, the mean of phi(x), its covariance C, and k<i> and g<i> of each kernel."""
    ridges = [isinstance(k, Ridge) for k in kernels]
    if any(ridges) and not all(ridges):
        raise TypeError("radial kernels and ridges don't mix in a model")
    n, own = len(kernels), p
    for i, k in enumerate(kernels):
        if not ridges[i]:
            own = _radial(own, k, str(i))
            for j in range(i + 1):
                c, both = product(k, kernels[j])
                own = _radial(own, both, f"k{i}_{j}", c)
            continue
        own = own.withColumn(f"m{i}", L.dot(L.vec(*k.weights), F.col("mu")) + float(k.offset)).withColumn(f"v{i}", L.quad(F.col("Sigma"), L.vec(*k.weights)))
        mean, spread = F.col(f"m{i}"), 1 + F.col(f"v{i}")
        own = own.withColumn(f"k{i}", F.exp(-mean * mean / spread / 2) / F.sqrt(spread)).withColumn("__s", -mean / spread)
        own = own.withColumn(f"g{i}", L.scale(L.vec(*k.weights), F.col("__s"))).drop("__s")
        for j in range(i + 1):
            # two ridges see a Gaussian of two dimensions
            own = own.withColumn("__o", L.quad(F.col("Sigma"), L.vec(*k.weights), L.vec(*kernels[j].weights)))
            other, wide, o = F.col(f"m{j}"), 1 + F.col(f"v{j}"), F.col("__o")
            det = spread * wide - o * o
            own = own.withColumn(f"kk{i}_{j}", F.exp(-(wide * mean * mean - 2 * o * mean * other + spread * other * other) / det / 2) / F.sqrt(det)).drop("__o")
    gains = F.array(*(L.scale(L.matvec(F.col("Sigma"), F.col(f"g{i}")), F.col(f"k{i}")) for i in range(n)))
    own = own.withColumn("__g", gains).withColumn("phi", F.concat("mu", F.array(*(F.col(f"k{i}") for i in range(n)))))
    pairs = F.array(*(F.array(*(F.col(f"kk{max(i, j)}_{min(i, j)}") - F.col(f"k{i}") * F.col(f"k{j}") for j in range(n))) for i in range(n)))
    top = F.zip_with("Sigma", L.transpose(F.col("__g")), lambda x, g: F.concat(x, g))
    return own.withColumn("C", F.concat(top, F.zip_with("__g", pairs, lambda g, x: F.concat(g, x)))).drop("__g")


def marginal(p: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]]) -> DataFrame:
    """r, mu, Sigma of y by moment matching, and the cross covariance of y and x."""
    d = len(kernels[0][0])
    own = with_kernels(p, kernels).withColumn("MC", L.matmul(L.mat(m), F.col("C")))
    return own.select(
        "r",
        L.add(L.matvec(L.mat(m), F.col("phi")), L.vec(*b)).alias("mu"),
        L.madd(L.matmul(F.col("MC"), L.transpose(L.mat(m))), L.mat(s)).alias("Sigma"),
        F.transform("MC", lambda row: F.slice(row, 1, d)).alias("cross"),
    )


def cross_terms(p: DataFrame, y: DataFrame) -> DataFrame:
    """r and the expectation of yx', from densities of x and the moments that ``marginal`` gives."""
    return _both(p, y).select("r", L.madd(F.col("cross"), L.outer(F.col("y_mu"), F.col("x_mu"))).alias("value"))


def _expected_log(own: DataFrame, s: list[list[float]]) -> DataFrame:
    """r and the expectation of a Gaussian's log, from the residual's mean __d and covariance __c."""
    own = own.withColumn("__s", L.inverse(L.mat(s)))
    return own.select("r", (-(L.trace(L.matmul(F.col("__s.inv"), F.col("__c"))) + L.quad(F.col("__s.inv"), F.col("__d")) + len(s) * L.LN2PI + F.col("__s.ln_det")) / 2).alias("value"))


def log_conditional_y(p: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]], y: Column) -> DataFrame:
    """r and the expectation over x of ln p(y|x), exact."""
    mm = L.mat(m)
    own = with_kernels(p, kernels).withColumn("__d", L.add(y, L.scale(L.add(L.matvec(mm, F.col("phi")), L.vec(*b)), -1.0)))
    return _expected_log(own.withColumn("__c", L.matmul(L.matmul(mm, F.col("C")), L.transpose(mm))), s)


def log_conditional(joint: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]]) -> DataFrame:
    """r and the expectation of ln p(y|x) over joint densities (r, mu, Sigma) of (y, x), in this order, exact."""
    mm, n, ys, xs = L.mat(m), len(kernels), range(len(b)), range(len(b), len(b) + len(kernels[0][0]))
    of = [L.pick(F.col("mu"), ys).alias("y_mu"), L.block(F.col("Sigma"), ys, ys).alias("y_S"), L.block(F.col("Sigma"), ys, xs).alias("y_x")]
    own = with_kernels(joint.select("r", *of, L.pick(F.col("mu"), xs).alias("mu"), L.block(F.col("Sigma"), xs, xs).alias("Sigma")), kernels)
    own = own.withColumn("__d", L.add(F.col("y_mu"), L.scale(L.add(L.matvec(mm, F.col("phi")), L.vec(*b)), -1.0)))
    with_phi = F.transform("y_x", lambda row: F.concat(row, F.array(*(F.col(f"k{i}") * L.dot(row, F.col(f"g{i}")) for i in range(n)))))
    own = own.withColumn("__yp", with_phi).withColumn("__yf", L.matmul(F.col("__yp"), L.transpose(mm)))
    both = L.madd(F.col("__yf"), L.transpose(F.col("__yf")))
    return _expected_log(own.withColumn("__c", L.madd(L.madd(F.col("y_S"), L.mscale(both, -1.0)), L.matmul(L.matmul(mm, F.col("C")), L.transpose(mm)))), s)


def set_y(*_) -> DataFrame:
    raise NotImplementedError("the likelihood of a kernel model isn't a Gaussian factor in x")


def features(x: Column, kernels: list[Kernel]) -> Column:
    """phi(x): x and the kernels at x."""

    def at(k: Kernel) -> Column:
        if isinstance(k, Ridge):
            h = L.dot(L.vec(*k.weights), x) + float(k.offset)
            return F.exp(-h * h / 2)
        return F.exp(-L.total(F.zip_with(F.zip_with(x, L.vec(*k[0]), lambda u, v: u - v), L.vec(*k[1]), lambda d, l: d * d / (l * l))) / 2)

    return F.concat(x, F.array(*map(at, kernels)))


def condition_on_x(points: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]]) -> DataFrame:
    """A density in y for each point (n, x)."""
    return points.withColumn("phi", features(F.col("x"), kernels)).select("n", L.add(L.matvec(L.mat(m), F.col("phi")), L.vec(*b)).alias("mu"), L.mat(s).alias("Sigma"))


def joint(p: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]]) -> DataFrame:
    """p(x, y) by moment matching, in this order."""
    return matched_joint(p, marginal(p, kernels, m, b, s))


def conditional(p: DataFrame, kernels: list[Kernel], m: list[list[float]], b: list[float], s: list[list[float]]) -> DataFrame:
    """p(x|y) by moment matching."""
    return matched_conditional(p, marginal(p, kernels, m, b, s))


def _both(p: DataFrame, y: DataFrame) -> DataFrame:
    """Densities of x and the moments (mu, Sigma, cross) of y, by r."""
    own = y.select("r", F.col("mu").alias("y_mu"), F.col("Sigma").alias("y_S"), "cross")
    return p.select("r", F.col("mu").alias("x_mu"), F.col("Sigma").alias("x_S")).join(own, "r")


def matched_joint(p: DataFrame, y: DataFrame) -> DataFrame:
    top = F.zip_with("x_S", L.transpose(F.col("cross")), lambda a, c: F.concat(a, c))
    low = F.zip_with("cross", "y_S", lambda a, c: F.concat(a, c))
    return _both(p, y).select("r", F.concat("x_mu", "y_mu").alias("mu"), F.concat(top, low).alias("Sigma"))


def matched_conditional(p: DataFrame, y: DataFrame) -> DataFrame:
    own = _both(p, y).withColumn("__i", L.inverse(F.col("y_S"))["inv"]).withColumn("M", L.matmul(L.transpose(F.col("cross")), F.col("__i")))
    s = L.madd(F.col("x_S"), L.mscale(L.matmul(F.col("M"), F.col("cross")), -1.0))
    return own.select("r", "M", L.add(F.col("x_mu"), L.scale(L.matvec(F.col("M"), F.col("y_mu")), -1.0)).alias("b"), s.alias("Sigma"))
