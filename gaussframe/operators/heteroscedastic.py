"""Conditionals whose noise depends on x: Sigma(x) = S + sum over k of a_k a_k' f(w_k'x + c_k), f one of four links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .kernels import matched_conditional, matched_joint


def expected_link(link: str, m: Column, v: Column) -> Column:
    """The expectation of a link function of a Gaussian scalar with mean m and variance v."""
    s = F.sqrt(v)
    if link == "exp":
        return F.exp(m + v / 2)
    if link == "cosh_minus_one":
        return (F.exp(m + v / 2) + F.exp(v / 2 - m)) / 2 - 1
    if link == "heaviside":
        return L.normal_cdf(m / s)
    if link == "relu":
        return m * L.normal_cdf(m / s) + s * L.normal_pdf(m / s)
    raise KeyError(link)


def marginal(p: DataFrame, link: str, m: list[list[float]], b: list[float], s: list[list[float]], a: list[list[float]], w: list[list[float]], c: list[float]) -> DataFrame:
    """r, mu, Sigma of y by moment matching, and the expectation of Sigma(x); ``a`` and ``w`` have a row for each k."""
    own, noise = p, L.mat(s)
    for k, (ak, wk, ck) in enumerate(zip(a, w, c, strict=True)):
        # scalars become columns before a lambda uses them
        own = own.withColumn(f"m{k}", L.dot(L.vec(*wk), F.col("mu")) + ck).withColumn(f"v{k}", L.quad(F.col("Sigma"), L.vec(*wk)))
        own = own.withColumn(f"e{k}", expected_link(link, F.col(f"m{k}"), F.col(f"v{k}")))
        noise = L.madd(noise, F.array(*(F.array(*(F.lit(x * y) * F.col(f"e{k}") for y in ak)) for x in ak)))
    mm = L.mat(m)
    own = own.withColumn("noise", noise).withColumn("MS", L.matmul(mm, F.col("Sigma")))
    return own.select("r", L.add(L.matvec(mm, F.col("mu")), L.vec(*b)).alias("mu"), L.madd(L.matmul(F.col("MS"), L.transpose(mm)), F.col("noise")).alias("Sigma"), "noise", F.col("MS").alias("cross"))


def link_at(link: str, h: Column) -> Column:
    if link == "exp":
        return F.exp(h)
    if link == "cosh_minus_one":
        return F.cosh(h) - 1
    if link == "heaviside":
        return F.when(h >= 0, 1.0).otherwise(0.0)
    if link == "relu":
        return F.greatest(h, F.lit(0.0))
    raise KeyError(link)


def condition_on_x(points: DataFrame, link: str, m: list[list[float]], b: list[float], s: list[list[float]], a: list[list[float]], w: list[list[float]], c: list[float]) -> DataFrame:
    """A density in y for each point (n, x), with the covariance at x."""
    own, noise = points, L.mat(s)
    for k, (ak, wk, ck) in enumerate(zip(a, w, c, strict=True)):
        own = own.withColumn(f"f{k}", link_at(link, L.dot(L.vec(*wk), F.col("x")) + ck))
        noise = L.madd(noise, F.array(*(F.array(*(F.lit(x * y) * F.col(f"f{k}") for y in ak)) for x in ak)))
    return own.select("n", L.add(L.matvec(L.mat(m), F.col("x")), L.vec(*b)).alias("mu"), noise.alias("Sigma"))


def joint(p: DataFrame, *model) -> DataFrame:
    """p(x, y) by moment matching; ``model`` as in ``marginal``."""
    return matched_joint(p, marginal(p, *model))


def conditional(p: DataFrame, *model) -> DataFrame:
    """p(x|y) by moment matching; ``model`` as in ``marginal``."""
    return matched_conditional(p, marginal(p, *model))


def set_y(*_) -> DataFrame:
    raise AttributeError("the likelihood of a model whose noise depends on x isn't a Gaussian factor in x")


#: f / (1 + f) of a smooth link f as weights of exp(t h) over a function that ``_level`` bounds: (t, weight).
TILTS = {"exp": ((0.5, 1.0),), "cosh_minus_one": ((1.0, 0.5), (-1.0, 0.5), (0.0, -1.0))}
TOLERANCE = 1e-5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _level(link: str, w: Column) -> Column:
    """ln(2 cosh(w / 2)) or ln cosh(w), of w from 0 on."""
    return w / 2 + F.log1p(F.exp(-w)) if link == "exp" else w + F.log1p(F.exp(-2 * w)) - float(np.log(2))


def _slope(link: str, w: Column) -> Column:
    """Twice the derivative of the level by w squared."""
    return F.when(w <= 0, 0.25).otherwise(F.tanh(w / 2) / w / 2) if link == "exp" else F.when(w <= 0, 1.0).otherwise(F.tanh(w) / w)


def _tilt(m: Column, v: Column, t: Column | float, g: Column | float) -> tuple[Column, Column, Column]:
    """Log mass, mean and variance of N(m, v) times exp(t h - g h^2 / 2)."""
    d = 1 + g * v
    return (2 * t * m + t * t * v - g * m * m) / d / 2 - F.ln(d) / 2, (m + t * v) / d, v / d


def _whole(m: Column, v: Column) -> list[Column]:
    """Moments of N(m, v) from order 0 to 4."""
    return [F.lit(1.0), m, m * m + v, m * (m * m + 3 * v), m * m * m * m + 6 * m * m * v + 3 * v * v]


def _half(m: Column, v: Column, mass: Column, edge: Column) -> list[Column]:
    """The same over h from 0 on; ``mass`` lies there, ``edge`` is v times the density at 0."""
    grown = (F.lit(0.0), F.lit(1.0), m, m * m + 2 * v, m * m * m + 5 * m * v)
    return [w * mass + e * edge for w, e in zip(_whole(m, v), grown, strict=True)]


def _half_let(m: Column, v: Column, body) -> Column:
    """``body`` of the moments of N(m, v) over h from 0 on."""
    z = m / F.sqrt(v)
    return _let(F.struct(L.normal_cdf(z).alias("mass"), (F.sqrt(v) * L.normal_pdf(z)).alias("edge")), lambda x: body(_half(m, v, x["mass"], x["edge"])))


class _Joint:
    """h = w'x + c and u = a'Lambda(y - b - Mx) under p(x): u given h has mean alpha + beta h and variance rest."""

    def __init__(self, k: int):
        self.m, self.v, self.alpha, self.beta, self.rest = (F.col(f"__{n}{k}") for n in ("m", "v", "alpha", "beta", "rest"))

    def square(self, at: list[Column], order: int) -> Column:
        """The integral of h^order u^2 from moments of h."""
        return (self.alpha * self.alpha + self.rest) * at[order] + 2 * self.alpha * self.beta * at[order + 1] + self.beta * self.beta * at[order + 2]

    def smooth(self, link: str, w: Column, order: int) -> Column:
        """h^order u^2 f / (1 + f) with the bound that touches at w."""

        def body(g: Column) -> Column:
            parts = []
            for t, weight in TILTS[link]:
                ln, m, v = _tilt(self.m, self.v, t, g)
                parts.append(weight * F.exp(ln - _level(link, w) + g * w * w / 2) * self.square(_whole(m, v), order))
            return sum(parts[1:], parts[0])

        return _let(_slope(link, w), body)

    def rectified(self, w: Column, body) -> Column:
        """``body`` of the moments that weigh 1 / (1 + h), bounded at w, over h from 0 on."""
        ln, m, v = _tilt(self.m, self.v, -1 / (1 + w), 0.0)
        scale = F.exp(ln - F.log1p(w) + w / (1 + w))
        return _half_let(m, v, lambda at: body([x * scale for x in at]))


def _fixed_point(start: Column, step, iterations: int) -> Column:
    """``step`` again and again, until it moves by no more than the tolerance."""
    if not iterations:
        return start
    first = F.struct(start.alias("w"), (start + 1).alias("before"))
    moved = lambda acc, _: F.when(F.abs(acc["w"] - acc["before"]) <= TOLERANCE, acc).otherwise(F.struct(step(acc["w"]).alias("w"), acc["w"].alias("before")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first, moved, lambda acc: acc["w"])


def log_conditional_y(p: DataFrame, link: str, m: list[list[float]], b: list[float], s: list[list[float]], a: list[list[float]], w: list[list[float]], c: list[float], y: Column, iterations: int = 100) -> DataFrame:
    """r and a lower bound of the expectation over x of ln p(y|x).

    It holds where a_j'S^-1 a_k is 1 for j = k and 0 otherwise, as with S = AA' and the a columns of a square A.  Of
    the heaviside link it is the expectation itself.  Each kernel's bound touches at a point that is improved by
    fixed-point steps, ``iterations`` at most; 0 keeps the point that is best for the log determinant.
    """
    if link not in {*TILTS, "heaviside", "relu"}:
        raise KeyError(link)
    lam, mm = np.linalg.inv(np.array(s, dtype=float)), np.array(m, dtype=float)
    own = p.withColumn("__e", L.add(y, L.scale(L.add(L.matvec(L.mat(m), F.col("mu")), L.vec(*b)), -1.0)))
    quadratic = L.quad(L.mat(lam.tolist()), F.col("__e")) + L.trace(L.matmul(L.mat((mm.T @ lam @ mm).tolist()), F.col("Sigma")))
    log_det = F.lit(float(np.linalg.slogdet(np.array(s, dtype=float))[1]))
    for k, (ak, wk, ck) in enumerate(zip(a, w, c, strict=True)):
        q = lam @ np.array(ak, dtype=float)
        t = L.vec(*(mm.T @ q))
        own = own.withColumn(f"__m{k}", L.dot(L.vec(*wk), F.col("mu")) + float(ck)).withColumn(f"__v{k}", L.quad(F.col("Sigma"), L.vec(*wk)))
        own = own.withColumn("__u", L.dot(L.vec(*q), F.col("__e"))).withColumn("__hu", -L.quad(F.col("Sigma"), L.vec(*wk), t))
        own = own.withColumn(f"__beta{k}", F.when(F.col(f"__v{k}") > 0, F.col("__hu") / F.col(f"__v{k}")).otherwise(0.0))
        own = own.withColumn(f"__alpha{k}", F.col("__u") - F.col(f"__beta{k}") * F.col(f"__m{k}"))
        own = own.withColumn(f"__rest{k}", F.greatest(L.quad(F.col("Sigma"), t) - F.col(f"__beta{k}") * F.col("__hu"), F.lit(0.0)))
        j, point = _Joint(k), F.col(f"__w{k}")
        if link in TILTS:
            start = F.sqrt(j.m * j.m + j.v)
            own = own.withColumn("__w", start)
            step = lambda x, j=j: _let(j.smooth(link, x, 0), lambda z: F.when(z > 0, F.sqrt(F.greatest(j.smooth(link, x, 2), F.lit(0.0)) / z)).otherwise(x))
            own = own.withColumn(f"__w{k}", _fixed_point(F.col("__w"), step, iterations))
            term, det = j.smooth(link, point, 0), _level(link, F.col("__w")) + (j.m / 2 if link == "exp" else 0.0)
        elif link == "heaviside":
            term, det = _half_let(j.m, j.v, lambda at, j=j: j.square(at, 0) / 2), float(np.log(2)) * L.normal_cdf(j.m / F.sqrt(j.v))
        else:
            own = own.withColumn("__h", _half_let(j.m, j.v, lambda at: F.struct(at[0].alias("mass"), at[1].alias("mean")))).withColumn("__w", F.col("__h.mean"))
            step = lambda x, j=j: j.rectified(x, lambda at: F.when(j.square(at, 1) > 0, j.square(at, 2) / j.square(at, 1)).otherwise(x))
            own = own.withColumn(f"__w{k}", _fixed_point(F.col("__w"), step, iterations))
            term = j.rectified(point, lambda at, j=j: j.square(at, 1))
            det = F.col("__h.mass") * F.log1p("__w") + (F.col("__h.mean") - F.col("__h.mass") * F.col("__w")) / (1 + F.col("__w"))
        own = own.withColumn(f"__term{k}", term).withColumn(f"__det{k}", det)
        quadratic, log_det = quadratic - F.col(f"__term{k}"), log_det + F.col(f"__det{k}")
    return own.select("r", (-(quadratic + log_det + len(b) * L.LN2PI) / 2).alias("value"))
