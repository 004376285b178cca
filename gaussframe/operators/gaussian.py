"""Factors, measures and densities as rows.

A factor is exp(-x'Lambda x / 2 + x'nu + ln_beta) with columns r, Lambda, nu, ln_beta.  ``moments`` adds
Sigma, mu, the log determinant and the log integral.  Products over all pairs are cross joins of
factor tables (small by nature: a row a factor), aligned ones equi-joins, products over rows sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L


def density(df: DataFrame) -> DataFrame:
    """From mu and Sigma: Lambda, nu, ln_det_Sigma, ln_beta, normalised."""
    out = df.withColumn("__i", L.inverse(F.col("Sigma"))).withColumn("Lambda", F.col("__i.inv")).withColumn("ln_det_Sigma", F.col("__i.ln_det")).drop("__i")
    out = out.withColumn("nu", L.matvec(F.col("Lambda"), F.col("mu")))
    return out.withColumn("lnZ", (L.dot(F.col("nu"), F.col("mu")) + F.size("mu") * L.LN2PI + F.col("ln_det_Sigma")) / 2).withColumn("ln_beta", -F.col("lnZ"))


def moments(df: DataFrame) -> DataFrame:
    """From Lambda and nu: Sigma, mu, ln_det_Sigma, lnZ and log_integral."""
    out = df.withColumn("__i", L.inverse(F.col("Lambda"))).withColumn("Sigma", F.col("__i.inv")).withColumn("ln_det_Sigma", -F.col("__i.ln_det")).drop("__i")
    return completed(out)


def completed(df: DataFrame) -> DataFrame:
    """mu, lnZ and log_integral where Sigma is known."""
    out = df.withColumn("mu", L.matvec(F.col("Sigma"), F.col("nu")))
    out = out.withColumn("lnZ", (L.dot(F.col("nu"), F.col("mu")) + F.size("mu") * L.LN2PI + F.col("ln_det_Sigma")) / 2)
    return out.withColumn("log_integral", F.col("lnZ") + F.col("ln_beta"))


def evaluate_ln(x: Column) -> Column:
    return -L.quad(F.col("Lambda"), x) / 2 + L.dot(F.col("nu"), x) + F.col("ln_beta")


def product(df: DataFrame, dims: int, by: str | None = None) -> DataFrame:
    """The product over rows (of each group): natural parameters add up."""
    k = range(dims)
    sums = [F.sum(F.get(F.get("Lambda", F.lit(i)), F.lit(j))).alias(f"l{i}_{j}") for i in k for j in k] + [F.sum(F.get("nu", F.lit(i))).alias(f"v{i}") for i in k] + [F.sum("ln_beta").alias("ln_beta")]
    g = df.groupBy(*([by] if by else [])).agg(*sums)
    return g.select(*([by] if by else []), F.array(*(F.array(*(F.col(f"l{i}_{j}") for j in k)) for i in k)).alias("Lambda"), F.array(*(F.col(f"v{i}") for i in k)).alias("nu"), "ln_beta")


def _pair(joined: DataFrame) -> DataFrame:
    return joined.withColumn("Lambda", L.madd(F.col("Lambda"), F.col("f_Lambda"))).withColumn("nu", L.add(F.col("nu"), F.col("f_nu"))).withColumn("ln_beta", F.col("ln_beta") + F.col("f_ln_beta")).drop("f_Lambda", "f_nu", "f_ln_beta")


def _named(factor: DataFrame) -> DataFrame:
    return factor.select(F.col("r").alias("f_r"), *(F.col(c).alias(f"f_{c}") for c in ("Lambda", "nu", "ln_beta")))


def multiply(measure: DataFrame, factor: DataFrame) -> DataFrame:
    """All pairs, with keys r and f_r."""
    return _pair(measure.select("r", "Lambda", "nu", "ln_beta").crossJoin(_named(factor)))


def hadamard(measure: DataFrame, factor: DataFrame) -> DataFrame:
    """Rows of equal r."""
    return _pair(measure.select("r", "Lambda", "nu", "ln_beta").join(_named(factor), F.col("r") == F.col("f_r")))


def one_rank(measure: DataFrame, v: Column, g: Column, nu: Column, ln_beta: Column) -> DataFrame:
    """Multiply by exp(-g (v'x)^2 / 2 + nu'x + ln_beta): Sherman-Morrison and the determinant lemma, no inverse."""
    out = measure.withColumn("__v", v).withColumn("__s", L.matvec(F.col("Sigma"), F.col("__v"))).withColumn("__d", 1 + g * L.dot(F.col("__v"), F.col("__s")))
    out = out.withColumn("Lambda", L.madd(F.col("Lambda"), L.mscale(L.outer(F.col("__v"), F.col("__v")), g))).withColumn("Sigma", L.madd(F.col("Sigma"), L.mscale(L.outer(F.col("__s"), F.col("__s")), -g / F.col("__d"))))
    out = out.withColumn("ln_det_Sigma", F.col("ln_det_Sigma") - F.ln("__d")).withColumn("nu", L.add(F.col("nu"), nu)).withColumn("ln_beta", F.col("ln_beta") + ln_beta)
    return completed(out.drop("__v", "__s", "__d"))


def linear(measure: DataFrame, nu: Column, ln_beta: Column) -> DataFrame:
    """Multiply by exp(nu'x + ln_beta): Sigma stays."""
    return completed(measure.withColumn("nu", L.add(F.col("nu"), nu)).withColumn("ln_beta", F.col("ln_beta") + ln_beta))


def take(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index table (i, r): order and repeats by i."""
    return index.join(df, "r")


def update(df: DataFrame, new: DataFrame) -> DataFrame:
    """mu and Sigma of the rows that ``new`` has, others as they are."""
    n = new.select("r", F.col("mu").alias("__m"), F.col("Sigma").alias("__s"))
    return df.select("r", "mu", "Sigma").join(n, "r", "left").select("r", F.coalesce("__m", "mu").alias("mu"), F.coalesce("__s", "Sigma").alias("Sigma"))


def marginal(df: DataFrame, dims: list[int]) -> DataFrame:
    return df.select("r", L.pick(F.col("mu"), dims).alias("mu"), L.block(F.col("Sigma"), dims, dims).alias("Sigma"))


def entropy() -> Column:
    return (F.size("mu") * (1 + L.LN2PI) + F.col("ln_det_Sigma")) / 2


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """r, q_r and KL(p || q) of all pairs."""
    o = q.select(F.col("r").alias("q_r"), F.col("mu").alias("q_mu"), F.col("Lambda").alias("q_L"), F.col("ln_det_Sigma").alias("q_ld"))
    return p.crossJoin(o).select("r", "q_r", _kl().alias("kl"))


def _kl() -> Column:
    d = L.add(F.col("q_mu"), L.scale(F.col("mu"), -1.0))
    return (L.trace(L.matmul(F.col("q_L"), F.col("Sigma"))) + L.quad(F.col("q_L"), d) - F.size("mu") + F.col("q_ld") - F.col("ln_det_Sigma")) / 2


def condition_on(df: DataFrame, dim_y: list[int], dims: int) -> DataFrame:
    """p(x|y): M, b, Sigma of the sorted other dimensions."""
    x = [i for i in range(dims) if i not in dim_y]
    out = df.withColumn("__i", L.inverse(L.block(F.col("Lambda"), x, x))).withColumn("S", F.col("__i.inv"))
    out = out.withColumn("M", L.mscale(L.matmul(F.col("S"), L.block(F.col("Lambda"), x, dim_y)), -1.0))
    b = L.add(L.pick(F.col("mu"), x), L.scale(L.matvec(F.col("M"), L.pick(F.col("mu"), dim_y)), -1.0))
    return out.select("r", "M", b.alias("b"), F.col("S").alias("Sigma"))


def linear_sum(df: DataFrame, w: Column, b: Column) -> DataFrame:
    """The density of Wx + b."""
    return df.select("r", L.add(L.matvec(w, F.col("mu")), b).alias("mu"), L.matmul(L.matmul(w, F.col("Sigma")), L.transpose(w)).alias("Sigma"))


def sample(df: DataFrame, n: int, dims: int, seed: int = 0) -> DataFrame:
    """n seeded draws (r, sample_id, x) of each density of ``dims`` dimensions, by its Cholesky factor."""
    own = df.select("r", "mu", L.cholesky(F.col("Sigma")).alias("__c"))
    drawn = own.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__z", F.array(*(F.randn(seed + i) for i in range(dims))))
    # a row of the factor ends at the diagonal
    moved = F.transform("__c", lambda row: L.total(F.zip_with(row, F.slice("__z", F.lit(1), F.size(row)), lambda x, y: x * y)))
    return drawn.select("r", "sample_id", L.add(F.col("mu"), moved).alias("x"))


def evaluate(x: Column) -> Column:
    return F.exp(evaluate_ln(x))


def with_defaults(df: DataFrame) -> DataFrame:
    """A factor of Lambda alone: nu and ln_beta are 0 where they lack."""
    out = df if "nu" in df.columns else df.withColumn("nu", F.transform("Lambda", lambda _: F.lit(0.0)))
    return out if "ln_beta" in out.columns else out.withColumn("ln_beta", F.lit(0.0))


def one_rank_factor(v: Column, g: Column, nu: Column, ln_beta: Column) -> list[Column]:
    """Lambda, nu and ln_beta of exp(-g (v'x)^2 / 2 + nu'x + ln_beta), as rows for ``multiply`` and ``hadamard``."""
    return [L.mscale(L.outer(v, v), g).alias("Lambda"), nu.alias("nu"), ln_beta.alias("ln_beta")]


def linear_factor(nu: Column, ln_beta: Column) -> list[Column]:
    """Lambda, nu and ln_beta of exp(nu'x + ln_beta)."""
    return [F.transform(nu, lambda _: F.transform(nu, lambda _: F.lit(0.0))).alias("Lambda"), nu.alias("nu"), ln_beta.alias("ln_beta")]


def constant_factor(ln_beta: Column, dims: int) -> list[Column]:
    return linear_factor(F.array(*(F.lit(0.0) for _ in range(dims))), ln_beta)


def normalize(df: DataFrame) -> DataFrame:
    """Measures with ``moments``, scaled to integrate to 1."""
    return completed(df.withColumn("ln_beta", -F.col("lnZ")))


def is_normalized(tolerance: float = 1e-9) -> Column:
    return F.abs(F.col("lnZ") + F.col("ln_beta")) <= tolerance


def get_density(df: DataFrame) -> DataFrame:
    """The densities that measures (Lambda, nu, ln_beta) are multiples of."""
    return density(moments(df).select("r", "mu", "Sigma"))


def diagonal_density(df: DataFrame) -> DataFrame:
    """From mu and the variances ``var``: densities, by reciprocals instead of an inverse."""
    out = df.withColumn("Sigma", L.diagonal(F.col("var"))).withColumn("Lambda", L.diagonal(F.transform("var", lambda x: 1 / x)))
    out = out.withColumn("ln_det_Sigma", L.total(F.transform("var", lambda x: F.ln(x)))).withColumn("nu", F.zip_with("mu", "var", lambda m, v: m / v))
    return completed(out.withColumn("ln_beta", F.lit(0.0))).withColumn("ln_beta", -F.col("lnZ")).withColumn("log_integral", F.lit(0.0))


def diagonal_moments(df: DataFrame) -> DataFrame:
    """``moments`` of measures whose Lambda is diagonal."""
    out = df.withColumn("__l", L.diagonal_of(F.col("Lambda"))).withColumn("Sigma", L.diagonal(F.transform("__l", lambda x: 1 / x)))
    return completed(out.withColumn("ln_det_Sigma", -L.total(F.transform("__l", lambda x: F.ln(x)))).drop("__l"))


def kl_aligned(p: DataFrame, q: DataFrame) -> DataFrame:
    """r and KL(p || q) of the rows of equal r."""
    o = q.select(F.col("r").alias("q_r"), F.col("mu").alias("q_mu"), F.col("Lambda").alias("q_L"), F.col("ln_det_Sigma").alias("q_ld"))
    return p.join(o, F.col("r") == F.col("q_r")).select("r", _kl().alias("kl"))


def condition_on_explicit(df: DataFrame, dim_y: list[int], dim_x: list[int]) -> DataFrame:
    """p(x|y) for these dimensions in this order; those in neither are integrated out."""
    out = df.withColumn("__i", L.inverse(L.block(F.col("Sigma"), dim_y, dim_y))["inv"]).withColumn("M", L.matmul(L.block(F.col("Sigma"), dim_x, dim_y), F.col("__i")))
    b = L.add(L.pick(F.col("mu"), dim_x), L.scale(L.matvec(F.col("M"), L.pick(F.col("mu"), dim_y)), -1.0))
    s = L.madd(L.block(F.col("Sigma"), dim_x, dim_x), L.mscale(L.matmul(F.col("M"), L.block(F.col("Sigma"), dim_y, dim_x)), -1.0))
    return out.select("r", "M", b.alias("b"), s.alias("Sigma"))


class Affine:
    """Ax + a under a measure: its mean, and covariances with others; A is the identity and a 0 where they lack."""

    def __init__(self, a: Column | None = None, c: Column | None = None):
        self.a = L.identity(F.size("mu")) if a is None else a
        moved = L.matvec(self.a, F.col("mu"))
        self.mean = moved if c is None else L.add(moved, c)

    def cov(self, o: Affine) -> Column:
        return L.matmul(L.matmul(self.a, F.col("Sigma")), L.transpose(o.a))

    def second(self, o: Affine) -> Column:
        """The expectation of the outer product."""
        return L.madd(self.cov(o), L.outer(self.mean, o.mean))


def z() -> Column:
    return F.exp("log_integral")


def _times(m: Column, v: Column) -> Column:
    return L.matvec(m, v)


#: Expression to a function of the affine forms; each result is the integral over the measure.
INTEGRALS = {
    "1": lambda: z(),
    "x": lambda: L.scale(F.col("mu"), z()),
    "(Ax+a)": lambda A: L.scale(A.mean, z()),
    "xx'": lambda: L.mscale(L.madd(F.col("Sigma"), L.outer(F.col("mu"), F.col("mu"))), z()),
    "(Ax+a)'(Bx+b)": lambda A, B: z() * (L.trace(A.cov(B)) + L.dot(A.mean, B.mean)),
    "(Ax+a)(Bx+b)'": lambda A, B: L.mscale(L.madd(A.cov(B), L.outer(A.mean, B.mean)), z()),
    "xb'xx'": lambda b: L.mscale(L.madd(L.madd(L.outer(F.col("mu"), L.matvec(L.madd(F.col("Sigma"), L.outer(F.col("mu"), F.col("mu"))), b)), L.mscale(F.col("Sigma"), L.dot(b, F.col("mu")))), L.outer(L.matvec(F.col("Sigma"), b), F.col("mu"))), z()),
    "(Ax+a)(Bx+b)'(Cx+c)": lambda A, B, C: L.scale(L.add(L.add(_times(A.cov(B), C.mean), _times(A.cov(C), B.mean)), L.scale(A.mean, L.trace(B.cov(C)) + L.dot(B.mean, C.mean))), z()),
    "(Ax+a)'(Bx+b)(Cx+c)'": lambda A, B, C: L.scale(L.add(L.add(_times(L.transpose(B.cov(C)), A.mean), _times(L.transpose(A.cov(C)), B.mean)), L.scale(C.mean, L.trace(A.cov(B)) + L.dot(A.mean, B.mean))), z()),
    "log u(x)": lambda lam, nu, ln_beta: log_factor_integral(lam, nu, ln_beta),
    "x(A'x + a)x'": lambda b, a: L.madd(INTEGRALS["xb'xx'"](b), L.mscale(INTEGRALS["xx'"](), a)),
    "(Ax+a)(Bx+b)'(Cx+c)(Dx+d)'": lambda A, B, C, D: L.mscale(
        L.madd(
            L.madd(L.matmul(A.second(B), C.second(D)), L.matmul(A.second(C), B.second(D))),
            L.madd(L.mscale(L.madd(A.cov(D), L.mscale(L.outer(A.mean, D.mean), -1.0)), L.dot(B.mean, C.mean)), L.mscale(A.second(D), L.trace(B.cov(C)))),
        ),
        z(),
    ),
    "(Ax+a)'(Bx+b)(Cx+c)'(Dx+d)": lambda A, B, C, D: z()
    * (
        L.trace(L.matmul(A.cov(C), D.cov(B)))
        + L.trace(L.matmul(A.cov(D), C.cov(B)))
        + L.dot(A.mean, L.matvec(B.cov(C), D.mean))
        + L.dot(A.mean, L.matvec(B.cov(D), C.mean))
        + L.dot(B.mean, L.matvec(A.cov(C), D.mean))
        + L.dot(B.mean, L.matvec(A.cov(D), C.mean))
        + (L.trace(A.cov(B)) + L.dot(A.mean, B.mean)) * (L.trace(C.cov(D)) + L.dot(C.mean, D.mean))
    ),
}


def integrate(expr: str, *args) -> Column:
    """The integral of an expression over measures with ``moments``; unknown expressions raise KeyError."""
    return INTEGRALS[expr](*args)


def log_factor_integral(lam: Column, nu: Column, ln_beta: Column) -> Column:
    """The integral of a factor's log."""
    second = L.madd(F.col("Sigma"), L.outer(F.col("mu"), F.col("mu")))
    return z() * (-L.trace(L.matmul(lam, second)) / 2 + L.dot(nu, F.col("mu")) + ln_beta)
