"""Registered queries on the driver's tables, each with SQL written component by component."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import wide as W
from ..operators import conditional as C
from ..operators import control as N
from ..operators import gaussian as G
from ..operators import heteroscedastic as H
from ..operators import kernels as K
from ..sources.fit import fit
from ..sources.wide import fit_wide
from ..streaming.kalman import kalman_filter

P = 6
LP = repr(math.log(2 * math.pi))


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scaled(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), (F.col("l_quantity") / 10).alias("u"), (F.col("l_discount") * 10).alias("v"), (F.col("l_tax") * 10).alias("w"))


def groups(spark, d, dims=2):
    return G.density(fit(_scaled(spark, d), "f", ["u", "v", "w"][:dims]))


def unnormalised(spark, d):
    """The groups' densities times 2."""
    return G.completed(groups(spark, d).withColumn("ln_beta", F.col("ln_beta") + math.log(2)))


def r(c):
    return F.round(c.cast("double"), P) + 0.0


def at(c, *i):
    for k in i:
        c = F.get(c, F.lit(k))
    return c


def col(name, *i):
    return at(F.col(name), *i)


QUERIES, ORACLES = {}, {}
BASE = f"""WITH b AS (SELECT l_returnflag AS r, CAST(l_quantity AS DOUBLE) / 10 AS u, CAST(l_discount AS DOUBLE) * 10 AS v, CAST(l_tax AS DOUBLE) * 10 AS w FROM lineitem),
m AS (SELECT r, count(*) AS n, avg(u) AS m1, avg(v) AS m2, avg(w) AS m3, var_pop(u) AS s11, covar_pop(u, v) AS s12, var_pop(v) AS s22, covar_pop(u, w) AS s13, covar_pop(v, w) AS s23, var_pop(w) AS s33 FROM b GROUP BY r),
g AS (SELECT *, s11 * s22 - s12 * s12 AS det, s22 / (s11 * s22 - s12 * s12) AS l11, -s12 / (s11 * s22 - s12 * s12) AS l12, s11 / (s11 * s22 - s12 * s12) AS l22 FROM m),
h AS (SELECT *, l11 * m1 + l12 * m2 AS v1, l12 * m1 + l22 * m2 AS v2, -(m1 * (l11 * m1 + l12 * m2) + m2 * (l12 * m1 + l22 * m2) + 2 * {LP} + ln(det)) / 2 AS lb FROM g)
"""


def register(name, build, names, sql_exprs, source="h", base=BASE, keys=("r",)):
    """A query of rounded scalars: ``build`` gives (frame, columns); the SQL gives the same names."""

    def query(spark, d):
        df, cols = build(spark, d)
        return df.select(*(F.col(k) for k in keys), *(r(c).alias(n) for n, c in zip(names, cols, strict=True)))

    query.__name__ = name
    QUERIES[name] = query
    ORACLES[name] = base + "SELECT " + ", ".join([*keys, *(f"round(CAST({e} AS DOUBLE), {P}) + 0.0 AS {n}" for n, e in zip(names, sql_exprs, strict=True))]) + f" FROM {source}"


register("gauss_fit_2d", lambda s, d: (groups(s, d), [col("mu", 0), col("mu", 1), col("Sigma", 0, 0), col("Sigma", 0, 1), col("Sigma", 1, 1), col("Lambda", 0, 0), col("Lambda", 0, 1), col("Lambda", 1, 1), F.col("ln_det_Sigma")]), ["mu1", "mu2", "s11", "s12", "s22", "l11", "l12", "l22", "ld"], ["m1", "m2", "s11", "s12", "s22", "l11", "l12", "l22", "ln(det)"])
register("gauss_entropy", lambda s, d: (groups(s, d), [G.entropy()]), ["entropy"], [f"(2 * (1 + {LP}) + ln(det)) / 2"])
register("gauss_natural", lambda s, d: (groups(s, d), [col("nu", 0), col("nu", 1), F.col("ln_beta")]), ["v1", "v2", "lb"], ["v1", "v2", "lb"])


_E = "-(l11 * x1 * x1 + 2 * l12 * x1 * x2 + l22 * x2 * x2) / 2 + v1 * x1 + v2 * x2 + lb"
_PTS = BASE + ", p AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x1, CAST(p_retailprice AS DOUBLE) / 1000 AS x2 FROM part)\n"


def _all_points(s, d):
    return _read(s, d, "part").select("p_partkey", F.array((F.col("p_size") / 10).cast("double"), (F.col("p_retailprice") / 1000).cast("double")).alias("x"))


register("factor_evaluate_ln", lambda s, d: (_all_points(s, d).crossJoin(F.broadcast(groups(s, d))), [G.evaluate_ln(F.col("x"))]), ["value"], [_E], "h, p", _PTS, ("r", "p_partkey"))
register("factor_evaluate_elementwise", lambda s, d: (groups(s, d), [F.exp(G.evaluate_ln(F.array(col("mu", 0) + 0.5, col("mu", 1) - 0.5)))]), ["value"], ["exp(" + _E.replace("x1", "(m1 + 0.5)").replace("x2", "(m2 - 0.5)") + ")"])
register("factor_product", lambda s, d: (G.product(groups(s, d), 2), [col("Lambda", 0, 0), col("Lambda", 0, 1), col("Lambda", 1, 1), col("nu", 0), col("nu", 1), F.col("ln_beta")]), ["l11", "l12", "l22", "v1", "v2", "lb"], ["sum(l11)", "sum(l12)", "sum(l22)", "sum(v1)", "sum(v2)", "sum(lb)"], keys=())
_PAIR = BASE + f""", c0 AS (SELECT a.r AS r, f.r AS f_r, a.l11 + f.l11 AS a11, a.l12 + f.l12 AS a12, a.l22 + f.l22 AS a22, a.v1 + f.v1 AS w1, a.v2 + f.v2 AS w2, a.lb + f.lb AS bb FROM h a, h f),
c AS (SELECT *, (a22 * w1 - a12 * w2) / (a11 * a22 - a12 * a12) AS c1, (a11 * w2 - a12 * w1) / (a11 * a22 - a12 * a12) AS c2, a11 * a22 - a12 * a12 AS cd FROM c0)
"""
_LI = f"(w1 * c1 + w2 * c2 + 2 * {LP} - ln(cd)) / 2 + bb"
_pc = lambda: [col("mu", 0), col("mu", 1), F.col("log_integral")]
register("measure_multiply", lambda s, d: (G.moments(G.multiply(groups(s, d), groups(s, d))), _pc()), ["c1", "c2", "li"], ["c1", "c2", _LI], "c", _PAIR, ("r", "f_r"))
register("measure_hadamard", lambda s, d: (G.moments(G.hadamard(groups(s, d), groups(s, d))), _pc()), ["c1", "c2", "li"], ["c1", "c2", _LI], "c WHERE r = f_r", _PAIR, ("r",))
_RANK = BASE + """, c0 AS (SELECT r, l11 + 0.5 AS a11, l12 + 0.5 * 2 AS a12, l22 + 0.5 * 4 AS a22, v1 + 0.1 AS w1, v2 - 0.2 AS w2, lb + 0.3 AS bb FROM h),
c AS (SELECT *, (a22 * w1 - a12 * w2) / (a11 * a22 - a12 * a12) AS c1, (a11 * w2 - a12 * w1) / (a11 * a22 - a12 * a12) AS c2, a11 * a22 - a12 * a12 AS cd FROM c0)
"""
register("one_rank_update", lambda s, d: (G.one_rank(groups(s, d), L.vec(1, 2), F.lit(0.5), L.vec(0.1, -0.2), F.lit(0.3)), _pc()), ["c1", "c2", "li"], ["c1", "c2", _LI], "c", _RANK)
register("linear_update", lambda s, d: (G.linear(groups(s, d), L.vec(0.1, -0.2), F.lit(0.3)), _pc()), ["c1", "c2", "li"], ["c1", "c2", _LI], "c", _RANK.replace("l11 + 0.5", "l11").replace("l12 + 0.5 * 2", "l12").replace("l22 + 0.5 * 4", "l22"))
register("constant_update", lambda s, d: (G.linear(groups(s, d), L.vec(0, 0), F.lit(0.3)), [F.col("log_integral")]), ["li"], ["0.3"])
register("pdf_marginal", lambda s, d: (G.marginal(groups(s, d, 3), [2, 0]), [col("mu", 0), col("mu", 1), col("Sigma", 0, 0), col("Sigma", 0, 1)]), ["a", "b", "c", "e"], ["m3", "m1", "s33", "s13"])
register("pdf_condition_on", lambda s, d: (G.condition_on(groups(s, d), [1], 2), [col("M", 0, 0), col("b", 0), col("Sigma", 0, 0)]), ["M", "b", "S"], ["s12 / s22", "m1 - s12 / s22 * m2", "s11 - s12 * s12 / s22"])
register("pdf_linear_sum", lambda s, d: (G.linear_sum(groups(s, d), L.mat([[1, 2]]), L.vec(0.5)), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], ["m1 + 2 * m2 + 0.5", "s11 + 4 * s12 + 4 * s22"])
register("pdf_kl_divergence", lambda s, d: (G.kl_divergence(groups(s, d), groups(s, d)), [F.col("kl")]), ["kl"], ["(q.l11 * p.s11 + 2 * q.l12 * p.s12 + q.l22 * p.s22 + q.l11 * (q.m1 - p.m1) * (q.m1 - p.m1) + 2 * q.l12 * (q.m1 - p.m1) * (q.m2 - p.m2) + q.l22 * (q.m2 - p.m2) * (q.m2 - p.m2) - 2 + ln(q.det) - ln(p.det)) / 2"], "h p, h q", keys=("r", "q_r"))
ORACLES["pdf_kl_divergence"] = ORACLES["pdf_kl_divergence"].replace("SELECT r, q_r,", "SELECT p.r AS r, q.r AS q_r,")
register("pdf_slice", lambda s, d: (G.take(groups(s, d), s.sql("SELECT * FROM VALUES (0, 'A'), (1, 'R'), (2, 'A') AS t(i, r)")), [col("mu", 0)]), ["mu1"], ["m1"], "h JOIN (VALUES (0, 'A'), (1, 'R'), (2, 'A')) AS t(i, k) ON h.r = t.k", keys=("i", "r"))
register("pdf_update", lambda s, d: (G.update(groups(s, d), s.sql("SELECT 'A' AS r, array(1D, 2D) AS mu, array(array(1D, 0D), array(0D, 1D)) AS Sigma")), [col("mu", 0), col("Sigma", 1, 1)]), ["mu1", "s22"], ["CASE WHEN r = 'A' THEN 1 ELSE m1 END", "CASE WHEN r = 'A' THEN 1 ELSE s22 END"])

# integrals: forms with one row each, so that Isserlis' sums of scalars are the oracle
_FORMS = {"A": ((1, 2), 0.5), "B": ((0.5, -1), 0.25), "C": ((2, 1), -1.0), "D": ((1, -0.5), 0.75)}
_mean = {k: f"({a[0]} * m1 + {a[1]} * m2 + {c})" for k, (a, c) in _FORMS.items()}
_cov = {i + j: f"({a[0] * b[0]} * s11 + {a[0] * b[1] + a[1] * b[0]} * s12 + {a[1] * b[1]} * s22)" for i, (a, _) in _FORMS.items() for j, (b, _) in _FORMS.items()}


def forms(n):
    return [G.Affine(L.mat([a]), L.vec(c)) for a, c in list(_FORMS.values())[:n]]


def _isserlis(names):
    """The expectation of a product of jointly Gaussian scalars."""
    if not names:
        return "1"
    a, rest = names[0], names[1:]
    parts = [f"{_mean[a]} * ({_isserlis(rest)})"] + [f"{_cov[a + b]} * ({_isserlis(rest[:i] + rest[i + 1 :])})" for i, b in enumerate(rest)]
    return " + ".join(parts)


for _name, _expr, _n, _ix in [("integrate_general_linear", "(Ax+a)", 1, (0,)), ("integrate_quadratic_inner", "(Ax+a)'(Bx+b)", 2, ()), ("integrate_quadratic_outer", "(Ax+a)(Bx+b)'", 2, (0, 0)), ("integrate_cubic_inner", "(Ax+a)(Bx+b)'(Cx+c)", 3, (0,)), ("integrate_cubic_outer", "(Ax+a)'(Bx+b)(Cx+c)'", 3, (0,)), ("integrate_quartic_inner", "(Ax+a)'(Bx+b)(Cx+c)'(Dx+d)", 4, ()), ("integrate_quartic_outer", "(Ax+a)(Bx+b)'(Cx+c)(Dx+d)'", 4, (0, 0))]:
    register(_name, lambda s, d, e=_expr, n=_n, ix=_ix: (unnormalised(s, d), [at(G.integrate(e, *forms(n)), *ix)]), ["value"], [f"2 * ({_isserlis('ABCD'[:_n])})"])
register("integrate_1", lambda s, d: (unnormalised(s, d), [G.integrate("1")]), ["value"], ["2"])
register("integrate_x", lambda s, d: (unnormalised(s, d), [at(G.integrate("x"), 0), at(G.integrate("x"), 1)]), ["x1", "x2"], ["2 * m1", "2 * m2"])
register("integrate_xxT", lambda s, d: (unnormalised(s, d), [at(G.integrate("xx'"), 0, 0), at(G.integrate("xx'"), 0, 1)]), ["x11", "x12"], ["2 * (s11 + m1 * m1)", "2 * (s12 + m1 * m2)"])
register("integrate_xbxx", lambda s, d: (unnormalised(s, d), [at(G.integrate("xb'xx'", L.vec(1, 0)), 0, 1)]), ["x12"], ["2 * (m1 * (s12 + m1 * m2) + m1 * s12 + s11 * m2)"])
register("integrate_cubic_outer_x", lambda s, d: (unnormalised(s, d), [at(G.integrate("x(A'x + a)x'", L.vec(1, 0), 0.5), 0, 1)]), ["x12"], ["2 * (m1 * (s12 + m1 * m2) + m1 * s12 + s11 * m2 + 0.5 * (s12 + m1 * m2))"])
register("integrate_log_factor", lambda s, d: (unnormalised(s, d), [G.log_factor_integral(F.col("Lambda"), F.col("nu"), F.col("ln_beta"))]), ["value"], [f"2 * (-(2 + m1 * v1 + m2 * v2) / 2 + v1 * m1 + v2 * m2 + lb + {math.log(2)!r})"])

# a regression of w on (u, v) as a conditional; x has the groups' densities
_M, _B, _S = (0.5, -0.25), 0.1, 0.3
_cond = lambda s: C.conditional(s.sql(f"SELECT 0 AS c, '0' AS r, array(array({_M[0]}D, {_M[1]}D)) AS M, array({_B}D) AS b, array(array({_S}D)) AS Sigma")).drop("c")
_ym, _yv = f"({_M[0]} * m1 + {_M[1]} * m2 + {_B})", f"({_M[0] ** 2} * s11 + {2 * _M[0] * _M[1]} * s12 + {_M[1] ** 2} * s22 + {_S})"
_c1, _c2 = f"({_M[0]} * s11 + {_M[1]} * s12)", f"({_M[0]} * s12 + {_M[1]} * s22)"
_kx = dict(keys=("x_r",))


def _x(sql):
    return sql.replace("SELECT x_r,", "SELECT r AS x_r,")


for _name, _build, _names, _sql in [
    ("affine_marginal", lambda s, d: (C.affine_marginal(_cond(s), groups(s, d)), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], [_ym, _yv]),
    ("affine_joint", lambda s, d: (C.affine_joint(_cond(s), groups(s, d)), [col("mu", 2), col("Sigma", 0, 2), col("Sigma", 2, 1), col("Sigma", 2, 2)]), ["mu", "s13", "s32", "s33"], [_ym, _c1, _c2, _yv]),
    ("affine_conditional", lambda s, d: (C.affine_conditional(_cond(s), groups(s, d)), [col("M", 0, 0), col("b", 0), col("Sigma", 0, 1)]), ["g", "b", "s12"], [f"{_c1} / {_yv}", f"m1 - {_c1} / {_yv} * {_ym}", f"s12 - {_c1} * {_c2} / {_yv}"]),
    ("mutual_information", lambda s, d: (C.mutual_information(_cond(s), groups(s, d)), [F.col("mutual_information")]), ["mi"], [f"ln({_yv} / {_S}) / 2"]),
    ("integrate_log_conditional_y", lambda s, d: (C.log_conditional_y(_cond(s), groups(s, d), L.vec(1.0)), [F.col("value")]), ["value"], [f"-((1 - {_ym}) * (1 - {_ym}) / {_S} + ({_yv} - {_S}) / {_S} + {LP} + ln({_S})) / 2"]),
]:
    register(_name, _build, _names, _sql, **_kx)
    ORACLES[_name] = _x(ORACLES[_name])
register("identity_marginal", lambda s, d: (C.affine_marginal(C.identity(s.sql("SELECT '0' AS r, array(array(1D, 0D), array(0D, 2D)) AS Sigma")), groups(s, d)), [col("mu", 0), col("Sigma", 0, 0), col("Sigma", 1, 1)]), ["mu", "a", "b"], ["m1", "s11 + 1", "s22 + 2"], **_kx)
ORACLES["identity_marginal"] = _x(ORACLES["identity_marginal"])


def _likelihoods(s, d):
    y = _read(s, d, "part").select(F.col("p_partkey").alias("n"), F.array((F.col("p_retailprice") / 1000).cast("double")).alias("y"))
    return G.product(C.set_y(F.broadcast(_cond(s)), y), 2)


_y = f"(p_retailprice / 1000 - {_B})"
register("bayes_update", lambda s, d: (_likelihoods(s, d), [col("Lambda", 0, 1), col("nu", 0), F.col("ln_beta")]), ["l12", "v1", "lb"], [f"count(*) * {_M[0] * _M[1] / _S}", f"sum({_y}) * {_M[0] / _S}", f"-sum({_y} * {_y} / {_S} + {LP} + ln({_S})) / 2"], "part", "", ())


def _truncated(s, d):
    return _read(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))


register("truncated_moments", lambda s, d: (_truncated(s, d), list(C.truncated(F.col("m"), F.col("sd"), F.col("m") - F.col("sd"), F.col("m") + F.col("sd")).values())), ["mass", "mean", "variance"], ["0.6826894921370859", "m", f"sd * sd * (1 - 2 * {math.exp(-0.5) / math.sqrt(2 * math.pi)!r} / 0.6826894921370859)"], "(SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)", "", ("event_type",))
_L2 = f"(1 - 2 * {math.exp(-0.5) / math.sqrt(2 * math.pi)!r} / 0.6826894921370859)"
_L4 = f"({_L2} * 3 - 2 * {math.exp(-0.5) / math.sqrt(2 * math.pi)!r} / 0.6826894921370859)"
register("truncated_moment_k", lambda s, d: (_truncated(s, d), [C.truncated_moment(F.col("m"), F.col("sd"), F.col("m") - F.col("sd"), F.col("m") + F.col("sd"), k) for k in (3, 4)]), ["third", "fourth"], [f"m * m * m + 3 * m * sd * sd * {_L2}", f"m * m * m * m + 6 * m * m * sd * sd * {_L2} + sd * sd * sd * sd * {_L4}"], "(SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)", "", ("event_type",))
register("kalman_filter", lambda s, d: (kalman_filter(_read(s, d, "events"), "user_id", ["ts", "event_id"], "value", 0.9, 0.5, 1.0, 2.0), [F.col("n"), F.col("mean"), F.col("variance")]), ["n", "mean", "variance"], ["n", "m", "p"], "k WHERE i = n", """WITH RECURSIVE e AS (SELECT user_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
k AS (SELECT user_id, n, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS m, CAST(1 AS DOUBLE) AS p FROM e WHERE i = 1
UNION ALL SELECT k.user_id, k.n, e.i, 0.9 * k.m + (0.81 * k.p + 0.5) / (0.81 * k.p + 2.5) * (e.x - 0.9 * k.m), (0.81 * k.p + 0.5) - (0.81 * k.p + 0.5) * (0.81 * k.p + 0.5) / (0.81 * k.p + 2.5) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
""", ("user_id",))

# one kernel, one output: the SQL has the two-dimensional closed form
_KN = ([2.0, 0.4], [1.5, 0.7])


def _kernel_sql(tag, l1, l2):
    p = f"((s11 + {l1**2!r}) * (s22 + {l2**2!r}) - s12 * s12)"
    w1, w2 = f"(((s22 + {l2**2!r}) * (2.0 - m1) - s12 * (0.4 - m2)) / {p})", f"(((s11 + {l1**2!r}) * (0.4 - m2) - s12 * (2.0 - m1)) / {p})"
    return f"{l1 * l2!r} / sqrt({p}) * exp(-((2.0 - m1) * {w1} + (0.4 - m2) * {w2}) / 2) AS k{tag}, {w1} AS w1{tag}, {w2} AS w2{tag}"


_KB = BASE + f", q AS (SELECT *, {_kernel_sql('a', 1.5, 0.7)}, {_kernel_sql('b', 1.5 / math.sqrt(2), 0.7 / math.sqrt(2))} FROM h)\n"
_KC = ("(ka * (s11 * w1a + s12 * w2a))", "(ka * (s12 * w1a + s22 * w2a))")
register(
    "kernel_marginal",
    lambda s, d: (K.marginal(groups(s, d), [_KN], [[0.5, -0.25, 2.0]], [0.1], [[0.3]]), [col("mu", 0), col("Sigma", 0, 0), col("cross", 0, 0)]),
    ["mu", "S", "c"],
    ["0.5 * m1 - 0.25 * m2 + 2 * ka + 0.1", f"0.3 + 0.25 * s11 - 0.25 * s12 + 0.0625 * s22 + 4 * (0.5 * {_KC[0]} - 0.25 * {_KC[1]}) + 4 * (kb - ka * ka)", f"0.5 * s11 - 0.25 * s12 + 2 * {_KC[0]}"],
    "q",
    _KB,
)

_HM, _HV = "(0.3 * m1 - 0.2 * m2 + 0.1)", "(0.09 * s11 - 0.12 * s12 + 0.04 * s22)"
_HB = "0.3 + 0.25 * s11 - 0.25 * s12 + 0.0625 * s22 + 0.64 * "
for _link, _e in (("exp", f"exp({_HM} + {_HV} / 2)"), ("cosh_minus_one", f"((exp({_HM} + {_HV} / 2) + exp({_HV} / 2 - {_HM})) / 2 - 1)")):
    register(f"hetero_{_link}_marginal", lambda s, d, k=_link: (H.marginal(groups(s, d), k, [[0.5, -0.25]], [0.1], [[0.3]], [[0.8]], [[0.3, -0.2]], [0.1]), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], ["0.5 * m1 - 0.25 * m2 + 0.1", _HB + _e])

# conditionals at points, entropies, expectations over joints
register("condition_on_x", lambda s, d: (C.condition_on_x(_cond(s), _all_points(s, d).select(F.col("p_partkey").alias("n"), "x")), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], [f"{_M[0]} * x1 + {_M[1]} * x2 + {_B}", f"{_S}"], "(SELECT p_partkey AS n, p_size / 10.0::DOUBLE AS x1, CAST(p_retailprice AS DOUBLE) / 1000 AS x2 FROM part)", "", ("n",))
register("conditional_entropy", lambda s, d: (_cond(s), [C.conditional_entropy()]), ["entropy"], [f"(1 + {LP} + ln({_S})) / 2"], "(SELECT '0' AS r)", "", ("r",))
_one = lambda s: C.conditional(s.sql(f"SELECT '0' AS r, array(array({_M[0]}D)) AS M, array({_B}D) AS b, array(array({_S}D)) AS Sigma"))
_res = f"(m1 - {_M[0]} * m2 - {_B})"
register("integrate_log_conditional", lambda s, d: (C.log_conditional(_one(s), groups(s, d)), [F.col("value")]), ["value"], [f"-((s11 - {2 * _M[0]} * s12 + {_M[0] ** 2} * s22 + {_res} * {_res}) / {_S} + {LP} + ln({_S})) / 2"], **_kx)
register("conditional_update_sigma", lambda s, d: (C.update_sigma(_cond(s), s.sql("SELECT '0' AS r, array(array(2D)) AS Sigma")), [col("Lambda", 0, 0), F.col("ln_det_Sigma")]), ["l", "ld"], ["0.5", "ln(2)"], "(SELECT '0' AS r)", "", ("r",))
_id = lambda s: C.identity_diagonal(s.sql("SELECT '0' AS r, array(1D, 2D) AS var"))
register("identity_diagonal_joint", lambda s, d: (C.affine_joint(_id(s), groups(s, d)), [col("mu", 3), col("Sigma", 0, 2), col("Sigma", 3, 3)]), ["mu", "c", "v"], ["m2", "s11", "s22 + 2"], **_kx)
register("identity_mutual_information", lambda s, d: (C.mutual_information(_id(s), groups(s, d)), [F.col("mutual_information")]), ["mi"], ["ln(((s11 + 1) * (s22 + 2) - s12 * s12) / 2) / 2"], **_kx)
register("identity_conditional", lambda s, d: (C.affine_conditional(_id(s), groups(s, d)), [col("M", 0, 0), col("M", 0, 1)]), ["g11", "g12"], ["(s11 * (s22 + 2) - s12 * s12) / ((s11 + 1) * (s22 + 2) - s12 * s12)", "(s12 * (s11 + 1) - s11 * s12) / ((s11 + 1) * (s22 + 2) - s12 * s12)"], **_kx)
register("identity_log_conditional_y", lambda s, d: (C.log_conditional_y(_id(s), groups(s, d), L.vec(1.0, 0.5)), [F.col("value")]), ["value"], [f"-((1 - m1) * (1 - m1) + s11 + ((0.5 - m2) * (0.5 - m2) + s22) / 2 + 2 * {LP} + ln(2)) / 2"], **_kx)
for _name in ("integrate_log_conditional", "identity_diagonal_joint", "identity_mutual_information", "identity_conditional", "identity_log_conditional_y"):
    ORACLES[_name] = _x(ORACLES[_name])

# measures: scaling, densities, kinds of factors, diagonals
register("measure_normalize", lambda s, d: (G.normalize(unnormalised(s, d)), [F.col("ln_beta"), F.col("log_integral"), G.is_normalized().cast("int")]), ["lb", "li", "ok"], ["lb", "0", "1"])
register("measure_get_density", lambda s, d: (G.get_density(G.multiply(groups(s, d), groups(s, d)).select(F.concat_ws("-", "r", "f_r").alias("r"), "Lambda", "nu", "ln_beta")), [col("mu", 0), col("mu", 1)]), ["c1", "c2"], ["c1", "c2"], "(SELECT concat_ws('-', r, f_r) AS r, c1, c2 FROM c)", _PAIR)
register("factor_defaults", lambda s, d: (G.moments(G.with_defaults(groups(s, d).select("r", "Lambda"))), [col("mu", 0), F.col("log_integral")]), ["mu", "li"], ["0", f"(2 * {LP} + ln(det)) / 2"])
_kinds = lambda s: [s.range(1).select(F.lit(k).alias("r"), *f) for k, f in (("linear", G.linear_factor(L.vec(0.1, -0.2), F.lit(0.3))), ("one_rank", G.one_rank_factor(L.vec(1, 2), F.lit(0.5), L.vec(0.1, -0.2), F.lit(0.3))), ("constant", G.constant_factor(F.lit(0.3), 2)))]
_KINDS = BASE + """, k AS (SELECT * FROM (VALUES ('linear', 0.0::DOUBLE, 0.1::DOUBLE, -0.2::DOUBLE), ('one_rank', 0.5, 0.1, -0.2), ('constant', 0.0, 0.0, 0.0)) AS t(f_r, q, n1, n2)),
c0 AS (SELECT r, f_r, l11 + q AS a11, l12 + q * 2 AS a12, l22 + q * 4 AS a22, v1 + n1 AS w1, v2 + n2 AS w2, lb + 0.3 AS bb FROM h, k),
c AS (SELECT *, (a22 * w1 - a12 * w2) / (a11 * a22 - a12 * a12) AS c1, (a11 * w2 - a12 * w1) / (a11 * a22 - a12 * a12) AS c2, a11 * a22 - a12 * a12 AS cd FROM c0)
"""


def _all_kinds(s, d):
    a, b, c = _kinds(s)
    return G.moments(G.multiply(groups(s, d), a.unionByName(b).unionByName(c)))


register("factor_kinds_multiply", lambda s, d: (_all_kinds(s, d), _pc()), ["c1", "c2", "li"], ["c1", "c2", _LI], "c", _KINDS, ("r", "f_r"))
_diag = lambda s, d: G.diagonal_density(groups(s, d).select("r", "mu", F.array(col("Sigma", 0, 0), col("Sigma", 1, 1)).alias("var")))
register("diagonal_density", lambda s, d: (_diag(s, d), [col("Lambda", 1, 1), col("nu", 0), F.col("ln_beta"), G.entropy()]), ["l22", "v1", "lb", "e"], ["1 / s22", "m1 / s11", f"-(m1 * m1 / s11 + m2 * m2 / s22 + 2 * {LP} + ln(s11 * s22)) / 2", f"(2 * (1 + {LP}) + ln(s11 * s22)) / 2"])
register("diagonal_measure_multiply", lambda s, d: (G.diagonal_moments(G.hadamard(_diag(s, d), _diag(s, d))), [col("mu", 0), col("Sigma", 1, 1), F.col("log_integral")]), ["mu", "s", "li"], ["m1", "s22 / 2", f"-({LP} + {LP} + ln(s11 * s22) + 2 * ln(2)) / 2"])
register("pdf_kl_aligned", lambda s, d: (G.kl_aligned(groups(s, d), _diag(s, d)), [F.col("kl")]), ["kl"], ["(ln(s11 * s22) - ln(det)) / 2"])
register("pdf_condition_on_explicit", lambda s, d: (G.condition_on_explicit(groups(s, d, 3), [2], [1, 0]), [col("M", 0, 0), col("M", 1, 0), col("b", 1), col("Sigma", 0, 1)]), ["m2", "m1", "b1", "s"], ["s23 / s33", "s13 / s33", "m1 - s13 / s33 * m3", "s12 - s13 * s23 / s33"])

# forms with two rows: a transposed result would differ
_TWO = {"A": (((1, 2), (0, 1)), (0.5, -1)), "B": (((0.5, -1), (1, 1)), (0.25, 0)), "C": (((2, 1), (-1, 0.5)), (-1, 2)), "D": (((1, -0.5), (0.25, 1)), (0.75, 1))}
for _k, (_a, _c) in _TWO.items():
    for _i in (0, 1):
        _mean[_k + str(_i)] = f"({_a[_i][0]} * m1 + {_a[_i][1]} * m2 + {_c[_i]})"
_pairs = [(_k + str(_i), _a[_i]) for _k, (_a, _) in _TWO.items() for _i in (0, 1)]
_cov |= {i + j: f"({a[0] * b[0]} * s11 + {a[0] * b[1] + a[1] * b[0]} * s12 + {a[1] * b[1]} * s22)" for i, a in _pairs for j, b in _pairs}


def _two(n):
    return [G.Affine(L.mat(a), L.vec(*c)) for a, c in list(_TWO.values())[:n]]


for _name, _expr, _n, _ix, _terms in [
    ("quadratic_inner", "(Ax+a)'(Bx+b)", 2, (), [("A0", "B0"), ("A1", "B1")]),
    ("quadratic_outer", "(Ax+a)(Bx+b)'", 2, (0, 1), [("A0", "B1")]),
    ("cubic_inner", "(Ax+a)(Bx+b)'(Cx+c)", 3, (1,), [("A1", "B0", "C0"), ("A1", "B1", "C1")]),
    ("cubic_outer", "(Ax+a)'(Bx+b)(Cx+c)'", 3, (1,), [("A0", "B0", "C1"), ("A1", "B1", "C1")]),
    ("quartic_outer", "(Ax+a)(Bx+b)'(Cx+c)(Dx+d)'", 4, (0, 1), [("A0", "B0", "C0", "D1"), ("A0", "B1", "C1", "D1")]),
    ("quartic_inner", "(Ax+a)'(Bx+b)(Cx+c)'(Dx+d)", 4, (), [(f"A{i}", f"B{i}", f"C{j}", f"D{j}") for i in (0, 1) for j in (0, 1)]),
]:
    register(f"integrate_{_name}_2", lambda s, d, e=_expr, n=_n, ix=_ix: (unnormalised(s, d), [at(G.integrate(e, *_two(n)), *ix)]), ["value"], ["2 * (" + " + ".join(_isserlis(t) for t in _terms) + ")"])

# models by moment matching: joints, conditionals and points
_KA = ([_KN], [[0.5, -0.25, 2.0]], [0.1], [[0.3]])
_ks = f"(0.3 + 0.25 * s11 - 0.25 * s12 + 0.0625 * s22 + 4 * (0.5 * {_KC[0]} - 0.25 * {_KC[1]}) + 4 * (kb - ka * ka))"
_kc = (f"(0.5 * s11 - 0.25 * s12 + 2 * {_KC[0]})", f"(0.5 * s12 - 0.25 * s22 + 2 * {_KC[1]})")
register("kernel_joint", lambda s, d: (K.joint(groups(s, d), *_KA), [col("mu", 2), col("Sigma", 0, 2), col("Sigma", 2, 1), col("Sigma", 2, 2)]), ["mu", "c1", "c2", "v"], ["0.5 * m1 - 0.25 * m2 + 2 * ka + 0.1", *_kc, _ks], "q", _KB)
register("kernel_conditional", lambda s, d: (K.conditional(groups(s, d), *_KA), [col("M", 0, 0), col("Sigma", 0, 1)]), ["g", "s"], [f"{_kc[0]} / {_ks}", f"s12 - {_kc[0]} * {_kc[1]} / {_ks}"], "q", _KB)
_PX = "(SELECT p_partkey AS n, p_size / 10.0::DOUBLE AS x1, CAST(p_retailprice AS DOUBLE) / 1000 AS x2 FROM part)"
_points = lambda s, d: _all_points(s, d).select(F.col("p_partkey").alias("n"), "x")
register("kernel_condition_on_x", lambda s, d: (K.condition_on_x(_points(s, d), *_KA), [col("mu", 0)]), ["mu"], ["0.5 * x1 - 0.25 * x2 + 2 * exp(-((x1 - 2.0) * (x1 - 2.0) / 2.25 + (x2 - 0.4) * (x2 - 0.4) / 0.49) / 2) + 0.1"], _PX, "", ("n",))
_HA = ("exp", [[0.5, -0.25]], [0.1], [[0.3]], [[0.8]], [[0.3, -0.2]], [0.1])
_hs, _hc = f"({_HB}exp({_HM} + {_HV} / 2))", ("(0.5 * s11 - 0.25 * s12)", "(0.5 * s12 - 0.25 * s22)")
register("hetero_joint", lambda s, d: (H.joint(groups(s, d), *_HA), [col("Sigma", 0, 2), col("Sigma", 2, 1), col("Sigma", 2, 2)]), ["c1", "c2", "v"], [*_hc, _hs])
register("hetero_conditional", lambda s, d: (H.conditional(groups(s, d), *_HA), [col("M", 1, 0), col("Sigma", 0, 0)]), ["g", "s"], [f"{_hc[1]} / {_hs}", f"s11 - {_hc[0]} * {_hc[0]} / {_hs}"])
for _link, _e in (("exp", "exp(h)"), ("cosh_minus_one", "(exp(h) + exp(-h)) / 2 - 1"), ("heaviside", "CASE WHEN h >= 0 THEN 1 ELSE 0 END"), ("relu", "greatest(h, 0)")):
    register(f"hetero_{_link}_condition_on_x", lambda s, d, k=_link: (H.condition_on_x(_points(s, d), k, *_HA[1:]), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], ["0.5 * x1 - 0.25 * x2 + 0.1", f"0.3 + 0.64 * ({_e})"], f"(SELECT *, 0.3 * x1 - 0.2 * x2 + 0.1 AS h FROM {_PX})", "", ("n",))

# kernel models: expected logs, ridges, bounds of models whose noise depends on x
register("kernel_log_conditional_y", lambda s, d: (K.log_conditional_y(groups(s, d), *_KA, L.vec(1.0)), [F.col("value")]), ["value"], [f"-((power(0.9 - 0.5 * m1 + 0.25 * m2 - 2 * ka, 2) + {_ks} - 0.3) / 0.3 + {LP} + ln(0.3)) / 2"], "q", _KB)
_K1 = BASE + ", q AS (SELECT *, 0.7 / sqrt(s22 + 0.49) * exp(-(0.4 - m2) * (0.4 - m2) / (s22 + 0.49) / 2) AS e, (0.4 - m2) / (s22 + 0.49) AS g, sqrt(0.245 / (s22 + 0.245)) * exp(-(0.4 - m2) * (0.4 - m2) / (s22 + 0.245) / 2) AS e2 FROM h)\n"
register(
    "kernel_log_conditional",
    lambda s, d: (K.log_conditional(groups(s, d), [K.Radial([0.4], [0.7])], [[0.5, 2.0]], [0.1], [[0.3]]), [F.col("value")]),
    ["value"],
    [f"-((power(m1 - 0.5 * m2 - 2 * e - 0.1, 2) + s11 - 2 * (0.5 * s12 + 2 * e * s12 * g) + 0.25 * s22 + 2 * e * s22 * g + 4 * (e2 - e * e)) / 0.3 + {LP} + ln(0.3)) / 2"],
    "q",
    _K1,
)
_RA = ([K.Ridge([0.3, -0.2], 0.1)], [[0.5, -0.25, 2.0]], [0.1], [[0.3]])
_RB = BASE + f", q0 AS (SELECT *, {_HM} AS m, {_HV} AS v FROM h), q1 AS (SELECT *, exp(-m * m / (1 + v) / 2) / sqrt(1 + v) AS e, exp(-m * m / (1 + 2 * v)) / sqrt(1 + 2 * v) AS e2 FROM q0), q AS (SELECT *, -e * m / (1 + v) * (0.3 * s11 - 0.2 * s12) AS g1, -e * m / (1 + v) * (0.3 * s12 - 0.2 * s22) AS g2 FROM q1)\n"
_rs = "(0.25 * s11 - 0.25 * s12 + 0.0625 * s22 + 4 * (0.5 * g1 - 0.25 * g2) + 4 * (e2 - e * e))"
register("ridge_marginal", lambda s, d: (K.marginal(groups(s, d), *_RA), [col("mu", 0), col("Sigma", 0, 0), col("cross", 0, 1)]), ["mu", "S", "c"], ["0.5 * m1 - 0.25 * m2 + 2 * e + 0.1", f"0.3 + {_rs}", "0.5 * s12 - 0.25 * s22 + 2 * g2"], "q", _RB)
register("ridge_log_conditional_y", lambda s, d: (K.log_conditional_y(groups(s, d), *_RA, L.vec(1.0)), [F.col("value")]), ["value"], [f"-((power(0.9 - 0.5 * m1 + 0.25 * m2 - 2 * e, 2) + {_rs}) / 0.3 + {LP} + ln(0.3)) / 2"], "q", _RB)
register("ridge_condition_on_x", lambda s, d: (K.condition_on_x(_points(s, d), *_RA), [col("mu", 0)]), ["mu"], ["0.5 * x1 - 0.25 * x2 + 2 * exp(-power(0.3 * x1 - 0.2 * x2 + 0.1, 2) / 2) + 0.1"], _PX, "", ("n",))
register("kernel_cross_terms", lambda s, d: (K.cross_terms(groups(s, d), K.marginal(groups(s, d), *_KA)), [col("value", 0, 0)]), ["value"], [f"{_kc[0]} + (0.5 * m1 - 0.25 * m2 + 2 * ka + 0.1) * m1"], "q", _KB)
_HL = ("exp", [[0.5, -0.25]], [0.1], [[0.64]], [[0.8]], [[0.3, -0.2]], [0.1])
_HQ = BASE + f""", q0 AS (SELECT *, {_HM} AS m, {_HV} AS v, 0.9 - 0.5 * m1 + 0.25 * m2 AS e, 0.25 * s11 - 0.25 * s12 + 0.0625 * s22 AS ev, -1.25 * (0.15 * s11 - 0.175 * s12 + 0.05 * s22) AS hu FROM h),
q1 AS (SELECT *, sqrt(m * m + v) AS w, hu / v AS beta, 1.25 * e - hu / v * m AS alpha, 1.5625 * ev - hu * hu / v AS rest FROM q0),
q2 AS (SELECT *, (1 - exp(-w)) / (1 + exp(-w)) / w / 2 AS g, w / 2 + ln(1 + exp(-w)) AS lw FROM q1),
q3 AS (SELECT *, (m + v / 2) / (1 + g * v) AS tm, v / (1 + g * v) AS tv, (m + v / 4 - g * m * m) / (1 + g * v) / 2 - ln(1 + g * v) / 2 - lw + g * w * w / 2 AS ln_mass FROM q2),
q AS (SELECT *, exp(ln_mass) * ((alpha + beta * tm) * (alpha + beta * tm) + beta * beta * tv + rest) AS term FROM q3)
"""
register("hetero_exp_log_conditional_y", lambda s, d: (H.log_conditional_y(groups(s, d), *_HL, L.vec(1.0), iterations=0), [F.col("value")]), ["value"], [f"-((e * e + ev) / 0.64 - term + ln(0.64) + m / 2 + lw + {LP}) / 2"], "q", _HQ)
for _link in ("cosh_minus_one", "heaviside", "relu"):
    # tested against sums: no SQL, as it lacks the normal distribution and the fixed point
    register(f"hetero_{_link}_log_conditional_y", lambda s, d, k=_link: (H.log_conditional_y(groups(s, d), k, *_HL[1:], L.vec(1.0)), [F.col("value")]), ["value"], ["0"])
    del ORACLES[f"hetero_{_link}_log_conditional_y"]
_control = lambda s: N.controlled(s.sql("SELECT r, array(CAST(r AS DOUBLE)) AS u FROM VALUES (1), (2) AS t(r)"), N.network([([[0.5], [0.0], [-0.1]], [0.0, 0.3, 0.2])]), 1, 2, 1, [[0.3]])
_NX = "(SELECT u.r, h.r AS x_r, h.* EXCLUDE (r) FROM (VALUES (1), (2)) AS u(r), h)"
register("control_affine_marginal", lambda s, d: (C.affine_marginal(_control(s), groups(s, d)), [col("mu", 0), col("Sigma", 0, 0)]), ["mu", "S"], ["0.5 * r * m1 + 0.3 * m2 + 0.2 - 0.1 * r", "0.3 + 0.25 * r * r * s11 + 0.3 * r * s12 + 0.09 * s22"], _NX, BASE, ("r", "x_r"))
register("control_log_conditional_y", lambda s, d: (C.log_conditional_y(_control(s), groups(s, d), L.vec(1.0)), [F.col("value")]), ["value"], [f"-((power(0.8 + 0.1 * r - 0.5 * r * m1 - 0.3 * m2, 2) + 0.25 * r * r * s11 + 0.3 * r * s12 + 0.09 * s22) / 0.3 + {LP} + ln(0.3)) / 2"], _NX, BASE, ("r", "x_r"))
register("gauss_fit_embeddings", lambda s, d: (fit_wide(_read(s, d, "embeddings"), "label", "embedding", 64, 0.01).withColumn("i", W.inverse(F.col("Sigma"))), [F.col("n"), col("mu", 63), col("Sigma", 0, 1), col("Sigma", 63, 63), F.col("i.valid").cast("int")]), ["n", "mu", "s01", "s63", "ok"], ["count(*)", "avg(embedding[64]::DOUBLE)", "covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE)", "var_pop(embedding[64]::DOUBLE) + 0.01", "1"], "embeddings GROUP BY label", "", ("r",))
ORACLES["gauss_fit_embeddings"] = ORACLES["gauss_fit_embeddings"].replace("SELECT r,", "SELECT label AS r,")
