import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaussframe.functions import linalg as L
from gaussframe.operators import conditional as C
from gaussframe.operators import gaussian as G
from gaussframe.plans.catalogue import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    a, b = QUERIES[name](spark, D).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all() if a[c].dtype == object else np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6)


def spd(n, seed):
    a = np.random.default_rng(seed).random((n, n))
    return a.T @ a + np.eye(n)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_inverse(spark, n):
    m = spd(n, n)
    row = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>").select(L.inverse(F.col("m")).alias("i")).first().i
    assert row.valid and np.allclose(row.inv, np.linalg.inv(m)) and np.isclose(row.ln_det, np.linalg.slogdet(m)[1])


def test_not_positive_definite_is_told(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [2.0, 1.0]],)], "m array<array<double>>")
    assert not df.select(L.inverse(F.col("m"))["valid"].alias("v")).first().v


def test_joint_splits_again(spark):
    cond = C.conditional(spark.createDataFrame([("c", [[0.5, -1.0]], [0.2], [[0.4]])], "r string, M array<array<double>>, b array<double>, Sigma array<array<double>>"))
    p = spark.createDataFrame([("x", [1.0, 2.0], spd(2, 3).tolist())], "r string, mu array<double>, Sigma array<array<double>>")
    joint = C.affine_joint(cond, p)
    back = G.condition_on(G.density(joint.select("r", "mu", "Sigma")), [0, 1], 3).first()
    assert np.allclose(back.M, [[0.5, -1.0]]) and np.allclose(back.b, [0.2]) and np.allclose(back.Sigma, [[0.4]])


def test_normal_cdf(spark):
    import math

    xs = [-9.0, -3.0, -0.5, 0.0, 1.0, 4.0, 9.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(L.normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-12)


def test_unknown_integral():
    with pytest.raises(KeyError):
        G.integrate("xxx")


@pytest.mark.parametrize("link", ["exp", "cosh_minus_one", "heaviside", "relu"])
def test_expected_links(spark, link):
    from gaussframe.operators.heteroscedastic import expected_link

    f = {"exp": np.exp, "cosh_minus_one": lambda h: np.cosh(h) - 1, "heaviside": lambda h: h >= 0, "relu": lambda h: np.maximum(h, 0)}[link]
    x = np.linspace(-12, 12, 400_001)
    for m, v in ((0.3, 0.5), (-1.0, 2.0)):
        want = np.sum(f(m + np.sqrt(v) * x) * np.exp(-x * x / 2)) * (x[1] - x[0]) / np.sqrt(2 * np.pi)
        got = spark.range(1).select(expected_link(link, F.lit(m), F.lit(v)).alias("e")).first().e
        assert np.isclose(got, want, atol=1e-4)


def test_normal_tails_keep_their_precision(spark):
    import math

    got = spark.range(1).select(L.normal_mass(F.lit(9.0), F.lit(10.0)).alias("a"), L.normal_mass(F.lit(-10.0), F.lit(-9.0)).alias("b"), L.normal_mass(F.lit(30.0), F.lit(float("inf"))).alias("c")).first()
    want = (math.erfc(9 / math.sqrt(2)) - math.erfc(10 / math.sqrt(2))) / 2
    assert np.isclose(got.a, want, rtol=1e-10, atol=0) and np.isclose(got.b, want, rtol=1e-10, atol=0) and np.isclose(got.c, math.erfc(30 / math.sqrt(2)) / 2, rtol=1e-10, atol=0)


@pytest.mark.parametrize(("lower", "upper"), [(-1.0, 2.0), (0.0, 1.0), (0.0, None), (8.0, 9.5)])
def test_truncated_against_sums(spark, lower, upper):
    mu, sd, z = 0.4, 0.9, 2.0
    x = np.linspace(lower, 15 if upper is None else upper, 400_001)
    w = z * np.exp(-(((x - mu) / sd) ** 2) / 2) / sd / np.sqrt(2 * np.pi) * (x[1] - x[0])
    w[[0, -1]] /= 2
    limits = (F.lit(mu), F.lit(sd), F.lit(lower).cast("double"), F.lit(upper).cast("double"))
    row = spark.range(1).select(*(C.integrate_truncated(e, F.lit(z), *limits) for e in ("1", "x", "x**2")), C.truncated_density(F.lit(lower + 0.5), *limits), C.truncated_density(F.lit(lower - 0.5), *limits)).first()
    density = z * np.exp(-(((lower + 0.5 - mu) / sd) ** 2) / 2) / sd / np.sqrt(2 * np.pi) / w.sum()
    assert np.allclose(row, [w.sum(), (w * x).sum(), (w * x * x).sum(), density, 0.0], rtol=1e-6, atol=0)


@pytest.mark.parametrize(("lower", "upper"), [(None, None), (2.0, 1.0)])
def test_truncated_needs_limits_in_order(spark, lower, upper):
    with pytest.raises(Exception, match="limit"):
        spark.range(1).select(C.integrate_truncated("1", F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(lower).cast("double"), F.lit(upper).cast("double"))).collect()
    with pytest.raises(KeyError):
        C.integrate_truncated("x**3", *[F.lit(0.0)] * 5)


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_samples_have_the_moments(spark, dims):
    m, mu = spd(dims, dims), np.arange(dims, dtype=float)
    df = spark.createDataFrame([("a", mu.tolist(), m.tolist())], "r string, mu array<double>, Sigma array<array<double>>")
    low = df.select(L.cholesky(F.col("Sigma")).alias("c")).first().c
    assert all(np.allclose(row, np.linalg.cholesky(m)[i, : i + 1]) for i, row in enumerate(low))
    x = np.array([r.x for r in G.sample(df, 20_000, dims, seed=3).collect()])
    assert x.shape == (20_000, dims) and np.allclose(x.mean(0), mu, atol=0.06) and np.allclose(np.cov(x.T), m, atol=0.15)
