"""Kernel models, bounds, control, the minimiser, wide matrices, tables of objects and streams against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaussframe.functions import linalg as L
from gaussframe.functions import wide
from gaussframe.functions.minimize import minimize
from gaussframe.operators import control as N
from gaussframe.operators import gaussian as G
from gaussframe.operators import heteroscedastic as H
from gaussframe.operators import kernels as K
from gaussframe.sources import objects
from gaussframe.sources.wide import fit_wide
from gaussframe.streaming.kalman import kalman_stream

MU, S = np.array([0.3, -0.4]), np.array([[0.8, 0.3], [0.3, 0.6]])


def densities(spark):
    return G.density(spark.createDataFrame([("a", MU.tolist(), S.tolist())], "r string, mu array<double>, Sigma array<array<double>>"))


def grid(steps=401, width=7.0):
    """Points and weights of N(MU, S)."""
    z = np.linspace(-width, width, steps)
    a, b = np.meshgrid(z, z)
    w = np.exp(-(a * a + b * b) / 2).ravel()
    return np.stack([a.ravel(), b.ravel()], 1) @ np.linalg.cholesky(S).T + MU, w / w.sum()


@pytest.mark.parametrize("kernels", [[K.Radial([0.5, 0.1], [0.9, -1.2]), K.Radial([-1.0, 0.4], [0.7, 0.8])], [K.Ridge([0.6, -0.5], 0.2), K.Ridge([0.3, 0.9], -0.4)]])
def test_kernel_models_against_sums(spark, kernels):
    m, b, s = [[0.5, -0.25, 1.5, -0.7], [0.1, 0.3, 0.4, 1.1]], [0.1, -0.2], [[0.5, 0.1], [0.1, 0.4]]
    x, w = grid()
    phi = np.array([[*p, *k] for p, k in zip(x, np.stack([np.exp(-((x @ np.array(k.weights) + k.offset) ** 2) / 2) if isinstance(k, K.Ridge) else np.exp(-((((x - k.centre) / k.length) ** 2).sum(1)) / 2) for k in kernels], 1), strict=True)])
    mean = phi @ np.array(m).T + b
    mu = w @ mean
    cov = ((mean - mu) * w[:, None]).T @ (mean - mu) + s
    cross = ((mean - mu) * w[:, None]).T @ (x - MU)
    got = K.marginal(densities(spark), kernels, m, b, s).first()
    assert np.allclose(got.mu, mu, atol=1e-6) and np.allclose(got.Sigma, cov, atol=1e-6) and np.allclose(got.cross, cross, atol=1e-6)
    y, lam = np.array([0.7, 0.2]), np.linalg.inv(s)
    e = y - mean
    want = -(w @ np.einsum("ni,ij,nj->n", e, lam, e) + 2 * np.log(2 * np.pi) + np.linalg.slogdet(s)[1]) / 2
    assert np.isclose(K.log_conditional_y(densities(spark), kernels, m, b, s, L.vec(*y)).first().value, want, atol=1e-6)
    # over a joint in which y = Gx + d + noise
    g, d, q = np.array([[0.4, -0.3], [0.2, 0.9]]), np.array([0.5, 0.1]), np.array([[0.3, 0.1], [0.1, 0.2]])
    joint = np.block([[g @ S @ g.T + q, g @ S], [S @ g.T, S]])
    df = spark.createDataFrame([("a", [*(g @ MU + d).tolist(), *MU.tolist()], joint.tolist())], "r string, mu array<double>, Sigma array<array<double>>")
    e = x @ g.T + d - mean
    want = -(w @ np.einsum("ni,ij,nj->n", e, lam, e) + np.trace(lam @ q) + 2 * np.log(2 * np.pi) + np.linalg.slogdet(s)[1]) / 2
    assert np.isclose(K.log_conditional(df, kernels, m, b, s).first().value, want, atol=1e-6)


def test_kernel_kinds_from_a_table(spark):
    df = spark.createDataFrame([(1, "ridge", None, None, [1.0, 2.0], 0.5)], "k long, kind string, centre array<double>, length_scale array<double>, w array<double>, w0 double")
    assert K.from_table(df) == [K.Ridge([1.0, 2.0], 0.5)] and K.from_table(df.limit(0)) == []
    with pytest.raises(TypeError):
        K.with_kernels(densities(spark), [K.Ridge([1.0, 2.0], 0.5), K.Radial([0.0, 0.0], [1.0, 1.0])])
    for model, error in ((K, NotImplementedError), (H, AttributeError)):
        with pytest.raises(error):
            model.set_y()


@pytest.mark.parametrize("link", ["exp", "cosh_minus_one", "heaviside", "relu"])
def test_bounds_against_sums(spark, link):
    a = np.array([[0.8, 0.2], [-0.3, 0.9]])
    s, m, b, w, c = a @ a.T, np.array([[0.5, -0.25], [0.3, 0.7]]), np.array([0.1, -0.2]), [[0.3, -0.5], [0.6, 0.2]], [0.1, -0.3]
    f = {"exp": np.exp, "cosh_minus_one": lambda h: np.cosh(h) - 1, "heaviside": lambda h: 1.0 * (h >= 0), "relu": lambda h: np.maximum(h, 0)}[link]
    x, weight = grid()
    y = np.array([1.2, 0.4])
    noise = s + np.einsum("nk,ik,jk->nij", f(x @ np.array(w).T + c), a, a)
    e = y - x @ m.T - b
    want = -weight @ (np.einsum("ni,nij,nj->n", e, np.linalg.inv(noise), e) + np.linalg.slogdet(noise)[1] + 2 * np.log(2 * np.pi)) / 2
    model = (link, m.tolist(), b.tolist(), s.tolist(), a.T.tolist(), w, c, L.vec(*y))
    first, best = (H.log_conditional_y(densities(spark), *model, iterations=n).first().value for n in (0, 100))
    if link == "heaviside":
        assert np.isclose(first, want, atol=5e-3) and first == best
    else:
        assert want - 0.15 < first <= best + 1e-9 and best <= want + 1e-6
    with pytest.raises(KeyError):
        H.log_conditional_y(densities(spark), "other", *model[1:])


def test_control(spark):
    layers = [([[0.5, -0.2], [0.1, 0.3]], [0.1, 0.2]), (np.arange(12).reshape(6, 2) / 10, np.arange(6) / 5)]
    u = np.array([[0.4, -1.0], [2.0, 0.3]])
    df = spark.createDataFrame([(1, u[0].tolist()), (2, None), (3, u[1].tolist())], "r long, u array<double>")
    got = {r.r: r for r in N.controlled(df, N.network(layers), 2, 2, 2, [[1.0, 0.2], [0.2, 0.5]]).collect()}
    want = np.tanh(u @ np.array(layers[0][0]).T + layers[0][1]) @ layers[1][0].T + layers[1][1]
    for key, row in ((1, want[0]), (3, want[1])):
        assert np.allclose(got[key].M, row[:4].reshape(2, 2)) and np.allclose(got[key].b, row[4:])
    assert got[2].M is None and got[2].b is None
    with pytest.raises(ValueError, match="must give"):
        N.controlled(df, N.network(layers), 2, 3, 2, [[1.0, 0.2], [0.2, 0.5]])


def test_minimize_fits_a_gaussian_by_aggregation(spark):
    x = np.random.default_rng(0).normal(1.5, 2.0, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).cache()

    def loss(p):
        m, ls = float(p["m"]), float(p["ls"])
        z = (F.col("x") - m) * np.exp(-ls)
        row = df.agg(F.avg(z * z / 2).alias("q"), F.avg(z).alias("z")).first()
        return row.q + ls, {"m": -row.z * np.exp(-ls), "ls": 1 - 2 * row.q}

    got = minimize(loss, {"m": np.array(0.0), "ls": np.array(0.0)})
    assert got.converged and np.isclose(got.x["m"], x.mean(), atol=1e-4) and np.isclose(np.exp(got.x["ls"]), x.std(), atol=1e-4)
    bowl = minimize(lambda p: (float(np.sum((p["x"] - 3) ** 4)), {"x": 4 * (p["x"] - 3) ** 3}), {"x": np.zeros((2, 2))})
    assert np.allclose(bowl.x["x"], 3, atol=0.05)


def test_wide_inverse(spark):
    rng = np.random.default_rng(1)
    big = rng.normal(size=(30, 30))
    big, small = big @ big.T + np.eye(30), np.array([[2.0, 0.5], [0.5, 1.0]])
    rows = [(1, big.tolist()), (2, None), (3, small.tolist()), (4, [[1.0, 2.0], [2.0, 1.0]])]
    got = {r.r: r.i for r in spark.createDataFrame(rows, "r long, a array<array<double>>").select("r", wide.inverse(F.col("a")).alias("i")).collect()}
    for key, m in ((1, big), (3, small)):
        assert got[key].valid and np.allclose(got[key].inv, np.linalg.inv(m)) and np.isclose(got[key].ln_det, np.linalg.slogdet(m)[1])
    assert got[2].inv is None and not got[2].valid and not got[4].valid and np.isnan(got[4].ln_det)


def test_wide_fit(spark):
    x = np.random.default_rng(2).normal(size=(60, 12))
    rows = [("a" if i % 3 else None, v.tolist()) for i, v in enumerate(x)] + [("a", None), ("a", [1.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(5)
    got = {r.r: r for r in fit_wide(df, "g", "v", 12, 0.5).collect()}
    for key, own in (("a", x[np.arange(60) % 3 != 0]), (None, x[::3])):
        assert got[key].n == len(own) and np.allclose(got[key].mu, own.mean(0)) and np.allclose(got[key].Sigma, np.cov(own.T, bias=True) + 0.5 * np.eye(12))
    assert fit_wide(df.limit(0), "g", "v", 12).count() == 0


def test_objects(spark, tmp_path):
    df = densities(spark)
    objects.save(df, "density", str(tmp_path / "d"))
    want = objects.to_dict(df, "density")
    assert objects.to_dict(objects.load(spark, "density", str(tmp_path / "d")), "density") == want == objects.to_dict(objects.from_dict(spark, want), "density")
    assert df.select(objects.label("density").alias("l")).first().l == "density a of 2x2"
    assert objects.from_dict(spark, {"mu": [[1.0], [2.0]]}).orderBy("r").collect()[1].r == 1


def test_default_forms(spark):
    got = G.moments(densities(spark)).select(G.integrate("(Ax+a)'(Bx+b)", G.Affine(), G.Affine()).alias("v"), G.integrate("log u(x)", F.col("Lambda"), F.col("nu"), F.col("ln_beta")).alias("l"), G.entropy().alias("e")).first()
    assert np.isclose(got.v, np.trace(S) + MU @ MU) and np.isclose(got.l, -got.e)


def test_kalman_stream(spark, tmp_path):
    a, q, c, s = np.array([[0.99, 0.1], [-0.1, 0.99]]), 0.01 * np.eye(2), np.eye(2), 0.1 * np.eye(2)
    rows = [(i % 2, i, np.random.default_rng(i).normal(size=2).tolist() if i != 4 else None) for i in range(12)]
    schema = "k long, t long, v array<double>"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = kalman_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", ["t"], "v", a, q, c, s)
    run = stream.writeStream.format("memory").queryName("filtered").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for r in spark.table("filtered").orderBy("n").collect():
        got[r.k] = r
    for key in (0, 1):
        m, p, ll, n = np.zeros(2), np.eye(2), 0.0, 0
        for _, _, x in (r for r in rows if r[0] == key and r[2] is not None):
            m, p = a @ m, a @ p @ a.T + q
            v, d = p + s, np.array(x) - m
            ll -= (2 * np.log(2 * np.pi) + np.log(np.linalg.det(v)) + d @ np.linalg.inv(v) @ d) / 2
            m, p, n = m + p @ np.linalg.inv(v) @ d, p - p @ np.linalg.inv(v) @ p, n + 1
        assert got[key].n == n and np.allclose(got[key].mean, m) and np.allclose(np.reshape(got[key].variance, (2, 2)), p) and np.isclose(got[key].log_likelihood, ll)
