"""Column algebra against numpy and the plain kernels."""

import math

import numpy as np
import plain_math
import pytest
from pyspark.sql import functions as F

from quartzfolio.functions import arrays as L
from quartzfolio.functions import kernels as K


def matrices(n, count=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 3 * n, n))
    return [a.T @ a for a in x]


def frame(spark, found):
    return spark.createDataFrame([(i, m.tolist(), m[0].tolist()) for i, m in enumerate(found)], "i int, m array<array<double>>, v array<double>")


@pytest.mark.parametrize("n", [1, 2, 6])
def test_inverse_and_solution(spark, n):
    found = matrices(n)
    for r in frame(spark, found).select("i", L.inverse(F.col("m"), n).alias("x"), L.solve(F.col("m"), F.col("v"), n).alias("s"), L.times(F.col("m"), F.col("v")).alias("p")).collect():
        m = found[r.i]
        assert np.allclose(r.x, np.linalg.inv(m), atol=1e-10) and np.allclose(r.s, np.linalg.solve(m, m[0]), atol=1e-10) and np.allclose(r.p, m @ m[0])


def test_a_singular_matrix_has_no_inverse(spark):
    (r,) = frame(spark, [np.zeros((2, 2))]).select(L.inverse(F.col("m"), 2).alias("x")).collect()
    assert all(v is None for row in r.x for v in row)


@pytest.mark.parametrize("n", [2, 3, 6, 11])
def test_eigenvalues_and_vectors(spark, n):
    found = [np.corrcoef(np.random.default_rng(s).normal(size=(40, n)), rowvar=False) for s in range(6)] + [np.eye(n), np.diag(np.arange(n, 0, -1.0)), np.ones((n, n))]
    for r in frame(spark, found).select("i", L.eigen(F.col("m"), n).alias("e")).collect():
        values, vectors = np.array([x.value for x in r.e]), np.array([x.vector for x in r.e])
        assert np.allclose(values, K.eigen(found[r.i])[0], atol=1e-12)
        assert np.allclose(vectors.T * values @ vectors, found[r.i], atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
        if r.i < 6 and n > 2:  # the largest numbers of two series tie
            assert np.allclose(vectors.T, K.eigen(found[r.i])[1], atol=1e-9)


def test_projection(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0.2, 0.4, 6).tolist(), c) for c in (0.2, 0.35, 1.0) for _ in range(40)] + [([0.0] * 6, 0.35), ([1.0] + [0.0] * 5, 0.35), ([1.0] * 6, 1 / 6)]
    df = spark.createDataFrame(rows, "v array<double>, cap double")
    for r in df.select("v", "cap", L.capped_simplex(F.col("v"), F.col("cap")).alias("w")).collect():
        assert np.allclose(r.w, K.bounded_simplex(np.array(r.v), r.cap), atol=1e-12)


def test_an_impossible_cap_raises(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0.4)], "v array<double>, cap double")
    with pytest.raises(Exception, match="full investment"):
        df.select(L.capped_simplex(F.col("v"), F.col("cap"))).collect()


def test_f_tail(spark):
    rows = [(x, a, b) for x in (0.0, 0.01, 0.5, 1.0, 3.0, 12.0) for a in (1, 2, 5, 9) for b in (1, 2, 24, 53, 400)]
    df = spark.createDataFrame(rows, "x double, a int, b int")
    for r in df.select("x", "a", "b", L.f_survival(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect():
        assert math.isclose(r.p, plain_math.f_survival(r.x, r.a, r.b), rel_tol=1e-10, abs_tol=1e-14)


def test_gamma_of_halves(spark):
    for r in spark.range(1, 60).select(F.col("id").cast("int").alias("n")).select("n", L.log_gamma_half(F.col("n")).alias("g")).collect():
        assert math.isclose(r.g, math.lgamma(r.n / 2), abs_tol=1e-11)
