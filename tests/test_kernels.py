import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzfolio.functions import kernels as k

RNG = np.random.default_rng(3)
X = RNG.standard_normal((60, 6)) @ RNG.standard_normal((6, 6)) * 0.02 + 0.003
COV = np.cov(X, rowvar=False)
MEAN, POLICY = X.mean(0), np.array([0.3, 0.2, 0.2, 0.1, 0.1, 0.1])


def test_stated_values():
    assert np.allclose(k.bounded_simplex(np.array([0.9, 0.05, 0.05]), 0.5), [0.5, 0.25, 0.25])
    assert math.isclose(k.family_wise_bar(16), 2.9552, abs_tol=1e-4)
    losses = np.r_[np.full(99, 0.0), -0.2]
    assert math.isclose(k.expected_shortfall(losses, 0.05), 0.04)


def feasible(w, cap):
    return abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-12 and w.max() <= cap + 1e-9


@pytest.mark.parametrize("cap", [0.35, 1.0])
@pytest.mark.parametrize("name", list(k.FAMILIES))
def test_families_are_feasible(name, cap):
    w = k.FAMILIES[name](COV, MEAN, X, cap, POLICY)
    assert feasible(w, cap)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.25, 0.35, 0.6, 1.0]))
def test_quadratic_meets_the_kkt_conditions(seed, cap):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 12))
    a = rng.standard_normal((n + 5, n))
    q, c = a.T @ a, rng.standard_normal(n) * rng.choice([0, 1, 10])
    w = k.quadratic(q, c, cap)
    assert feasible(w, cap)
    g = (q @ w - c) / max(np.abs(q).max(), np.abs(c).max())
    free = (w > 1e-8) & (w < cap - 1e-8)
    top, bottom = g[w > 1e-8], g[w < cap - 1e-8]
    assert not len(bottom) or top.max() <= bottom.min() + 1e-6
    assert not free.any() or np.ptp(g[free]) < 1e-6


def test_closed_forms():
    d = np.diag([0.01, 0.04, 0.09])
    assert np.allclose(k.minimum_variance(d, None, None, 1.0, None), (1 / np.diag(d)) / (1 / np.diag(d)).sum(), atol=1e-8)
    inv = 1 / np.sqrt(np.diag(d))
    assert np.allclose(k.maximum_diversification(d, None, None, 1.0, None), inv / inv.sum(), atol=1e-8)
    assert np.allclose(k.erc(d, None, None, 1.0, None), inv / inv.sum(), atol=1e-8)
    rc = k.euler(k.erc(COV, None, None, 1.0, None), COV)["share"]
    assert np.allclose(rc, 1 / 6, atol=1e-8)
    assert np.allclose(k.mean_variance(COV, MEAN, X, 0.35, POLICY, norm=6**-0.5), 1 / 6)


def test_most_diversified_book_to_its_last_digits():
    """Without bounds that hold it is the normalised solution of cov w = sd."""
    rng, met = np.random.default_rng(7), 0
    for _ in range(40):
        x = (rng.standard_normal((60, 6)) + 0.3 * rng.standard_normal((60, 1))) * rng.uniform(0.01, 0.04, 6)
        cov = np.cov(x, rowvar=False)
        w = np.linalg.solve(cov, np.sqrt(np.diag(cov)))
        if w.min() > 0:
            met += 1
            assert np.allclose(k.maximum_diversification(cov, None, None, 1.0, None), w / w.sum(), rtol=0, atol=1e-10)
    assert met > 20


def test_most_diversified_book_under_a_cap_that_holds():
    """It has the largest ratio within the bounds; the optimum without the cap, brought back, has less."""
    rng, met = np.random.default_rng(11), 0
    for _ in range(30):
        x = (rng.standard_normal((60, 6)) + 0.3 * rng.standard_normal((60, 1))) * rng.uniform(0.005, 0.05, 6)
        cov = np.cov(x, rowvar=False)
        free = k.maximum_diversification(cov, None, None, 1.0, None)
        if free.max() > 0.36:
            met += 1
            w = k.maximum_diversification(cov, None, None, 0.35, None)
            ratio = k.diversification_ratio(w, cov)
            assert ratio > k.diversification_ratio(k.bounded_simplex(free, 0.35), cov)
            for v in rng.dirichlet(np.ones(6), 100):
                for share in (1e-3, 0.1, 1.0):
                    assert ratio >= k.diversification_ratio((1 - share) * w + share * k.bounded_simplex(v, 0.35), cov) - 1e-12
    assert met > 5


def test_cvar_beats_random_books():
    w = k.mean_cvar(COV, None, X, 0.35, None, level=0.1)
    cvar = k.expected_shortfall(X @ w, 0.1)
    for _ in range(300):
        v = k.bounded_simplex(RNG.dirichlet(np.ones(6)), 0.35)
        assert cvar <= k.expected_shortfall(X @ v, 0.1) + 1e-9


def test_means_and_varimax():
    cov = np.array([[0.04, 0.0], [0.0, 0.04]])
    p = k.posterior(np.array([0.02, 0.02]), cov, 1.0, np.array([0.04, 0.02]), cov)
    assert np.allclose(p, [0.03, 0.02])
    assert k.jorion(X, COV).shape == (6,)
    load = k.varimax(RNG.standard_normal((6, 3)))
    assert load.shape == (6, 3)
