"""Fits, components, covariances and spanning tests from sums of products, against numpy."""

import datetime as dt
import math

import numpy as np
import plain_math as K
import pytest
from pyspark.sql import functions as F

from quartzfolio.functions import arrays as L
from quartzfolio.plans import components as E
from quartzfolio.plans import draws as D
from quartzfolio.plans import factors as X

T, SIZE, SLEEVES, NAMES = 31, 24, ["a", "b", "c", "d", "e"], ["f", "g", "up", "down"]


@pytest.fixture(scope="module")
def panel(spark):
    """Factors f and g; up and down built from sleeves a and b, so both are determined."""
    rng = np.random.default_rng(11)
    f = rng.normal(0.004, 0.03, (T, 2))
    x = f @ rng.normal(0.5, 0.5, (2, 5)) + rng.normal(0.002, 0.02, (T, 5))
    block = np.column_stack([(x[:, 0] + x[:, 1]) / 2, x[:, 0] - x[:, 1]])
    months = [dt.date(2001 + i // 12, i % 12 + 1, 1) for i in range(T)]
    returns = spark.createDataFrame([(m, n, float(x[i, j])) for i, m in enumerate(months) for j, n in enumerate(SLEEVES)], "period_month date, instrument string, excess double")
    every = np.column_stack([f, block])
    factors = spark.createDataFrame([(n, m, float(every[i, j])) for i, m in enumerate(months) for j, n in enumerate(NAMES)], "factor string, period_month date, ret double")
    calendar = spark.createDataFrame([(m,) for m in months], "period_month date")
    rows = X.monthly(returns, factors, NAMES, SLEEVES).cache()
    return {"x": x, "f": every, "months": months, "calendar": calendar, "returns": returns, "rows": rows, "sums": X.moments(rows, calendar, 10, SIZE).cache()}


def window(panel, protocol, traded):
    end = panel["months"].index(traded)
    return slice(end - SIZE if protocol == "rolling" else 0, end)


def test_regressions(spark, panel):
    got = {}
    for r in X.rolling(panel["sums"], NAMES, SLEEVES, 2).collect():
        got[r.protocol, r.traded, r.instrument, r.quantity, r.factor] = r.value
    assert len({k[:2] for k in got}) == 2 * (T - SIZE)
    for protocol, traded in {k[:2] for k in got}:
        w = window(panel, protocol, traded)
        x, f = panel["x"][w], panel["f"][w]
        turned = np.column_stack([f[:, :2], f[:, 2:] @ K.orthogonal_map(f[:, 2:])])
        assert math.isclose(got[protocol, traded, None, "vif_declared", None], K.variance_inflation(f), rel_tol=1e-7)
        assert math.isclose(got[protocol, traded, None, "vif_orthogonal", None], K.variance_inflation(turned), rel_tol=1e-7)
        assert math.isclose(got[protocol, traded, None, "block_correlation", None], np.corrcoef(f[:, 2], f[:, 3])[0, 1], rel_tol=1e-7)
        for j, n in enumerate(SLEEVES):
            at = lambda q, name=None: got[protocol, traded, n, q, name]  # noqa: B023, E731
            want = K.regress(x[:, j], f[:, :2] if j < 2 else turned)
            for i, name in enumerate(NAMES[:2] if j < 2 else NAMES):
                assert math.isclose(at("beta", name), want["beta"][i], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(at("beta_t", name), want["beta_t"][i], rel_tol=1e-6, abs_tol=1e-8)
            if j < 2:
                assert at("r2") == 1 and at("resid_var") == 0 and math.isclose(at("spine_r2"), want["r2"], rel_tol=1e-7)
                assert math.isclose(at("beta", "up"), 1, rel_tol=1e-7) and math.isclose(at("beta", "down"), (0.5, -0.5)[j], rel_tol=1e-7)
                continue
            for q in ("alpha", "alpha_t", "resid_var", "explained_var", "r2"):
                assert math.isclose(at(q), want[q], rel_tol=1e-6, abs_tol=1e-10), q
            f_ = (want["r2"] / 4) / ((1 - want["r2"]) / want["dof"])
            assert math.isclose(at("f"), f_, rel_tol=1e-6)


def test_dependent_factors_and_holes_raise(spark, panel):
    twice = panel["rows"].withColumn("z", F.transform("z", lambda v, i: F.when(i == 2, F.get("z", F.lit(1))).otherwise(v)))
    with pytest.raises(Exception, match="dependent factors"):
        X.rolling(X.moments(twice, panel["calendar"], 10, SIZE), NAMES, SLEEVES).collect()
    holed = panel["rows"].where("period_month <> '2001-06-01'")
    with pytest.raises(Exception, match="a hole"):
        X.moments(holed, panel["calendar"], 10, SIZE).collect()
    loose = X.moments(holed, panel["calendar"], 10, SIZE, strict=False)
    refused = {r.traded for r in loose.where("protocol = 'rolling' and gram is null").collect()}
    assert refused == {m for m in panel["months"][SIZE:] if panel["months"].index(m) - SIZE < 5}  # a first month may be absent
    first = X.moments(panel["rows"].where("period_month <> '2001-01-01'"), panel["calendar"], 10, SIZE)
    assert first.where("n = 23").count() == 2 and first.count() == 2 * (T - SIZE)


def test_basis_of_the_traded_month(panel):
    got = X.design(panel["sums"], panel["rows"], NAMES, len(SLEEVES), 2).collect()
    for r in got:
        w = window(panel, r.protocol, r.traded)
        f, now = panel["f"][w], panel["f"][panel["months"].index(r.traded)]
        m = np.eye(4)
        m[2:, 2:] = K.orthogonal_map(f[:, 2:])
        assert math.isclose(r.value, (now @ m)[r.i], rel_tol=1e-7, abs_tol=1e-10)
        assert np.allclose(r.covariance, np.cov(f @ m, rowvar=False)[r.i], atol=1e-12)


@pytest.fixture(scope="module")
def own(panel):
    rows = X.monthly(panel["returns"], None, [], SLEEVES).cache()
    sums = X.moments(rows, panel["calendar"], 6, SIZE).cache()
    return rows, sums, E.structure(sums, 5).cache()


def test_components_and_their_null(panel, own):
    rows, sums, parts = own
    bars = E.null(rows, panel["calendar"], sums, 5, draws=40, size=SIZE).cache()
    got = {(r.traded, r.component): r for r in E.report(parts, bars, SLEEVES).collect()}
    for traded in panel["months"][SIZE:]:
        want = K.decompose(panel["x"][window(panel, "rolling", traded)], draws=40)
        for c in range(5):
            r = got[traded, c]
            assert math.isclose(r.eigenvalue, want["values"][c], rel_tol=1e-9) and math.isclose(r.bar, want["bar"][c], rel_tol=1e-9) and r.retained == want["count"]
            assert math.isclose(r.noise_share, want["noise_share"][c], rel_tol=1e-9)
            assert r.top.split(", ")[0] == SLEEVES[int(np.abs(want["vectors"][:, c]).argmax())]


def test_covariance_estimates(spark, panel):
    got = {(r.protocol, r.traded, r.estimator): r for r in E.window_estimates(panel["returns"], panel["calendar"], SLEEVES, SIZE).collect()}
    assert len(got) == 4 * (T - SIZE)
    for (protocol, traded, estimator), r in got.items():
        x = panel["x"][window(panel, protocol, traded)]
        want, report = {"sample": K.sample_covariance, "shrinkage": K.shrunk_covariance, "factor": K.factor_covariance}[estimator](x)
        assert np.allclose(np.array(r.cov), want, rtol=1e-8, atol=1e-14), estimator
        assert (report is None and r.report is None) or math.isclose(r.report, report, rel_tol=1e-8)
    condition = spark.createDataFrame([(np.diag([4.0, 2.0, 1.0]).tolist(),)], "m array<array<double>>").select(E.condition(F.col("m"), 3)).first()[0]
    assert math.isclose(condition, 4)


def test_a_missing_pair_is_refused(spark):
    rows = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.1), ("b", "b", 1.0)], "i string, j string, value double").withColumn("k", F.lit(1))
    with pytest.raises(Exception, match="lacks a pair"):
        E.matrices(rows, ["k"], ["a", "b"]).collect()


def test_spanning_both_ways(panel, own):
    _, sums, parts = own
    for k in (1, 2):
        rolling = sums.where("protocol = 'rolling'").drop("protocol")
        for r in E.spanning(rolling, parts.drop("n"), 5, k).collect():
            x = panel["x"][window(panel, "rolling", r.traded)]
            want = K.grs(x[:, : 5 - k], K.component_portfolios(x, k)[1])
            assert math.isclose(r.statistic, want["statistic"], rel_tol=1e-6) and math.isclose(r.p, want["p"], rel_tol=1e-6, abs_tol=1e-10)
    named = panel["sums"].where("protocol = 'rolling'").drop("protocol")
    for r in E.directions(named, parts.drop("n"), 4, 5, 1).where("direction = 'headline'").collect():
        w = window(panel, "rolling", r.traded)
        want = K.grs(K.component_portfolios(panel["x"][w], 1)[1], panel["f"][w])
        assert math.isclose(r.statistic, want["statistic"], rel_tol=1e-5) and math.isclose(r.p, want["p"], rel_tol=1e-5, abs_tol=1e-9)


def test_a_spanned_asset_is_refused(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(40, 2))
    z = np.column_stack([np.ones(40), f, f[:, 0] + 2 * f[:, 1]])
    df = spark.createDataFrame([((z.T @ z).tolist(),)], "g array<array<double>>")
    with pytest.raises(Exception, match="can't be inverted"):
        df.select(L.grs(F.col("g"), F.lit(40), 2, 1)).collect()


def test_two_pass_prices(panel):
    for r in X.two_pass(panel["sums"], NAMES, 2, 5).collect():
        w = window(panel, r.protocol, r.traded)
        want = K.fama_macbeth(panel["x"][w], panel["f"][w][:, :2])
        i = ["intercept", "f", "g"].index(r.factor)
        assert math.isclose(r.premium, want["premium"][i], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r.t, want["t"][i], rel_tol=1e-6) and r.dof == want["dof"]


def test_records_that_can_not_be_tested(spark):
    rng = np.random.default_rng(4)
    months = [dt.date(2001 + i // 12, i % 12 + 1, 1) for i in range(30)]
    f = rng.normal(0, 0.03, 30)
    y = 0.002 + 0.5 * f + rng.normal(0, 0.01, 30)
    rows = [("good", m, float(v)) for m, v in zip(months, y)] + [("flat", m, 0.01) for m in months] + [("short", m, float(v)) for m, v in zip(months[:8], y)]
    rows += [("gap", m, float(v) if i != 3 else None) for i, (m, v) in enumerate(zip(months, y))]
    factors = spark.createDataFrame([("mkt", m, float(v)) for m, v in zip(months, f)], "factor string, period_month date, ret double")
    got = {r.run_id: r for r in X.fund_example(spark.createDataFrame(rows, "run_id string, traded date, net double"), factors, ["mkt"], 2.9, 3.7, least=12).collect()}
    assert got["flat"].refused == "the record does not vary" and got["short"].refused.startswith("8 months") and "lacks a month" in got["gap"].refused
    want = K.regress(y, f[:, None])
    assert got["good"].refused is None and math.isclose(got["good"].alpha_monthly, want["alpha"], rel_tol=1e-7) and math.isclose(got["good"].t_alpha, want["alpha_t"], rel_tol=1e-7)
    assert math.isclose(got["good"].detectable_alpha_monthly, 3.7 * want["alpha_se"], rel_tol=1e-7)
    gone = X.fund_example(spark.createDataFrame(rows[:30], "run_id string, traded date, net double"), factors.where(F.col("period_month") != F.lit(months[4])), ["mkt"], 2.9, 3.7, least=12).first()
    assert gone.refused is None and gone.months == 30  # tested on the months both have
