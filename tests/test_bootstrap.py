"""Seeded draws, the bootstrap of ranks and the number of independent tests."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from quartzfolio import queries as q
from quartzfolio.functions import kernels as K
from quartzfolio.operators import metrics as M
from quartzfolio.plans import draws as D
from quartzfolio.plans import study as S


def plain(active, draws, seed=D.SEED):
    """Resamples of whole months; no ratio without variation; ratios that agree to ten
    digits tie, and the first column goes first."""
    t, n = active.shape
    pick = np.random.default_rng(seed).integers(0, t, size=(draws, t))
    ratio = lambda x: np.array([v.mean() / v.std(ddof=1) * math.sqrt(12) if v.std(ddof=1) > 1e-12 else np.nan for v in x.T])
    full, found = ratio(active), np.stack([ratio(active[p]) for p in pick])
    order = np.argsort(np.where(np.isnan(found), np.inf, -np.round(found, 10)), axis=1, kind="stable")
    rank = np.argsort(order, axis=1) + 1
    return {
        "leader": int(np.nanargmax(np.round(full, 10))), "first": ((rank == 1) & ~np.isnan(found)).mean(0), "median": np.median(rank, 0),
        "sign": (np.sign(found) == np.sign(full)).mean(0), "actual": full,
    }


def series(spark, active):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(len(active))]
    return spark.createDataFrame([(f"s{j}", m, float(active[i, j])) for i, m in enumerate(months) for j in range(active.shape[1])], "k string, traded date, active double")


def test_draws_are_the_generators(spark):
    got = D.resampled_months(spark, 23, 40).orderBy("draw", "pos").toPandas()
    assert (got.month_index.to_numpy().reshape(40, 23) == np.random.default_rng(D.SEED).integers(0, 23, size=(40, 23))).all()
    rng = np.random.default_rng(5)
    want = [[int(rng.integers(1, 60)) for _ in range(6)] for _ in range(50)]
    moved = D.shifts(spark, 60, 6, 50, seed=5).orderBy("draw", "ord").toPandas()
    assert moved["shift"].to_numpy().reshape(50, 6).tolist() == want


@pytest.mark.parametrize("bound, count, seed", [(19, 38_000, D.SEED), (59, 1200, D.SEED), (1, 5, 1), (7, 10, 2), (3_000_000_019, 4000, 3)])
def test_sql_draws_the_same(bound, count, seed):
    parts = D.pcg_sql("r", str(bound), str(count), seed)
    sql = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " SELECT v FROM r ORDER BY k"
    got = [r[0] for r in duckdb.sql(sql).fetchall()]
    assert got == np.random.default_rng(seed).integers(0, bound, size=count).tolist()


def test_retention_with_a_series_that_does_not_vary(spark):
    rng = np.random.default_rng(8)
    active = rng.normal(-0.01, 0.02, (37, 5))
    active[:, 2] = 0.0  # the benchmark itself: among losing series it must not lead
    active[:, 4] = active[:, 1]  # a twin: ties go to the first
    want = plain(active, 300)
    got = {r.k: r for r in M.retention(series(spark, active), "k", D.resampled_months(spark, 37, 300)).collect()}
    for j in range(5):
        r = got[f"s{j}"]
        assert math.isclose(r.first_share, want["first"][j]) and r.median_rank == want["median"][j] and math.isclose(r.own_sign, want["sign"][j]) and r.leads == (j == want["leader"])
        assert (r.actual is None and j == 2) or math.isclose(r.actual, want["actual"][j], rel_tol=1e-9)
    assert got["s2"].median_rank == 5 and got["s2"].own_sign == 0 and got["s2"].first_share == 0 and not got["s2"].leads


def test_number_of_independent_tests(spark):
    def effective(m):
        cells = [(f"c{i:02}", f"c{j:02}", float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
        return M.effective_tests(spark.createDataFrame(cells, "i string, j string, value double"), [K.family_wise_bar(k) for k in range(1, 17)]).first()

    rng = np.random.default_rng(2)
    for m in (np.eye(5), np.ones((2, 2)), np.ones((1, 1)), np.corrcoef(rng.normal(size=(40, 16)) + rng.normal(size=(40, 1)), rowvar=False)):
        n = len(m)
        want = max(1.0, 1 + (n - 1) * (1 - np.var(np.linalg.eigvalsh(m)) / n)) if n > 1 else 1.0
        r = effective(m)
        assert r.filled == n and math.isclose(r.effective, want, rel_tol=1e-12) and math.isclose(r.bar, K.family_wise_bar(n))
        assert math.isclose(r.adjusted_bar, K.family_wise_bar(max(1, round(want))))


def test_the_grids_rows_read_the_same_bootstrap(spark):
    """Retention columns of the study against plain numpy over the grid's own series."""
    d = "/root/testdata/sf0.001"
    rows = {r.run_id: r for r in q.study_rows(spark, d).collect()}
    wide = q._grid_series(spark, d)[1].toPandas().pivot(index="traded", columns="run_id", values="net").sort_index()
    bench = q._grid_series(spark, d)[1].where("run_id = 'policy'").toPandas().set_index("traded")["gross"]
    cells = [c for c in sorted(wide.columns) if c in S.CELLS]
    active = wide[cells].to_numpy(float) - bench.loc[wide.index].to_numpy(float)[:, None]
    want = plain(active, D.RESAMPLES)
    for j, c in enumerate(cells):
        assert math.isclose(rows[c].retention, want["sign"][j], abs_tol=2e-3) and abs(rows[c].median_rank - want["median"][j]) <= 0.5
        assert rows[c].leader == cells[want["leader"]] and math.isclose(rows[c].leader_retention, want["first"][want["leader"]], abs_tol=2e-3)
    assert rows["policy"].retention == 0 and rows["policy"].leader != "policy"
