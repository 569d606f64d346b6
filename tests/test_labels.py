"""Names that do not match are refused, and records carry what they rest on."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quartzfolio import queries as q
from quartzfolio.errors import DataStop, Refusal
from quartzfolio.operators import attribution as A
from quartzfolio.operators import calendar as C
from quartzfolio.operators import labels as N
from quartzfolio.operators import returns as R
from quartzfolio.operators import verdicts as V
from quartzfolio.plans import backtest as B
from quartzfolio.plans import factors as X
from quartzfolio.plans import study as S
from quartzfolio.sources import panel as P
from quartzfolio.sources import scratch
from quartzfolio.sources.sqlviews import Views

D = "/root/testdata/sf0.01"
COV = [("a", "a", 0.04), ("a", "b", 0.01), ("b", "a", 0.01), ("b", "b", 0.09)]


def book(spark, rows):
    return spark.createDataFrame([("r", n, w) for n, w in rows], "run_id string, instrument string, weight double")


def cov(spark, cells=COV):
    return spark.createDataFrame(cells, "i string, j string, value double")


@pytest.mark.parametrize(
    "weights, cells, said",
    [
        ([("a", 0.5), ("b", 0.3), ("c", 0.2)], COV, "does not cover every sleeve"),
        ([("a", 1.0)], COV, "lacks a sleeve"),
        ([("a", 0.5), ("a", 0.2), ("b", 0.3)], COV, "holds a sleeve twice"),
        ([("a", 0.5), ("b", 0.5)], COV[:3], "not one value for each pair|does not cover"),
        ([("a", 0.5), ("b", 0.5)], COV + COV[:1], "not one value for each pair"),
    ],
)
def test_books_and_covariances_must_match(spark, weights, cells, said):
    with pytest.raises(Exception, match=said):
        A.contributions(book(spark, weights), cov(spark, cells), ["run_id"]).collect()


def test_matching_books_pass(spark):
    rows = {r.instrument: r for r in A.contributions(book(spark, [("a", 0.6), ("b", 0.4)]), cov(spark), ["run_id"]).collect()}
    variance = 0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09
    assert math.isclose(rows["a"].volatility, math.sqrt(variance)) and math.isclose(sum(r.share for r in rows.values()), 1)
    one, two = dt.date(2000, 1, 1), dt.date(2000, 2, 1)
    dated = spark.createDataFrame([(one, *c) for c in COV], "traded date, i string, j string, value double")
    late = spark.createDataFrame([("r", m, n, w) for m in (one, two) for n, w in (("a", 0.6), ("b", 0.4))], "run_id string, traded date, instrument string, weight double")
    with pytest.raises(Exception, match="meets no covariance"):
        A.contributions(late, dated, ["run_id", "traded"]).collect()


def test_needed_names(spark):
    rows = book(spark, [("a", 1.0)])
    assert N.need(rows, ["a"]) is rows
    with pytest.raises(Refusal, match="no rows of b, c"):
        N.need(rows, ["a", "b", "c"])


def test_vectors_under_names(spark):
    df = spark.createDataFrame([([0.9, 0.05, 0.05], ["a", "b", "c"])], "v array<double>, n array<string>")
    got = df.select(N.labelled(F.col("v"), F.col("n"), F.lit(0.5)).alias("w")).first().w
    assert math.isclose(got["a"], 0.5) and math.isclose(got["b"], 0.25)
    for names, said in ((["a", "b"], "differ in number"), (["a", "b", "b"], "stands twice")):
        bad = spark.createDataFrame([([0.9, 0.05, 0.05], names)], "v array<double>, n array<string>")
        with pytest.raises(Exception, match=said):
            bad.select(N.labelled(F.col("v"), F.col("n"), F.lit(0.5))).collect()


def test_two_values_of_a_cell_and_a_missing_leg_raise(spark):
    m = dt.date(2001, 1, 1)
    rows = spark.createDataFrame([(m, "a", 0.1), (m, "a", 0.2), (m, "b", 0.3)], "period_month date, instrument string, excess double")
    with pytest.raises(Exception, match="two values of a"):
        X.monthly(rows, None, [], ["a", "b"]).collect()
    with pytest.raises(Exception, match="the block needs d in 2001-01-01"):
        R.constructed_block(rows.where("excess > 0.1"), "a", "b", "b", "d").collect()


def test_claims_carry_eight_numbers(spark):
    rows = spark.createDataFrame([("x", V.CANDIDATE, 4.0, 2.9, 0.5, 12, 48), ("y", V.NO_DIFFERENCE, 1.0, 2.9, 0.1, 3, 48)], "run_id string, verdict string, z double, bar double, information_ratio double, cap_binding_steps int, months int")
    got = {r.run_id: r.c for r in rows.select("run_id", V.claimed().alias("c")).collect()}
    assert got["y"] is None and got["x"].cap_binding_frequency == 0.25 and got["x"].steps == 48 and got["x"].statement == V.BAR_NOTE and len(got["x"]) == 8


def test_completed_records(spark):
    months = spark.createDataFrame([(dt.date(2000 + i // 12, i % 12 + 1, 1),) for i in range(63)], "period_month date")
    steps = C.steps(months)
    read = C.blocks(months.where("period_month > '2000-01-01'").withColumn("x", F.lit(1.0)), steps)
    kept = steps.select("protocol", "traded", F.lit(2).alias("retained"))
    got = C.observed(steps, read, kept).orderBy("traded").collect()
    assert [r.observations for r in got] == [59, 60, 60] and {r.components for r in got} == {2}
    assert {r.components for r in C.observed(steps, read).collect()} == {None}


def test_records_state_a_mean_made_of_views(spark):
    found = spark.createDataFrame([], B.TARGETS)
    got = {r.run_id: r.black_litterman for r in B.records(B.registry(spark), found, {"snapshot": "s"}).collect()}
    assert [k for k, v in got.items() if v is not None] == ["mean_variance_black_litterman"]
    assert math.isclose(got["mean_variance_black_litterman"].tau, 1 / 60) and list(got["mean_variance_black_litterman"].sensitivity_tau_scale) == [0.1, 1.0, 10.0]


def test_pairs_and_provenance(spark):
    m = [dt.date(2001, i, 1) for i in (1, 2, 3)]
    row = lambda run, k: [(run, x, 0.01 * i * k, 0.01 * i * k, 0.02 * k, None, 1, False, 4.0 * k, 4.0, 0.3 * k, 0.3) for i, x in enumerate(m)]
    series = spark.createDataFrame(row("erc_bounded", 1) + row("erc_unbounded", 2) + row("policy", 1), "run_id string, traded date, gross double, net double, turnover double, movement double, at_cap int, turnover_binding boolean, concentration double, concentration_traded double, largest double, largest_traded double")
    (r,) = S.cap_pairs(series).collect()
    assert (r.run_id, r.lifted) == ("erc_bounded", "erc_unbounded") and math.isclose(r.turnover_change, 0.24) and math.isclose(r.sleeves_change, 4) and math.isclose(r.largest_lifted, 0.6) and math.isclose(r.volatility_lifted, 2 * r.volatility)
    sheet = spark.createDataFrame([("policy", 19, 2.9552, 5.3, 2.5758), ("x_expanding", 19, 2.9552, 5.3, 2.5758)], "run_id string, months int, bar double, effective double, adjusted_bar double")
    got = {r.key: r.value for r in S.provenance(sheet, "2020-01-05").collect()}
    assert len(got) == 7 and got["runs"] == "2 runs of 1 cells" and got["bootstrap"].startswith("2000 resamples") and "2.9552" in got["bar"] and "5.3 effective" in got["bar"]


def test_one_statement_needs_its_legs(spark):
    p = P.load(spark, D)
    with pytest.raises(DataStop, match="leg_a, leg_b"):
        Views(prices=p.prices, fx=p.fx, cash=p.cash).statement("1998-01-01", "2000-12-15", "1995-06-01", "2000-12-01")
    with pytest.raises(DataStop, match="leg_a: day, pct"):
        Views(prices=p.prices, fx=p.fx, cash=p.cash, leg_a=p.months)


def test_ends_come_from_the_tables_and_facts_are_reduced_first(spark, tmp_path):
    line = spark.createDataFrame(
        [(1, 2.0, 20.0, 0.1, 0.02, "F", dt.datetime(2001, 3, d)) for d in (1, 15)] + [(2, 1.0, 30.0, 0.0, 0.04, "O", dt.datetime(2001, 4, 2)), (9, 1.0, 99.0, 0.0, 0.0, "O", dt.datetime(2001, 3, 7))],
        "l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz",
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "SMALL"), (2, "LARGE")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    (r,) = P.price_sums(spark, str(tmp_path)).collect()  # April has begun but not ended
    assert (r.instrument, r.period_month, r.level) == ("SMALL", dt.date(2001, 3, 1), 10.0) and math.isclose(r.cut, 0.1)
    assert {(r.leg, r.day.day) for r in P.rate_sums(spark, str(tmp_path)).collect()} == {("A", 1), ("A", 15), ("B", 7)}
    full = line.where("l_partkey = 1").withColumn("l_shipdate", F.lit("2001-03-31").cast("timestamp_ntz"))
    full.write.parquet(f"{tmp_path}/whole/lineitem.parquet")
    spark.createDataFrame([(1, "SMALL")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/whole/part.parquet")
    assert P.price_sums(spark, f"{tmp_path}/whole").count() == 1


def test_written_tables_can_be_discarded(spark):
    with scratch.scope():
        held = scratch.once(spark, ("x", "discard"), lambda: spark.range(3))
        assert held.count() == 3
    assert scratch.discard(spark) >= 1 and scratch.discard(spark) == 0
    assert q.QUERIES["measure"](spark, D).count() == 6


#: One plant for each rung: run, repeat, reproduces, z, retention, leader, ratio, sign, rung.
LADDER = [
    ("policy", False, False, 9.0, None, False, 0.5, None, V.IS_BENCHMARK), ("equal_weight", False, False, -9.0, None, False, -0.5, None, V.IS_EQUAL_WEIGHT), ("a_expanding", True, False, 4.0, None, False, 0.5, None, V.IS_EXPANDING),
    ("b", False, True, 4.0, 0.9, False, 0.5, None, V.REPRODUCES), ("c", False, False, 2.0, 0.9, False, 0.5, True, V.NO_DIFFERENCE), ("e", False, False, 4.0, 0.5, False, 0.5, True, V.RESAMPLING_LOST), ("f", False, False, 4.0, 0.9, True, 0.5, True, V.NOT_UNIQUE),
    ("g", False, False, -4.0, 0.9, False, -0.5, None, V.BEHIND), ("h", False, False, 4.0, 0.9, False, 0.5, None, V.LEG_NOT_RUN), ("i", False, False, 4.0, 0.9, False, 0.5, False, V.SIGN_LOST), ("j", False, False, 4.0, None, False, 0.5, True, V.CANDIDATE),
]


def test_every_rung(spark):
    rows = spark.createDataFrame([r[:-1] for r in LADDER], "run_id string, is_repeat boolean, reproduces boolean, z double, retention double, is_leader boolean, information_ratio double, expanding_sign boolean")
    rows = rows.withColumns({"bar": F.lit(2.9552), "leader_retention": F.lit(0.675)})
    assert {r.run_id: r.v for r in rows.select("run_id", V.verdict().alias("v")).collect()} == {r[0]: r[-1] for r in LADDER}


def test_groups_and_layers(spark, capsys):
    import quartzfolio
    from quartzfolio import facade

    assert list(facade.GROUPS)[0] == "contract" and len(quartzfolio.GROUPS) == 6 and set(facade.LAYERS) == set(facade.GROUPS)
    for name, modules in facade.GROUPS.items():
        assert len(vars(facade.group(name))) == len(modules)
    assert all(n in q.QUERIES for names in facade.LAYERS.values() for n in names)
    got = facade.main(spark, D, "risk_models")
    said = capsys.readouterr().out
    assert set(got) == {"covariance_estimators", "rolling_covariance"} and "[risk_models] rolling_covariance: 1368 rows of protocol" in said
    with pytest.raises(Refusal, match="no layer"):
        facade.main(spark, D, "other")
    with pytest.raises(Refusal, match="no group"):
        facade.group("other")
