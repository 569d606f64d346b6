"""Boundaries, refusals and hand values of the relational operators."""

import datetime as dt
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quartzfolio import queries as q
from quartzfolio.errors import DataStop, Refusal
from quartzfolio.operators import attribution as A
from quartzfolio.operators import calendar as C
from quartzfolio.operators import metrics as M
from quartzfolio.operators import quality as Q
from quartzfolio.operators import returns as R
from quartzfolio.plans import backtest as B
from quartzfolio.sources.scratch import scope
from quartzfolio.streaming.monthly import closed_months

D = "/root/testdata/sf0.01"


def months(n, start=(2020, 1)):
    return [dt.date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1) for i in range(n)]


def test_steps_end_before_the_traded_month(spark):
    m = spark.createDataFrame([(x,) for x in months(63)], "period_month date")
    rows = C.steps(m).collect()
    assert len(rows) == 3 and all(len(r.window) == 60 and r.window_end < r.traded for r in rows)
    grown = C.steps(m, "expanding").orderBy("traded").collect()
    assert [r.months for r in grown] == [60, 61, 62] and len({r.window_start for r in grown}) == 1
    with pytest.raises(Refusal):
        C.steps(m, "other")


def test_planted_look_ahead_is_found(spark):
    m = spark.createDataFrame([(x,) for x in months(62)], "period_month date")
    steps = C.steps(m)
    read = C.blocks(m.withColumn("x", C.F.lit(1.0)), steps)
    assert C.look_ahead(steps, read, m).collect() == []
    late = read.withColumn("period_month", C.F.add_months("period_month", 1))
    assert {r.rule for r in C.look_ahead(steps, late, m).collect()} == {"row at or after the traded month"}
    hole = read.where("period_month <> date'2021-05-01'")
    assert {r.rule for r in C.look_ahead(steps, hole, m).collect()} == {"too few observations"}


def test_as_of_keeps_the_wall_clock_and_is_pushed_down(spark, tmp_path):
    assert C.cutoff("2020-03-01T00:30:00+05:00") == dt.date(2020, 3, 1)
    rows = spark.createDataFrame([(x,) for x in months(6)], "period_month date")
    rows.write.parquet(f"{tmp_path}/m")
    got = C.as_of(spark.read.parquet(f"{tmp_path}/m"), "2020-03-31")
    assert [r[0].month for r in got.orderBy("period_month").collect()] == [1, 2]
    assert "LessThan(period_month" in got._jdf.queryExecution().toString()


def planted(spark, change=None):
    rows = [[i, x, p, p, d, "EUR"] for i, p, d in (("AAA", 100.0, 0.25), ("BBB", 50.0, 0.0)) for x in months(6)]
    if change:
        change(rows)
    return C.add_availability(spark.createDataFrame([tuple(r) for r in rows], "instrument string, period_month date, close double, adj_close double, dividend double, currency string"))


FACTS = [("AAA", "Distributing (quarterly)", "EUR 0.80bn"), ("BBB", "Accumulating", "EUR 4.00bn")]


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda r: r.pop(2), "missing bar"),
        (lambda r: r.append(list(r[0])), "missing bar"),
        (lambda r: [x.__setitem__(4, 0.0) for x in r], "distributing line with no distribution"),
        (lambda r: r[3].__setitem__(3, -1.0), "implausible level"),
        (lambda r: r[3].__setitem__(3, 200.0), "implausible move"),
        (lambda r: [r.pop(0) for _ in range(2)], "line starting late"),
        (lambda r: r.append(["AAA", dt.date(2020, 7, 1), 100.0, 100.0, 0.25, "EUR"]), "too-fresh bar"),
        (lambda r: [x.__setitem__(0, "CCC") for x in r[6:]], "issuer facts missing"),
    ],
)
def test_every_stop_fires_on_its_plant(spark, change, rule):
    facts = spark.createDataFrame(FACTS, "instrument string, income string, size string")
    gate = lambda p: Q.violations(p, facts, "2020-01-01", "2020-07-01")
    assert gate(planted(spark)).collect() == []
    found = gate(planted(spark, change))
    assert rule in {r.rule for r in found.collect()}
    with pytest.raises(DataStop):
        Q.run_gate(found)


def test_sizes_and_policies(spark):
    rows = spark.createDataFrame([("EUR 1.30bn", 1.0), ("SEK 17,092m", 0.09), ("n/a", 1.0), ("USD 5k", None)], "s string, r double")
    got = [r[0] for r in rows.select(Q.fund_size_eur(C.F.col("s"), C.F.col("r"))).collect()]
    assert math.isclose(got[0], 1.3e9) and math.isclose(got[1], 17092e6 * 0.09) and got[2] is None and got[3] is None


def test_hand_values(spark):
    rows = spark.createDataFrame([("a", x, v, v) for x, v in zip(months(3), [0.10, -0.20, 0.05])], "run_id string, traded date, net double, active double")
    assert math.isclose(M.drawdown(rows, "run_id").first().drawdown, -0.20)
    one = spark.createDataFrame([(0.05,)], "t double")
    assert math.isclose(one.select(M.cost(C.F.col("t"))).first()[0], 1e-4)
    flat = spark.createDataFrame([("a", 0.0), ("a", 0.0)], "k string, active double")
    assert flat.groupBy("k").agg(M.ratio("active").alias("x")).first().x == 0.0


def test_linking_leaves_nothing(spark):
    lines = [("r", x, 0.01, 0.002, -0.001, p, b) for x, p, b in zip(months(3), [0.05, -0.02, 0.03], [0.039, -0.031, 0.019])]
    df = spark.createDataFrame(lines, "run_id string, period_month date, allocation double, currency double, interaction double, portfolio double, benchmark double")
    out = A.linking(df).first()
    assert abs(out.residual_carino) < 1e-12 and abs(out.residual_menchero) < 1e-12


def test_duplicate_cells_and_missing_rates_raise(spark):
    rows = spark.createDataFrame([(x, "A", 1.0) for x in months(2)] + [(months(1)[0], "A", 2.0)], "period_month date, instrument string, v double")
    with pytest.raises(Exception, match="two values"):
        R.wide(rows, ["A"], "v").collect()
    f = spark.createDataFrame([("f", x, 0.01) for x in months(3)], "factor string, period_month date, ret double")
    fx = spark.createDataFrame([("SEK", x, 10.0) for x in months(2)], "currency string, period_month date, close double")
    with pytest.raises(Exception, match="no exchange rate"):
        R.eur_translate(f, fx).collect()


def test_registry(spark):
    B.validate()
    with pytest.raises(Refusal):
        B.validate(B.RUNS[:-1])


def test_grid_rules(spark):
    found = q.grid_books(spark, D).toPandas()
    for _, month in found.groupby(["run_id", "traded"]):
        assert abs(month.book.sum() - 1) < 1e-9 and month.book.min() > -1e-12
        assert month.book.max() <= month["cap"].iloc[0] + 1e-9 and month.turnover.iloc[0] <= 0.05 + 1e-12
    assert found.run_id.nunique() + q.grid_cuts(spark, D).count() == 20


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 5), "a", 1.0), (dt.datetime(2020, 1, 7), "a", 2.0), (dt.datetime(2020, 2, 1), "a", 4.0)], "ts timestamp, k string, v double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = closed_months(stream, "ts", "k", "v").writeStream.format("memory").queryName("closed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.period_month, r.day): r.total for r in spark.sql("select * from closed").collect()}
    want = {(r.period_month, r.day): r.total for r in closed_months(rows, "ts", "k", "v").collect()}
    assert got == want and len(got) == 3


def rows_of(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].dt.date
    show = lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def shared():
    """One scope for all comparisons: the tables that queries have in common are written once."""
    with scope():
        yield


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, shared, name):
    db = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows_of(q.QUERIES[name](spark, D).toPandas()) == rows_of(db.execute(q.ORACLE_SQL[name]).fetchdf())
