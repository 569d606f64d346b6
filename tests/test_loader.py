"""A generated snapshot from files to the study, and the refusals on the way."""

import datetime as dt
import io
import random
import zipfile

import pytest

from quartzfolio.errors import DataStop, Refusal
from quartzfolio.operators import metrics as M
from quartzfolio.operators import returns as R
from quartzfolio.plans import analysis as Y
from quartzfolio.plans import backtest as B
from quartzfolio.plans import components as E
from quartzfolio.plans import factors as X
from quartzfolio.sources import loader as L
from quartzfolio.sources import snapshot as S
from quartzfolio.sources.sqlviews import Views, coverage_agreement

NAMES = ("AAA", "BBB", "CCC", "DDD")
FACTS = {"isin": "X", "ter": "0.1", "income_policy": "Accumulating", "replication": "full", "fund_size": "EUR 2.00bn", "currency": "EUR"}
START, END, SPLICE = "2014-01-01", "2019-12-01", "2019-10-01"


def months(n=72):
    return [dt.date(2014 + i // 12, i % 12 + 1, 1) for i in range(n)]


def archive(names, rng, hole=None):
    lines = ["created using the 202001 database", "", "," + ",".join(names)]
    lines += [f"{m:%Y%m}," + ",".join(f"{rng.gauss(0.4, 2):.2f}" for _ in names) for m in months() if m != hole]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", "\n".join(lines) + "\n\n Annual\n")
    return data.getvalue()


def daily(first, last, rng, mean, spread):
    out, day = ["KEY,TIME_PERIOD,OBS_VALUE"], first
    while day <= last:
        out.append(f"k,{day},{rng.gauss(mean, spread):.4f}")
        day += dt.timedelta(days=1)
    return "\n".join(out) + "\n"


def build(spark, home, drop=None):
    rng, files = random.Random(1), []
    home.mkdir(parents=True)
    base = {"source": "s", "url": "u", "retrieved": "2020-01-05"}
    for name in NAMES:
        level, rows = 100.0, ["date,close,adj_close,dividend"]
        for m in months():
            level *= 1 + rng.gauss(0.004, 0.03)
            if (name, m) != drop:
                rows.append(f"{m},{level:.6f},{level:.6f},0")
        (home / f"{name}.csv").write_text("\n".join(rows) + "\n")
        files.append(base | {"path": f"{name}.csv", "role": "price", "instrument": name, "currency": "SEK" if name == "BBB" else "EUR"})
    (home / "EURSEK.csv").write_text("date,close,adj_close,dividend\n" + "".join(f"{m},{9 + 0.1 * (i % 7)},,\n" for i, m in enumerate(months())))
    files.append(base | {"path": "EURSEK.csv", "role": "fx", "instrument": "EURSEK=X", "currency": "SEK"})
    for name, cols in (("Developed_5_Factors", ["Mkt-RF", "SMB", "RF"]), ("Developed_MOM_Factor", ["WML"]), ("Europe_5_Factors", ["Mkt-RF", "SMB", "RF"])):
        (home / f"{name}.zip").write_bytes(archive(cols, rng, dt.date(2014, 1, 1) if "MOM" in name else None))
        files.append(base | {"path": f"{name}.zip", "role": "factor"})
    for role, first, last, mean, spread in ((L.SPOT, dt.date(2013, 12, 1), dt.date(2019, 12, 31), 1.15, 0.02), (L.LEG_A, dt.date(2013, 12, 1), dt.date(2019, 11, 30), -0.3, 0.01), (L.LEG_B, dt.date(2019, 9, 1), dt.date(2019, 12, 31), -0.4, 0.01)):
        (home / f"{role}.csv").write_text(daily(first, last, rng, mean, spread))
        files.append(base | {"path": f"{role}.csv", "role": role})
    S.build_manifest(spark, home, files, {n: FACTS for n in NAMES} | {"BBB": FACTS | {"fund_size": "SEK 900m", "currency": "SEK"}}, "2020-01-05")
    return home


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    return L.load_panel(spark, build(spark, tmp_path_factory.mktemp("snap") / "2020-01-05"), start=START, end=END)


def test_document(spark, document):
    spans = document.months.agg({"period_month": "min"}).first()[0], document.months.count()
    assert spans == (dt.date(2014, 2, 1), 71)  # momentum starts a month later, for all legs
    assert document.returns.count() == 70 * 4 and document.as_of == "2020-01-05"
    assert {r.factor for r in document.factors.usd.select("factor").distinct().collect()} == {"Mkt-RF", "SMB", "RF", "MOM"}
    assert {r.factor for r in L.cross_check(document.factors).select("factor").distinct().collect()} == {"Mkt-RF", "SMB"}
    assert document.factors.untranslated.count() == 0 and document.risk_free.basis.first().overlap_days == 91
    said = {(r.rule, r.instrument) for r in document.warnings.collect()}
    assert ("thin or unscreened size", "BBB") in said and ("month without factors", None) in said
    assert {r.leg: r.dropped for r in document.dropped.collect()}["risk_free"] == 1
    seen = document.prices.groupBy("instrument").agg({"period_month": "min"})
    views = Views(prices=document.prices, fx=document.fx, cash=document.risk_free.monthly)
    cover = views.coverage("2020-01-05")
    assert coverage_agreement(cover, cover).first().agrees and seen.count() == 4
    assert not coverage_agreement(cover, cover.where("instrument <> 'AAA'")).first().agrees


def test_reader_in_the_past(spark, document, tmp_path):
    root = build(spark, tmp_path / "2020-01-05")
    early = L.load_panel(spark, root, as_of="2018-07-15", start=START, end=END)
    newest = early.months.agg({"period_month": "max"}).first()[0]
    assert newest == dt.date(2018, 6, 1)
    assert early.risk_free.daily.agg({"day": "max"}).first()[0] == dt.date(2018, 7, 15)
    assert early.returns.exceptAll(document.returns.where("period_month <= '2018-06-01'")).count() == 0


def test_holes_stop_a_load(spark, tmp_path):
    with pytest.raises(DataStop, match="missing bar"):
        L.load_panel(spark, build(spark, tmp_path / "2020-01-05", drop=("CCC", dt.date(2016, 5, 1))), start=START, end=END)
    with pytest.raises(DataStop, match="missing file"):
        L.entries({"files": []}, "price")


def test_a_return_across_a_hole_raises(spark, document):
    cash, fx = document.risk_free.monthly, document.fx
    holed = document.prices.where("not (instrument = 'AAA' and period_month = date'2016-03-01')")
    with pytest.raises(Exception, match="months are not the panel's"):
        R.excess_table(holed, fx, cash, document.months).collect()
    with pytest.raises(Exception, match="no return can be computed"):
        R.excess_table(document.prices, fx.where("period_month <> date'2016-03-01'"), cash, document.months).collect()


def test_windows_with_holes_are_refused(spark, document):
    universe = spark.createDataFrame([(i, n, 0.25) for i, n in enumerate(NAMES)], "ord int, instrument string, policy double")
    steps = B.all_steps(document.months)
    good = B.window_rows(document.returns, steps, universe)
    runs = B.registry(spark).where("run_id in ('policy', 'minimum_variance', 'minimum_variance_expanding')")
    estimates = E.window_estimates(document.returns, document.months, list(NAMES))
    assert B.targets(good, estimates, runs).where("error is not null").count() == 0
    holed = good.where("period_month <> date'2016-03-01'")
    few = E.window_estimates(document.returns.where("period_month <> date'2016-03-01'"), document.months, list(NAMES))
    assert few.count() < estimates.count()
    cut = B.targets(holed, few, runs).where("error is not null")
    assert {r.run_id for r in cut.collect()} == {"policy", "minimum_variance", "minimum_variance_expanding"}
    assert B.cuts(B.targets(good, few, runs)).count() == 3
    factors = document.factors.eur.where("factor <> 'RF'")
    names = ["Mkt-RF", "SMB", "MOM"]
    rows = X.monthly(document.returns, factors, names, list(NAMES))
    assert X.rolling(X.moments(rows, document.months, 8), names, list(NAMES)).where("quantity = 'alpha'").count() == 11 * 2 * 4
    with pytest.raises(Exception, match="a hole"):
        X.rolling(X.moments(rows.where("period_month <> date'2016-03-01'"), document.months, 8), names, list(NAMES)).collect()


def test_study(spark, document, tmp_path):
    rows = [(i, n, c, g, 0.25) for i, (n, c, g) in enumerate(zip(NAMES, ("EUR", "SEK", "EUR", "EUR"), ("equity", "equity", "bond", "bond")))]
    universe = spark.createDataFrame(rows, "ord int, instrument string, currency string, grp string, policy double")
    study = Y.analyse(document.returns, document.months, universe, {"equity": 0.5, "bond": 0.5}, [("all", "2019-01-01", "2019-12-31")])
    filled = {r.run_id for r in study.series.select("run_id").distinct().collect()}
    assert len(filled) + study.cuts.count() == 20 and study.traded.count() == 11
    sheet = {r.run_id: r for r in study.sheet.collect()}
    assert set(sheet) == filled and sheet["equal_weight"].z_equal is None and sheet["policy"].resolution is not None
    assert {r.run_id for r in study.budgets.budget.select("run_id").distinct().collect()} == filled | {Y.POLICY_BOOK}
    for r in study.budgets.shares.groupBy("run_id").agg({"share": "sum"}).collect():
        assert abs(r[1] - 1) < 1e-9
    whole = {r.run_id: r for r in study.linked.collect()}
    for r in study.linked_by_sleeve.groupBy("run_id").sum("allocation", "currency").collect():
        assert abs(r[1] - whole[r.run_id].allocation_carino) < 1e-12 and abs(r[2] - whole[r.run_id].currency_carino) < 1e-12
    assert all(r.drag <= 1e-15 and r.mean_monthly <= 1e-15 for r in study.costs.collect())
    assert set(study.tables) == {"runs", "negative_results", "correlation", "diagnostics", "cost_sensitivity", "sub_periods"}
    records = B.records(B.registry(spark), study.targets, {"snapshot": document.snapshot_id})
    B.write_manifests(records, f"file://{tmp_path}/runs")
    back = spark.read.json(f"file://{tmp_path}/runs")
    assert back.count() == 20 and {r.snapshot for r in back.collect()} == {"2020-01-05"}
    with pytest.raises(Refusal):
        Y.traded_months(study.series.limit(0))


def test_cost_line_needs_every_month(spark):
    rows = spark.createDataFrame([("a", 0.01, 0.009), ("a", 0.02, None)], "run_id string, gross double, net double")
    with pytest.raises(Exception, match="no net return"):
        M.cost_line(rows, "run_id").collect()
