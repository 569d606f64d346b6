"""The study as one call: the grid and everything that is read off it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..operators import attribution as A
from ..operators import metrics as M
from ..operators.labels import covered, need
from ..sources.scratch import once, scope
from . import backtest as B
from . import components as E
from . import study as S

POLICY_BOOK = "policy book"


def traded_months(series: DataFrame) -> DataFrame:
    """The months the runs were measured on; refuses a grid without a run."""
    months = series.select("traded").distinct()
    if not months.limit(1).count():
        raise Refusal("no run, so no traded months")
    return months


def window_covariance(returns: DataFrame, traded: DataFrame) -> DataFrame:
    """i, j, value: the one sample covariance that all budgets are read under."""
    held = returns.join(traded.withColumnRenamed("traded", "period_month"), "period_month", "left_semi")
    return A.covariance(held, [], "excess")


def policy_book(traded: DataFrame, universe: DataFrame) -> DataFrame:
    return traded.join(universe.select("instrument", F.col("policy").alias("weight"))).select(F.lit(POLICY_BOOK).alias("run_id"), "traded", "instrument", "weight")


@dataclass(frozen=True)
class Budgets:
    """Readings of books (run_id, traded, instrument, weight) under one covariance."""

    shares: DataFrame
    budget: DataFrame
    path: DataFrame
    diversification: DataFrame
    additivity: DataFrame
    forecast: DataFrame
    refusal: DataFrame


def risk_budgets(books: DataFrame, active: DataFrame, returns: DataFrame, universe: DataFrame, target: dict[str, float], level: float = 0.05) -> Budgets:
    """Every book's use of the declared budget: of its mean weights, and along its path.
    ``active``: run_id, traded, active of the runs whose forecast can be tested."""
    spark = books.sparkSession
    traded = traded_months(active)
    cov = once(spark, ("budget_covariance", uuid.uuid4().hex), lambda: window_covariance(returns, traded))
    mean = books.groupBy("run_id", "instrument").agg(F.avg("weight").alias("weight"))
    shares = A.contributions(mean, cov, ["run_id"])
    along = A.contributions(books, cov, ["run_id", "traded"]).groupBy("run_id", "instrument").agg(F.avg("share").alias("share"))
    sd = cov.where("i = j").select(F.col("i").alias("instrument"), F.sqrt("value").alias("sd"))
    ratio = shares.join(sd, "instrument").groupBy("run_id").agg((F.sum(F.col("weight") * F.col("sd")) / F.max("volatility")).alias("ratio"))
    adds = shares.groupBy("run_id").agg((F.sum("contribution") / F.max("volatility") - 1).alias("gap"))
    gap = covered(books.select("run_id", "traded", "instrument", "weight"), cov, ["run_id", "traded"]).join(universe.select("instrument", "policy"), "instrument").withColumn("a", F.col("weight") - F.col("policy"))
    x, y = (gap.select("run_id", "traded", F.col("instrument").alias(k), F.col("a").alias(f"a{k}")) for k in "ij")
    variance = x.join(cov, "i").join(y, ["run_id", "traded", "j"]).groupBy("run_id", "traded").agg(F.sum(F.col("ai") * F.col("value") * F.col("aj")).alias("v"))
    before = variance.groupBy("run_id").agg(F.avg(F.sqrt(M.PERIODS * F.greatest("v", F.lit(0.0)))).alias("ex_ante"))
    after = active.groupBy("run_id").agg(M.annualised_sd("active").alias("ex_post"))
    forecast = before.join(after, "run_id").withColumn("difference", F.col("ex_ante") - F.col("ex_post")).withColumn("ratio", F.when(F.col("ex_ante") > 0, F.col("ex_post") / F.col("ex_ante")))
    held = returns.join(traded.withColumnRenamed("traded", "period_month"), "period_month", "left_semi")
    net = held.join(mean, "instrument").groupBy("run_id", F.col("period_month").alias("traded")).agg(F.sum(F.col("weight") * F.col("excess")).alias("net"))
    return Budgets(shares, A.budget(shares, universe, target, ["run_id"]), along, ratio, adds, forecast, A.tail(net, "run_id", level))


@dataclass(frozen=True)
class Analysis:
    targets: DataFrame
    cuts: DataFrame
    books: DataFrame
    series: DataFrame
    traded: DataFrame
    sheet: DataFrame
    bars: DataFrame
    tables: dict[str, DataFrame]
    lines: DataFrame
    linked: DataFrame
    linked_by_sleeve: DataFrame
    costs: DataFrame
    budgets: Budgets


def analyse(returns: DataFrame, months: DataFrame, universe: DataFrame, target: dict[str, float], bins: list[tuple[str, str, str]] = (), size: int = 60) -> Analysis:
    """Runs the grid on a return table and reads comparison, attribution and budgets off
    it. ``returns``: a panel's; ``universe``: instrument, ord, policy, grp."""
    spark = returns.sparkSession
    B.validate()
    runs, key = B.registry(spark), (uuid.uuid4().hex,)
    with scope():
        windows = B.window_rows(returns, B.all_steps(months, size), universe)
        names = [r.instrument for r in universe.orderBy("ord").select("instrument").collect()]  # the sleeves
        need(returns, names)
        estimates = once(spark, ("estimates", *key), lambda: E.window_estimates(returns, months, names, size))
        found = once(spark, ("targets", *key), lambda: B.targets(windows, estimates, runs, size))
        path = once(spark, ("path", *key), lambda: B.books(found, runs))
        series = once(spark, ("series", *key), lambda: B.series(path, returns))
        traded = once(spark, ("traded", *key), lambda: traded_months(series))
        bench = series.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
        active = M.active(series, bench)
        sheet = once(spark, ("sheet", *key), lambda: S.rows(series))
        rows = path.join(returns.withColumnRenamed("period_month", "traded"), ["traded", "instrument"]).join(universe.select("instrument", "policy"), "instrument")
        rows = rows.withColumnRenamed("traded", "period_month")
        lines = once(spark, ("lines", *key), lambda: A.allocation_lines(rows))
        books = path.select("run_id", "traded", "instrument", F.col("book").alias("weight")).unionByName(policy_book(traded, universe))
        return Analysis(
            found, B.cuts(found), path, series, traded, sheet, S.bars(active), S.block_tables(sheet, active, list(bins)), lines, A.linking(lines),
            A.linked_by_sleeve(A.sleeve_lines(rows), lines), M.cost_line(series, "run_id"), risk_budgets(books, active, returns, universe, target),
        )
