"""The comparison of a grid's runs: rows, bars, retention and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import metrics as M
from ..operators import verdicts as V
from .backtest import CELLS, PAIRS, RUNS, summary
from .draws import RESAMPLES, SEED, resampled_months


def _cells(active: DataFrame) -> DataFrame:
    return active.where(F.col("run_id").isin(*CELLS))


def _retention(active: DataFrame) -> DataFrame:
    """The seeded bootstrap over the filled cells, each row with the leader's share."""
    cells = _cells(active)
    months = cells.select("traded").distinct().count()
    out = M.retention(cells, "run_id", resampled_months(active.sparkSession, months))
    leader = out.where("leads").select(F.col("run_id").alias("leader"), F.col("first_share").alias("leader_retention"))
    return out.crossJoin(F.broadcast(leader)).select("run_id", F.col("own_sign").alias("retention"), "median_rank", "leader", "leader_retention")


def bars(active: DataFrame) -> DataFrame:
    """filled, effective, bar, adjusted_bar: the declared and the correlation-adjusted bar."""
    return M.effective_tests(cell_correlation(active), [K.family_wise_bar(k) for k in range(1, len(CELLS) + 1)])


def rows(series: DataFrame) -> DataFrame:
    """One row a run with everything the ladder reads, and its verdict: the test against
    the benchmark with its haircut and resolution, and the one against equal weight.

    ``series``: run_id, traded, gross, net, turnover, at_cap of every filled run.
    """
    bench = series.where("run_id = 'policy'").select("traded", F.col("gross").alias("net"))
    active = M.active(series, bench)
    bar = bars(active)
    n = F.count("*")
    block = active.groupBy("run_id").agg(n.alias("months"), M.ratio("active").alias("information_ratio"), M.annualised_sd("active").alias("tracking_error"), F.corr("net", "bench").alias("rho"), F.count_if(F.col("at_cap") > 0).alias("cap_binding_steps"))
    error = M.paired_error(F.col("months"), F.col("rho"))
    block = block.withColumn("se", error).withColumn("z", M.statistic(F.col("information_ratio"), F.col("se"))).drop("rho")
    equal = series.where("run_id = 'equal_weight'").select("traded", F.col("net").alias("equal"))
    same = series.join(F.broadcast(equal), "traded").groupBy("run_id").agg((F.max(F.abs(F.col("net") - F.col("equal"))) <= 1e-6).alias("reproduces"))
    spec = series.sparkSession.createDataFrame([(r[0], r[1], r[6] == "expanding", r[0].removesuffix("_expanding")) for r in RUNS], "run_id string, stage string, is_repeat boolean, cell string")
    second = M.paired(active, "run_id", "equal_weight", 0.0, 1.0).select(
        "run_id", F.col("difference").alias("difference_equal"), F.col("se").alias("se_equal"), F.col("z").alias("z_equal")
    )
    out = block.join(F.broadcast(spec), "run_id").join(same, "run_id").join(_retention(active), "run_id", "left").join(second, "run_id", "left").crossJoin(F.broadcast(bar))
    out = out.withColumn("clears_bar", V.clears(F.col("z"), F.col("bar"))).withColumn("clears_equal", V.clears(F.col("z_equal"), F.col("bar")))
    out = out.withColumn("resolution", (F.col("bar") + K.POWER_QUANTILE) * F.col("se")).withColumn("resolution_equal", (F.col("bar") + K.POWER_QUANTILE) * F.col("se_equal"))
    wide = out.where("is_repeat").select("cell", F.col("information_ratio").alias("expanding_ratio"))
    out = out.join(F.broadcast(wide), "cell", "left")
    out = out.withColumn("expanding_sign", F.when(~F.col("is_repeat"), V.sign_holds(F.col("information_ratio"), F.col("expanding_ratio"))))
    out = out.withColumn("is_leader", F.coalesce(F.col("leader") == F.col("run_id"), F.lit(False)))
    return out.withColumn("verdict", V.verdict()).withColumn("claim", V.claimed())


def cell_correlation(active: DataFrame) -> DataFrame:
    """i, j, value: correlations of the cells' net returns, described and never tested."""
    cells = _cells(active)
    a, b = (cells.select("traded", F.col("run_id").alias(k), F.col("net").alias(v)) for k, v in (("i", "x"), ("j", "y")))
    return a.join(b, "traded").groupBy("i", "j").agg(F.corr("x", "y").alias("value"))


def block_tables(sheet: DataFrame, active: DataFrame, bins: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The tables a comparison shows: runs, negative results, correlations, sub-periods,
    the paths' diagnostics and the cost sensitivity."""
    out = {
        "runs": sheet, "negative_results": V.negative_results(sheet).select("run_id", "verdict"), "correlation": cell_correlation(active),
        "diagnostics": summary(active).join(M.drawdown(active, "run_id"), "run_id"), "cost_sensitivity": M.sensitivity(active, "run_id"),
    }
    if bins:
        out["sub_periods"] = M.sub_periods(active, "run_id", bins)
    return out


def metric_table(table: DataFrame) -> DataFrame:
    """Long numbers of a row table, to hold two runs of the study against each other."""
    numbers = [c for c, t in table.dtypes if t in ("double", "bigint", "int")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers]))
    return table.select("run_id", pairs.alias("p")).select("run_id", "p.metric", "p.value")


def reproduces(left: DataFrame, right: DataFrame, tolerance: float = 1e-6, floor: float = 1e-3) -> DataFrame:
    """Numbers of two metric tables that differ, or that only one has."""
    a, b = left.withColumnRenamed("value", "a"), right.withColumnRenamed("value", "b")
    far = F.abs(F.col("a") - F.col("b")) > tolerance * F.greatest(F.abs("a"), F.abs("b"), F.lit(floor))
    return a.join(b, ["run_id", "metric"], "full_outer").where((F.col("a").isNull() != F.col("b").isNull()) | far)


def cap_pairs(series: DataFrame) -> DataFrame:
    """Each run that a pair holds to the cap beside the run without it: turnover, effective
    sleeves, largest weight and volatility of both, and what lifting the cap changed."""
    spark = series.sparkSession
    seen = summary(series).join(series.groupBy("run_id").agg(M.annualised_sd("net").alias("volatility")), "run_id")
    numbers = {"turnover": "turnover_annualised", "sleeves": "concentration", "largest": "largest_weight", "volatility": "volatility"}
    pairs = spark.createDataFrame(list(PAIRS.items()), "run_id string, lifted string")
    held = seen.select("run_id", *[F.col(c).alias(n) for n, c in numbers.items()])
    free = seen.select(F.col("run_id").alias("lifted"), *[F.col(c).alias(f"{n}_lifted") for n, c in numbers.items()])
    out = held.join(F.broadcast(pairs), "run_id").join(free, "lifted")
    return out.select("run_id", "lifted", *[c for n in numbers for c in (n, f"{n}_lifted", (F.col(f"{n}_lifted") - F.col(n)).alias(f"{n}_change"))])


def provenance(sheet: DataFrame, snapshot: str, size: int = 60, rates: tuple[float, ...] = M.SENSITIVITY_BP) -> DataFrame:
    """What the numbers of a comparison travel with: a row for each key and its text."""
    one = sheet.agg(F.count("*").alias("runs"), F.count_if(F.col("run_id").isin(*CELLS)).alias("cells"), F.max("months").alias("months"), *[F.max(c).alias(c) for c in ("bar", "effective", "adjusted_bar")])
    text = {
        "snapshot": F.lit(snapshot),
        "protocol": F.lit(f"rolling {size}-month windows, refit every month, traded months out of sample"),
        "runs": F.format_string("%d runs of %d cells", "runs", "cells"),
        "months traded": F.format_string("%d out-of-sample months", "months"),
        "cost multiple": F.lit(f"{M.COST_BP:.0f} bp a side on traded notional; also at " + ", ".join(f"{r:.0f}" for r in rates) + " bp"),
        "bootstrap": F.lit(f"{RESAMPLES} resamples, seed {SEED}"),
        "bar": F.format_string("|z| >= %.4f for %d cells; %.1f effective tests would give %.4f", "bar", "cells", "effective", "adjusted_bar"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in text.items()])).alias("p")).select("p.key", "p.value")
