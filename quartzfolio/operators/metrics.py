"""Metrics of return series: one row a series, from long rows (key, month, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 12
#: Basis points a side charged on traded notional, and the sensitivity set (fixed values).
COST_BP, SENSITIVITY_BP = 10.0, (5.0, 20.0, 40.0)


def cost(turnover: Column, bp: float | Column = COST_BP) -> Column:
    """Two sides of a one-way turnover."""
    return 2 * turnover * bp / 1e4


def ratio(value: str | Column) -> Column:
    """Annualised information ratio; 0 where nothing varies (beyond rounding), null under two rows."""
    sd = F.stddev_samp(value)
    return F.when(F.count(value) < 2, None).when(sd <= 1e-12, 0.0).otherwise(F.avg(value) / sd * F.sqrt(F.lit(float(PERIODS))))


def annualised_sd(value: str | Column) -> Column:
    return F.stddev_samp(value) * F.sqrt(F.lit(float(PERIODS)))


def active(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds active; a month without a benchmark raises when it is read."""
    known = F.coalesce(F.col("bench"), F.raise_error(F.lit("a traded month has no benchmark")).cast("double"))
    return rows.join(benchmark.select("traded", F.col("net").alias("bench")), "traded", "left").withColumn("active", F.col("net") - known)


def cost_line(rows: DataFrame, key: str) -> DataFrame:
    """What the trades of (key, traded, gross, net) took: a month, a year, and from the
    compounded return. A month without a net raises when it is read."""
    paid = F.coalesce(F.col("net"), F.raise_error(F.lit("a month has no net return")).cast("double")) - F.col("gross")
    return rows.groupBy(key).agg(
        F.avg(paid).alias("mean_monthly"), (F.avg(paid) * PERIODS).alias("annualised"), (F.product(1 + F.col("net")) - F.product(1 + F.col("gross"))).alias("drag")
    )


def drawdown(rows: DataFrame, key: str, value: str = "net", order: str = "traded") -> DataFrame:
    """Worst fall from the running peak; the peak starts at the first month's end."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("curve", F.product(1 + F.col(value)).over(so_far))
    fall = curve.withColumn("fall", F.col("curve") / F.max("curve").over(so_far) - 1)
    return fall.groupBy(key).agg(F.min("fall").alias("drawdown"))


def block(rows: DataFrame, key: str) -> DataFrame:
    """Per series of (key, traded, net, active): the ratio, risk and drawdown block."""
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), ratio("active").alias("information_ratio"), annualised_sd("net").alias("volatility"),
        annualised_sd("active").alias("tracking_error"), (F.product(1 + F.col("net")) - 1).alias("cumulative"),
    )
    return out.join(drawdown(rows, key), key)


def sensitivity(rows: DataFrame, key: str, rates: tuple[float, ...] = SENSITIVITY_BP) -> DataFrame:
    """Per series of (key, traded, gross, turnover, bench) and rate: what it costs."""
    priced = rows.withColumn("bp", F.explode(F.array(*[F.lit(r) for r in rates])))
    priced = priced.withColumn("paid", cost(F.col("turnover"), F.col("bp"))).withColumn("kept", F.col("gross") - F.col("paid"))
    return priced.groupBy(key, "bp").agg(
        (F.avg("paid") * PERIODS).alias("cost_per_year"), (F.product(1 + F.col("kept")) - 1).alias("cumulative"), ratio(F.col("kept") - F.col("bench")).alias("information_ratio")
    )


def sub_periods(rows: DataFrame, key: str, bins: list[tuple[str, str, str]]) -> DataFrame:
    """Ratio per declared calendar bin; null with two months or fewer."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(bins, "period string, lo string, hi string").select("period", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    held = rows.join(F.broadcast(dim), F.col("traded").between(F.col("lo"), F.col("hi")))
    return held.groupBy(key, "period").agg(F.count("*").alias("n"), F.when(F.count("*") > 2, ratio("active")).alias("information_ratio"))


def statistic(difference: Column, error: Column, tolerance: float = 1e-6) -> Column:
    """difference / error; without an error, 0 for equal ratios and else unbounded."""
    unbounded = F.signum(difference) * F.lit(float("inf"))
    return F.when(error > tolerance, difference / F.when(error > tolerance, error)).when(F.abs(difference) <= tolerance, 0.0).otherwise(unbounded)


def paired_error(n: Column, rho: Column) -> Column:
    return F.sqrt(F.lit(float(PERIODS)) / n) * F.sqrt(2 * F.greatest(1 - F.coalesce(rho, F.lit(0.0)), F.lit(0.0)))


def paired(rows: DataFrame, key: str, base: str, bar: float, power: float) -> DataFrame:
    """Each series of (key, traded, net, active) against ``base``: ratio difference,
    correlation of the returns, standard error, z, and the resolution of the test."""
    reference = rows.where(F.col(key) == base).select("traded", F.col("active").alias("other"), F.col("net").alias("other_net"))
    both = rows.where(F.col(key) != base).join(F.broadcast(reference), "traded")
    stats = both.groupBy(key).agg(F.count("*").alias("n"), ratio("active").alias("ir"), ratio("other").alias("ir_base"), F.corr("net", "other_net").alias("rho"))
    stats = stats.withColumn("difference", F.col("ir") - F.col("ir_base")).withColumn("se", paired_error(F.col("n"), F.col("rho")))
    return stats.select(key, "n", "difference", "rho", "se", statistic(F.col("difference"), F.col("se")).alias("z"), ((bar + power) * F.col("se")).alias("resolution"))


def retention(rows: DataFrame, key: str, draws: DataFrame) -> DataFrame:
    """Series of (key, traded, active) under shared resamples of their months.

    ``draws``: draw, pos, month_index (places in the months' order from 0), the same
    months for every series, so their correlation survives. Per series: how often it
    leads a draw, its median rank, how often its ratio keeps its sign, its ratio over all
    months, and whether it leads there. A series that does not vary, in a draw or at
    all, has no ratio: it ranks last, never leads and keeps no sign. Ratios that agree to
    ten digits tie, since sums depend on their order, and ties go to the smaller key.
    """
    sd = F.stddev_samp("active")
    bare = F.when(sd > 1e-12, F.avg("active") / sd * F.sqrt(F.lit(float(PERIODS))))
    place = Window.partitionBy(key).orderBy("traded")
    months = rows.select(key, "active", (F.row_number().over(place) - 1).alias("month_index"))
    drawn = draws.join(months, "month_index").groupBy("draw", key).agg(bare.alias("ir"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.round("ir", 10).desc_nulls_last(), key)))
    full = rows.groupBy(key).agg(bare.alias("actual"))
    leader = full.where("actual is not null").agg(F.min_by(key, F.struct(-F.round("actual", 10), F.col(key))).alias("leader"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = ranked.join(full, key).groupBy(key).agg(
        share((F.col("rank") == 1) & F.col("ir").isNotNull()).alias("first_share"), F.percentile("rank", 0.5).alias("median_rank"),
        share(F.signum("ir") == F.signum("actual")).alias("own_sign"), F.first("actual").alias("actual"),
    )
    return out.crossJoin(F.broadcast(leader)).withColumn("leads", F.coalesce(F.col(key) == F.col("leader"), F.lit(False))).drop("leader")


def effective_tests(correlation: DataFrame, bars: list[float]) -> DataFrame:
    """filled, effective, bar, adjusted_bar of long correlations (i, j, value), every pair
    both ways and each series with itself.

    Eigenvalues of a correlation matrix average one and their squares add up to those of
    its cells, so their variance is sum(value**2) / n - 1, and Nyholt's number of
    independent tests is 1 + (n - 1) (1 - variance / n). ``bars``: the bar for 1, 2, ... tests.
    """
    square = F.col("value") * F.col("value")
    out = correlation.groupBy().agg(F.countDistinct("i").cast("int").alias("filled"), F.sum(square).alias("squares")).where("filled > 0")
    n = F.col("filled")
    spread = F.col("squares") / n - 1
    out = out.withColumn("effective", F.when(n > 1, F.greatest(F.lit(1.0), 1 + (n - 1) * (1 - spread / n))).otherwise(1.0))
    bar = lambda k: F.get(F.array(*map(F.lit, bars)), k.cast("int") - 1)
    return out.select("filled", "effective", bar(n).alias("bar"), bar(F.greatest(F.bround("effective"), F.lit(1.0))).alias("adjusted_bar"))
