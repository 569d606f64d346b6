"""Holdings attribution, linking, risk budget and tail contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import numbered
from .labels import covered


def quotient(top: Column, bottom: Column, limit: Column) -> Column:
    return F.when(F.abs(bottom) > 1e-12, top / bottom).otherwise(limit)


def single_period(rows: DataFrame) -> DataFrame:
    """Brinson-Fachler and Brinson-Hood-Beebower totals per month of rows with
    weight, policy, ret and bench_ret per sleeve."""
    total = Window.partitionBy("period_month")
    b = F.sum(F.col("policy") * F.col("bench_ret")).over(total)
    gap = F.col("weight") - F.col("policy")
    rows = rows.withColumn("bench_total", b)
    return rows.groupBy("period_month").agg(
        F.sum(gap * (F.col("bench_ret") - F.col("bench_total"))).alias("allocation"),
        F.sum(F.col("policy") * (F.col("ret") - F.col("bench_ret"))).alias("selection"),
        F.sum(gap * (F.col("ret") - F.col("bench_ret"))).alias("interaction"),
        F.sum(gap * F.col("bench_ret")).alias("allocation_bhb"),
    )


def allocation_lines(rows: DataFrame) -> DataFrame:
    """Per run and month: allocation, currency, interaction and active from rows with
    book, policy, local, translation, euro, rf per instrument."""
    keys = Window.partitionBy("run_id", "period_month")
    rows = rows.withColumn("local_b", F.sum(F.col("policy") * F.col("local")).over(keys)).withColumn("gap", F.col("book") - F.col("policy"))
    return rows.groupBy("run_id", "period_month").agg(
        F.sum(F.col("gap") * (F.col("local") - F.col("local_b"))).alias("allocation"),
        F.sum(F.col("gap") * F.col("translation")).alias("currency"),
        F.sum(F.col("gap") * F.col("local") * F.col("translation")).alias("interaction"),
        F.sum(F.col("gap") * F.col("euro")).alias("active"),
        F.sum(F.col("policy") * F.col("euro")).alias("benchmark"),
        F.sum(F.col("book") * F.col("euro")).alias("portfolio"),
        (F.sum(F.col("policy") * F.col("euro")) - F.max("rf")).alias("level"),
        F.abs(F.sum("gap")).alias("residual"),
    )


def sleeve_lines(rows: DataFrame) -> DataFrame:
    """``allocation_lines`` before its sum: each instrument's effects, run and month."""
    keys = Window.partitionBy("run_id", "period_month")
    rows = rows.withColumn("local_b", F.sum(F.col("policy") * F.col("local")).over(keys)).withColumn("gap", F.col("book") - F.col("policy"))
    return rows.select(
        "run_id", "period_month", "instrument", (F.col("gap") * (F.col("local") - F.col("local_b"))).alias("allocation"),
        (F.col("gap") * F.col("translation")).alias("currency"), (F.col("gap") * F.col("local") * F.col("translation")).alias("interaction"),
    )


def linked_by_sleeve(sleeves: DataFrame, lines: DataFrame, effects: tuple[str, ...] = ("allocation", "currency", "interaction")) -> DataFrame:
    """Each instrument's effects linked over a run by the run's own Cariño coefficients."""
    p, b = F.col("portfolio"), F.col("benchmark")
    totals = lines.groupBy("run_id").agg((F.product(1 + p) - 1).alias("P"), (F.product(1 + b) - 1).alias("B"))
    k = quotient(F.log1p(p) - F.log1p(b), p - b, 1 / (1 + p))
    big_k = quotient(F.log1p("P") - F.log1p("B"), F.col("P") - F.col("B"), 1 / (1 + F.col("P")))
    scale = lines.join(totals, "run_id").select("run_id", "period_month", (k / big_k).alias("scale"))
    return sleeves.join(scale, ["run_id", "period_month"]).groupBy("run_id", "instrument").agg(*[F.sum(F.col(e) * F.col("scale")).alias(e) for e in effects])


def cross_view(holding: DataFrame, factor_view: DataFrame, tolerance: float = 1e-9, floor: float = 1e-6) -> DataFrame:
    """Per run, how far two views of one active return (run_id, traded, active) lie apart;
    a month that only the first has raises when it is read."""
    other = factor_view.select("run_id", "traded", F.col("active").alias("seen"))
    known = F.coalesce(F.col("seen"), F.raise_error(F.lit("the factor view lacks a month")).cast("double"))
    rows = holding.join(other, ["run_id", "traded"], "left").withColumn("gap", F.col("active") - known)
    out = rows.groupBy("run_id").agg(F.max(F.abs("gap")).alias("worst"), F.avg("gap").alias("mean"), F.max(F.abs("active")).alias("scale"))
    base = F.greatest("scale", F.lit(floor))
    return out.select("run_id", "worst", "mean", "scale", (F.col("worst") / base).alias("relative"), (F.col("worst") <= tolerance * base).alias("reconciles"))


def linking(lines: DataFrame, effects: tuple[str, ...] = ("allocation", "currency", "interaction")) -> DataFrame:
    """Cariño and Menchero sums of each effect over a run, and what is left over."""
    p, b = F.col("portfolio"), F.col("benchmark")
    totals = lines.groupBy("run_id").agg(
        (F.product(1 + p) - 1).alias("P"), (F.product(1 + b) - 1).alias("B"), F.count("*").cast("double").alias("n"), F.sum(p - b).alias("d1"), F.sum((p - b) * (p - b)).alias("d2")
    )
    rows = lines.join(totals, "run_id")
    k = quotient(F.log1p(p) - F.log1p(b), p - b, 1 / (1 + p))
    big_k = quotient(F.log1p("P") - F.log1p("B"), F.col("P") - F.col("B"), 1 / (1 + F.col("P")))
    root = F.pow(1 + F.col("P"), 1 / F.col("n")) - F.pow(1 + F.col("B"), 1 / F.col("n"))
    m = quotient((F.col("P") - F.col("B")) / F.col("n"), root, F.pow(1 + F.col("P"), (F.col("n") - 1) / F.col("n")))
    a = quotient((F.col("P") - F.col("B") - m * F.col("d1")) * (p - b), F.col("d2"), F.lit(0.0))
    sums = []
    for e in effects:
        sums += [F.sum(F.col(e) * k / big_k).alias(f"{e}_carino"), F.sum(F.col(e) * (m + a)).alias(f"{e}_menchero")]
    out = rows.groupBy("run_id").agg(*sums, F.first(F.col("P") - F.col("B")).alias("active"))
    for way in ("carino", "menchero"):
        out = out.withColumn(f"residual_{way}", F.col("active") - sum(F.col(f"{e}_{way}") for e in effects))
    return out


def covariance(rows: DataFrame, keys: list[str], value: str, name: str = "instrument", month: str = "period_month") -> DataFrame:
    """Long sample covariance (ddof 1) of series on one calendar: keys, i, j, value."""
    a = rows.select(*keys, month, F.col(name).alias("i"), F.col(value).alias("x"))
    b = rows.select(*keys, month, F.col(name).alias("j"), F.col(value).alias("y"))
    return a.join(b, [*keys, month]).groupBy(*keys, "i", "j").agg(F.covar_samp("x", "y").alias("value"))


def window_covariance(rows: DataFrame, months: DataFrame, size: int = 60, value: str = "excess", name: str = "instrument") -> DataFrame:
    """Sample covariances of every pair over each traded month's windows: protocol,
    traded, i, j, value.

    A pair's products of a month are joined once; the windows are frames over the
    calendar's places, so no month is repeated for the windows that hold it.
    """
    placed = rows.join(F.broadcast(numbered(months)), "period_month").select("period_month", "pos", F.col(name).alias("i"), F.col(value).alias("x"))
    pairs = placed.join(placed.select("period_month", F.col("i").alias("j"), F.col("x").alias("y")), "period_month")
    order = Window.partitionBy("i", "j").orderBy("pos")
    frames = {"rolling": order.rangeBetween(-size, -1), "expanding": order.rangeBetween(Window.unboundedPreceding, -1)}
    cells = F.array(*[F.struct(F.lit(k).alias("protocol"), F.covar_samp("x", "y").over(frame).alias("value")) for k, frame in frames.items()])
    found = pairs.select(F.col("period_month").alias("traded"), "i", "j", "pos", cells.alias("cells")).where(F.col("pos") >= size)
    return found.select("traded", "i", "j", F.explode("cells").alias("c")).select("c.protocol", "traded", "i", "j", "c.value")


def contributions(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Euler contributions: marginal, contribution and share per instrument. A book and a
    covariance that do not name the same sleeves raise."""
    weights = covered(weights.select(*keys, "instrument", "weight"), cov, keys)
    w, v = weights.select(*keys, F.col("instrument").alias("i"), F.col("weight").alias("wi")), weights.select(*keys, F.col("instrument").alias("j"), F.col("weight").alias("wj"))
    cov_keys = [k for k in keys if k in cov.columns]
    rows = w.join(cov, [*cov_keys, "i"]).join(v, [*keys, "j"])
    cross = rows.groupBy(*keys, "i").agg(F.first("wi").alias("weight"), F.sum(F.col("value") * F.col("wj")).alias("m"))
    over = Window.partitionBy(*keys)
    cross = cross.withColumn("variance", F.sum(F.col("weight") * F.col("m")).over(over))
    sd = F.sqrt(F.when(F.col("variance") > 0, F.col("variance")).otherwise(F.raise_error(F.lit("a book without variance")).cast("double")))
    return cross.select(
        *keys, F.col("i").alias("instrument"), "weight", sd.alias("volatility"), (F.col("m") / sd).alias("marginal"),
        (F.col("weight") * F.col("m") / sd).alias("contribution"), (F.col("weight") * F.col("m") / F.col("variance")).alias("share"),
    )


def budget(shares: DataFrame, universe: DataFrame, target: dict[str, float], keys: list[str]) -> DataFrame:
    """Group shares against the declared budget, its gap, and groups it lacks."""
    dim = shares.sparkSession.createDataFrame(list(target.items()), "grp string, declared double")
    rows = shares.join(F.broadcast(universe.select("instrument", "grp")), "instrument").groupBy(*keys, "grp").agg(F.sum("share").alias("consumed"))
    rows = rows.join(F.broadcast(dim), "grp", "left")
    return rows.select(*keys, "grp", "consumed", "declared", (F.col("consumed") - F.col("declared")).alias("gap"), F.col("declared").isNull().alias("undeclared"))


def tail(rows: DataFrame, key: str, level: float = 0.05) -> DataFrame:
    """Value at risk, shortfall of the losses at or beyond it, and what the shortfall
    exceeds it by, of (key, traded, net)."""
    loss = -F.col("net")
    bar = rows.groupBy(key).agg(F.percentile(loss, 1 - level).alias("var"))
    worst = rows.join(F.broadcast(bar), key).where(loss >= F.col("var"))
    out = worst.groupBy(key).agg(F.first("var").alias("var"), F.avg(loss).alias("shortfall"), F.count("*").alias("n_tail"))
    return out.withColumn("overstatement", F.col("shortfall") - F.col("var"))


def expected_shortfall(rows: DataFrame, key: str, level: float = 0.05) -> DataFrame:
    """Mean of the worst ceil(level * months) losses."""
    order, whole = Window.partitionBy(key).orderBy("net", "traded"), Window.partitionBy(key)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("months", F.count("*").over(whole))
    return rows.where(F.col("place") <= F.ceil(level * F.col("months"))).groupBy(key).agg((-F.avg("net")).alias("expected_shortfall"))


def tail_contributions(members: DataFrame, key: str, level: float = 0.05) -> DataFrame:
    """Per instrument, its weighted mean loss in the book's tail months, of rows
    (key, traded, instrument, weight, ret)."""
    months = members.groupBy(key, "traded").agg(F.sum(F.col("weight") * F.col("ret")).alias("net"))
    bar = months.groupBy(key).agg(F.percentile(-F.col("net"), 1 - level).alias("var"))
    worst = months.join(F.broadcast(bar), key).where(-F.col("net") >= F.col("var")).select(key, "traded")
    return members.join(worst, [key, "traded"]).groupBy(key, "instrument").agg((-F.avg(F.col("weight") * F.col("ret"))).alias("contribution"))
