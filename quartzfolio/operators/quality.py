"""The data gate: stops as one violations query, warnings as another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataStop
from .calendar import available_from, gaps
from .returns import recomputed_total_return, total_return

#: Largest plausible monthly move of a line without a bound of its own, and the fund
#: size in euro under which a line counts as thin (fixed values).
MOVE_DEFAULT, LIQUIDITY_FLOOR_EUR = 0.60, 1.35e9
#: Distributions a year by cadence, and for an unnamed cadence (fixed values).
CADENCE, CADENCE_DEFAULT = {"quarterly": 4, "semi-annual": 2, "annual": 1}, 12


def missing_columns(frame: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c not in frame.columns]


def stop_missing_columns(frame: DataFrame, wanted: tuple[str, ...]) -> None:
    if absent := missing_columns(frame, wanted):
        raise DataStop("missing column", ", ".join(absent))


def distributing(policy: str | Column) -> Column:
    return F.lower(policy).startswith("distributing")


def fund_size_eur(size: Column, rate: Column) -> Column:
    """Euro value of a size like 'EUR 1.30bn'; null where it has no such form or rate."""
    text = F.replace(F.trim(size), F.lit(","), F.lit(""))
    form = r"^([A-Z]{3})\s+([0-9.]+)(bn|m|k)$"
    unit = F.regexp_extract(text, form, 3)
    scale = F.when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3)
    return F.regexp_extract(text, form, 2).try_cast("double") * scale * rate


def violations(prices: DataFrame, facts: DataFrame | None, window_start: str, snapshot: str, bounds: dict[str, float] | None = None) -> DataFrame:
    """place, rule, instrument, detail of everything that stops a load, in one query;
    ``place`` is the rule's place in the fixed order. Without ``facts`` (an exchange rate
    has none) the rules that read them are left out."""
    bad = lambda rows, rule, detail: rows.select(F.lit(rule).alias("rule"), "instrument", detail.cast("string").alias("detail"))
    dated = F.col("period_month").isNull() | (F.col("period_month") != F.trunc("period_month", "MM"))
    per_month = prices.groupBy("instrument", "period_month").count().where("count > 1")
    starts = prices.groupBy("instrument").agg(F.min("period_month").alias("first")).where(F.col("first") > F.lit(window_start).cast("date"))
    fresh = prices.where(available_from(F.col("period_month")) > F.lit(snapshot).cast("date"))
    paid = prices.groupBy("instrument").agg(F.sum(F.coalesce("dividend", F.lit(0.0))).alias("paid"))
    bound = reduce(lambda c, kv: F.when(F.col("instrument") == kv[0], kv[1]).otherwise(c), (bounds or {}).items(), F.lit(MOVE_DEFAULT))
    moved = total_return(prices).where(F.abs("local") > bound)
    parts = [
        bad(prices.where(dated), "malformed date", F.col("period_month")),
        bad(per_month, "missing bar", F.concat(F.lit("repeated "), F.col("period_month"))),
        bad(gaps(prices, ["instrument"]), "missing bar", F.col("period_month")),
        bad(starts, "line starting late", F.col("first")),
        bad(fresh, "too-fresh bar", F.col("period_month")),
        bad(prices.where("adj_close <= 0 or close <= 0"), "implausible level", F.col("period_month")),
        bad(moved, "implausible move", F.col("period_month")),
    ]
    if facts is not None:
        blind = paid.join(facts, "instrument").where(distributing("income") & (F.col("paid") == 0))
        without = prices.select("instrument").distinct().join(facts.where("income is not null and size is not null"), "instrument", "left_anti")
        parts.insert(5, bad(blind, "distributing line with no distribution", F.col("income")))
        parts.append(bad(without, "issuer facts missing", F.lit("")))
    return reduce(DataFrame.unionAll, [p.select(F.lit(i).alias("place"), "*") for i, p in enumerate(parts)])


def run_gate(found: DataFrame) -> None:
    """Raises for the first violation in the order of the rules; the gate's one action."""
    rows = found.orderBy("place", "instrument", "detail").limit(1).collect()
    if rows:
        raise DataStop(rows[0].rule, f"{rows[0].instrument}: {rows[0].detail}")


def warn_divergence(prices: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Instruments whose compounded feed and rebuilt returns differ."""
    rows = recomputed_total_return(total_return(prices)).where("local is not null and rebuilt is not null")
    total = rows.groupBy("instrument").agg((F.product(1 + F.col("local")) - F.product(1 + F.col("rebuilt"))).alias("gap"))
    return total.where(F.abs("gap") > tolerance)


def warn_liquidity(facts: DataFrame, rates: DataFrame, floor: float = LIQUIDITY_FLOOR_EUR) -> DataFrame:
    """instrument, eur, screened: thin lines and lines whose size can't be read."""
    code = F.substring(F.trim("size"), 1, 3)
    known = facts.join(rates.select(F.col("currency").alias("code"), "rate"), code == F.col("code"), "left")
    eur = fund_size_eur(F.col("size"), F.when(code == "EUR", 1.0).otherwise(F.col("rate")))
    return known.select("instrument", eur.alias("eur"), eur.isNotNull().alias("screened")).where("eur is null or eur < " + str(floor))


def newest_rates(fx: DataFrame) -> DataFrame:
    """Euro per unit at the newest month of each quote."""
    return fx.groupBy("currency").agg((1 / F.max_by("close", "period_month")).alias("rate"))


def warn_factor_trim(prices: DataFrame, factors: DataFrame) -> DataFrame:
    return prices.select("period_month").distinct().join(factors.select("period_month").distinct(), "period_month", "left_anti")


def warn_distributions(prices: DataFrame, facts: DataFrame) -> DataFrame:
    """Years with more events than the cadence allows, or any event of a non-payer."""
    events = prices.where("dividend > 0").groupBy("instrument", F.year("period_month").alias("year")).agg(F.count("*").alias("events"))
    allowed = F.lit(CADENCE_DEFAULT)
    for name, n in sorted(CADENCE.items(), key=lambda kv: kv[1]):  # 'annual' is part of 'semi-annual'
        allowed = F.when(F.lower("income").contains(name), n).otherwise(allowed)
    allowed = F.when(~distributing("income"), 0).otherwise(allowed)
    return events.join(facts.select("instrument", "income"), "instrument").withColumn("allowed", allowed).where("events > allowed")


def warnings(prices: DataFrame, facts: DataFrame | None = None, rates: DataFrame | None = None, factors: DataFrame | None = None) -> DataFrame:
    """rule, instrument, detail of everything that qualifies a load, in one query."""
    said = lambda rows, rule, name, detail: rows.select(F.lit(rule).alias("rule"), name.alias("instrument"), detail.cast("string").alias("detail"))
    line = F.col("instrument")
    parts = [said(warn_divergence(prices), "total return differs", line, F.round("gap", 6))]
    if facts is not None:
        if rates is not None:
            parts.append(said(warn_liquidity(facts, rates), "thin or unscreened size", line, F.round("eur", 0)))
        parts.append(said(warn_distributions(prices, facts), "more distributions than the policy", line, F.concat_ws(" in ", "events", "year")))
    if factors is not None:
        parts.append(said(warn_factor_trim(prices, factors), "month without factors", F.lit(None).cast("string"), F.col("period_month")))
    return reduce(DataFrame.unionAll, parts)
