"""The star-schema tables as a monthly panel: the long-table contract.

Fact tables are reduced where they are read, and only what is left is joined: line items
to a row for each part and month before they meet the parts, orders to one for each
customer and month before they meet the customers, the overnight rates to one for each
leg and day without a join. Each reduction reads its own columns and is a written table,
so no plan behind it scans a fact table again; a query that needs prices alone does not
read the rates. Means travel as sums and counts. The last month counts if the table
reaches its last day; that day comes with the reduction itself, not from a scan of its
own. A dimension is broadcast only where Spark measures it as small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import add_availability, month
from .scratch import once, scope

#: The panel's declared splice date, and the universe in its fixed order: instrument,
#: sleeve currency, group, policy weight (all fixed values).
SPLICE = "1998-01-01"
UNIVERSE = (
    ("ECONOMY", "EUR", "equity", 0.30),
    ("PROMO", "SEK", "equity", 0.20),
    ("SMALL", "EUR", "government", 0.20),
    ("STANDARD", "EUR", "government", 0.10),
    ("MEDIUM", "EUR", "credit", 0.12),
    ("LARGE", "EUR", "real_and_cash", 0.08),
)
RISK_BUDGET = {"equity": 0.55, "government": 0.20, "credit": 0.15, "real_and_cash": 0.10}
#: Issuer facts of the instruments: income policy and fund size as published.
FACTS = (
    ("ECONOMY", "Accumulating", "EUR 4.00bn"),
    ("PROMO", "Distributing (quarterly)", "SEK 9,500m"),
    ("SMALL", "Distributing (annual)", "EUR 0.80bn"),
    ("STANDARD", "Accumulating", "EUR 1.40bn"),
    ("MEDIUM", "Distributing (semi-annual)", "n/a"),
    ("LARGE", "Accumulating", "EUR 950m"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def universe(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(UNIVERSE)]
    return spark.createDataFrame(rows, "ord int, instrument string, currency string, grp string, policy double")


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FACTS), "instrument string, income string, size string")


def whole_months(rows: DataFrame, newest: str, column: str) -> DataFrame:
    """Rows whose ``column`` lies before the first month that ``newest``, over all rows,
    does not complete."""
    end = rows.agg(F.trunc(F.date_add(F.max(newest), 1), "MM").alias("_end"))
    return rows.join(F.broadcast(end), F.col(column) < F.col("_end")).drop("_end", newest)


def price_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, period_month, level (mean price of a unit), cut (mean discount)."""

    def build() -> DataFrame:
        line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", F.to_date("l_shipdate").alias("day"))
        sums = line.groupBy("l_partkey", month("day").alias("period_month")).agg(
            F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"), F.sum("l_discount").alias("cut"), F.count("l_discount").alias("n"), F.max("day").alias("newest")
        )
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("instrument"))
        totals = sums.join(part, "l_partkey", "left").groupBy("instrument", "period_month").agg(*[F.sum(c).alias(c) for c in ("amount", "quantity", "cut", "n")], F.max("newest").alias("newest"))
        return totals.select("instrument", "period_month", (F.col("amount") / F.col("quantity")).alias("level"), (F.col("cut") / F.col("n")).alias("cut"), "newest")

    held = once(spark, ("prices", sf_dir), build)
    return whole_months(held, "newest", "period_month").where("instrument is not null")


def rate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg, day, tax: the mean tax rate of a line status and day."""

    def build() -> DataFrame:
        leg = F.when(F.col("l_linestatus") == "F", "A").when(F.col("l_linestatus") == "O", "B")
        line = table(spark, sf_dir, "lineitem").select(leg.alias("leg"), F.to_date("l_shipdate").alias("day"), "l_tax")
        return line.groupBy("leg", "day").agg(F.avg("l_tax").alias("tax"), F.max("day").alias("newest"))

    return whole_months(once(spark, ("rates", sf_dir), build), "newest", "day").where("leg is not null")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, period_month, available_from, close, adj_close, dividend, currency, kind."""
    out = price_sums(spark, sf_dir).select(
        "instrument", "period_month", (F.col("level") * (1 - F.col("cut"))).alias("close"), F.col("level").alias("adj_close"),
        F.when(F.month("period_month") % 3 == 0, F.col("level") * F.col("cut")).otherwise(0.0).alias("dividend"),
        F.when(F.col("instrument") == "PROMO", "SEK").otherwise("EUR").alias("currency"), F.lit("price").alias("kind"),
    )
    return add_availability(out)


def segment_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor (market segment), period_month, level: the mean order total."""

    def build() -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
        sums = orders.groupBy("o_custkey", month("day").alias("period_month")).agg(F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n"), F.max("day").alias("newest"))
        customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("factor"))
        totals = sums.join(customer, "o_custkey", "left").groupBy("factor", "period_month").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("newest").alias("newest"))
        return totals.select("factor", "period_month", (F.col("total") / F.col("n")).alias("level"), "newest")

    return whole_months(once(spark, ("orders", sf_dir), build), "newest", "period_month").where("factor is not null")


def overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leg (A or B), day, pct: the daily overnight rate of either leg."""
    return rate_sums(spark, sf_dir).select("leg", "day", (F.col("tax") * 100).alias("pct"))


@dataclass(frozen=True)
class Panel:
    """The relations of one panel; ``months`` is the joined calendar."""

    prices: DataFrame
    fx: DataFrame
    factors: DataFrame
    rates: DataFrame
    cash: DataFrame
    months: DataFrame
    returns: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Panel:
    from ..operators import returns as R

    with scope():
        price, levels, rates = prices(spark, sf_dir), segment_levels(spark, sf_dir), overnight(spark, sf_dir)
        fx = levels.where("factor = 'BUILDING'").select(F.lit("SEK").alias("currency"), "period_month", (F.col("level") / 10000).alias("close"))
        factors = R.monthly_returns(levels, "factor", "level")
        cash = R.accrue_monthly(R.splice(rates, SPLICE))
        months = once(spark, ("months", sf_dir), lambda: R.joined_months(price, fx, levels, cash).coalesce(1))
        returns = once(spark, ("returns", sf_dir), lambda: R.excess_table(price, fx, cash, months).coalesce(1))
        return Panel(price, fx, factors, rates, cash, months, returns)
