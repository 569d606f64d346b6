"""Return legs: splices, accruals, currency split, excess table, factor legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal
from .labels import one_value


def total_return(prices: DataFrame, value: str | Column = "adj_close", key: str = "instrument") -> DataFrame:
    """Adds local: the change against the month before in the instrument's own order."""
    order = Window.partitionBy(key).orderBy("period_month")
    level = F.col(value) if isinstance(value, str) else value
    return prices.withColumn("local", level / F.lag(level).over(order) - 1)


def recomputed_total_return(prices: DataFrame, key: str = "instrument") -> DataFrame:
    """Adds rebuilt: price and dividend against the last price."""
    order = Window.partitionBy(key).orderBy("period_month")
    return prices.withColumn("rebuilt", (F.col("close") + F.coalesce("dividend", F.lit(0.0))) / F.lag("close").over(order) - 1)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def splice(rates: DataFrame, at: str) -> DataFrame:
    """day, pct: leg A before the date, leg B from it on."""
    day = F.lit(at).cast("date")
    return rates.where(((F.col("leg") == "A") & (F.col("day") < day)) | ((F.col("leg") == "B") & (F.col("day") >= day))).select("day", "pct")


def splice_basis(rates: DataFrame) -> DataFrame:
    """basis_bp and overlap_days of the two legs; refuses legs that never meet."""
    a, b = (rates.where(F.col("leg") == x).select("day", F.col("pct").alias(x)) for x in "AB")
    out = a.join(b, "day").agg(F.avg(F.col("A") - F.col("B")).alias("mean"), F.count("*").alias("overlap_days"))
    met = F.when(F.col("overlap_days") > 0, F.col("mean") * 100).otherwise(F.raise_error(F.lit("the two rate legs do not overlap")).cast("double"))
    return out.select(met.alias("basis_bp"), "overlap_days")


def accrue_monthly(rate: DataFrame) -> DataFrame:
    """period_month, rf: the days present, compounded on 360."""
    days = rate.groupBy(F.trunc("day", "MM").alias("period_month"))
    return days.agg((F.product(1 + F.col("pct") / 100 / 360) - 1).alias("rf"))


def monthly_last(rate: DataFrame) -> DataFrame:
    return rate.groupBy(F.trunc("day", "MM").alias("period_month")).agg(F.max_by("pct", "day").alias("level"))


def monthly_returns(levels: DataFrame, key: str, value: str) -> DataFrame:
    """key, period_month, ret; the first month of a key is dropped."""
    order = Window.partitionBy(key).orderBy("period_month")
    ret = F.col(value) / F.lag(value).over(order) - 1
    return levels.select(key, "period_month", ret.alias("ret")).where("ret is not null")


def translate(local: Column, fx: Column) -> Column:
    """A foreign return in the base currency, fx quoted in foreign units."""
    return (1 + local) / (1 + fx) - 1


def eur_translate(factors: DataFrame, fx: DataFrame) -> DataFrame:
    """Adds eur; a month without fx raises when it is read."""
    rate = monthly_returns(fx, "currency", "close").select("period_month", F.col("ret").alias("fx"))
    known = F.coalesce(F.col("fx"), F.raise_error(F.lit("a factor month has no exchange rate")).cast("double"))
    return factors.join(rate, "period_month", "left").withColumn("eur", translate(F.col("ret"), known))


def joined_months(*legs: DataFrame) -> DataFrame:
    """Months that every leg has; nothing is filled."""
    return reduce(lambda a, b: a.join(b, "period_month", "left_semi"), [x.select("period_month").distinct() for x in legs])


def currency_split(prices: DataFrame, fx: DataFrame, base: str = "EUR") -> DataFrame:
    """instrument, period_month, currency, local, translation, euro (null without fx)."""
    rate = monthly_returns(fx, "currency", "close").select("currency", "period_month", F.col("ret").alias("fx"))
    rows = total_return(prices).where("local is not null").join(rate, ["currency", "period_month"], "left")
    translation = F.when(F.col("currency") == base, 0.0).otherwise(1 / (1 + F.col("fx")) - 1)
    rows = rows.withColumn("translation", translation)
    return rows.select("instrument", "period_month", "currency", "local", "translation", ((1 + F.col("local")) * (1 + F.col("translation")) - 1).alias("euro"))


def excess_table(prices: DataFrame, fx: DataFrame, cash: DataFrame, months: DataFrame) -> DataFrame:
    """The return table: currency split, cash and excess on the joined months.

    The panel's first month has no return and is left out. Any other month that an
    instrument, a rate or a quote lacks raises when it is read: a return across a hole
    would be an invented one.
    """
    held = prices.join(months, "period_month", "left_semi")
    split = currency_split(held, fx)
    size = F.broadcast(months.agg(F.countDistinct("period_month").alias("_months")))  # one row
    rows = split.join(cash, "period_month", "left").withColumn("excess", F.col("euro") - F.col("rf"))
    rows = rows.withColumn("_held", F.count("*").over(Window.partitionBy("instrument"))).crossJoin(size)
    refuse = lambda why: F.raise_error(F.concat("instrument", F.lit(" "), F.col("period_month").cast("string"), F.lit(why))).cast("double")
    excess = F.when(F.col("_held") != F.col("_months") - 1, refuse(": the instrument's months are not the panel's")).when(F.col("excess").isNull(), refuse(": no return can be computed"))
    rows = rows.withColumn("excess", excess.otherwise(F.col("excess")))
    return rows.select("period_month", "instrument", "currency", "local", "translation", "euro", "rf", "excess")


def wide(rows: DataFrame, names: list[str], value: str, name: str = "instrument") -> DataFrame:
    """One column a name; two values for a cell raise when they are read."""
    cell = F.when(F.count(value) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("two values for one cell")).cast("double"))
    return rows.groupBy("period_month").pivot(name, names).agg(cell)


def constructed_block(rows: DataFrame, long: str, short: str, credit: str, high_yield: str, value: str = "excess") -> DataFrame:
    """level, slope, credit and high-yield combinations of four named sleeves; a month
    without one of them raises when it is read."""
    lacks = lambda n: F.raise_error(F.concat(F.lit(f"the block needs {n} in "), F.first("period_month").cast("string"))).cast("double")
    x = {k: F.coalesce(one_value(value, "instrument", n), lacks(n)) for k, n in (("l", long), ("s", short), ("c", credit), ("h", high_yield))}
    return rows.groupBy("period_month").agg(
        ((x["l"] + x["s"]) / 2).alias("level"), (x["l"] - x["s"]).alias("slope"), (x["c"] - x["l"]).alias("credit"), (x["h"] - x["c"]).alias("high_yield")
    )


def named_set(spine: DataFrame, block: DataFrame) -> DataFrame:
    """Inner join on months; a null cell raises when it is read."""
    out = spine.join(block, "period_month")
    return out.select("period_month", *[F.coalesce(F.col(c), F.raise_error(F.lit(f"a gap in {c}")).cast("double")).alias(c) for c in out.columns if c != "period_month"])


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """cells, mismatches (a value on one side only counts), worst difference."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    bad = (F.col("a").isNull() != F.col("b").isNull()) | (gap > tolerance)
    return a.join(b, keys, "full_outer").agg(F.count("*").alias("cells"), F.count_if(bad).alias("mismatches"), F.max(gap).alias("worst"))


def refuse_unless(condition: bool, message: str) -> None:
    if not condition:
        raise Refusal(message)
