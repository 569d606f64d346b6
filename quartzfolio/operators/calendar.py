"""Months, availability and estimation windows.

A month is the date of its first day. A month's value is available from the first
day of the next month on; that rule is written as ``month < trunc(when)`` so that
it stands on the stored column and reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal


def month(column: str | Column) -> Column:
    return F.trunc(F.to_date(column), "MM")


def available_from(column: str | Column) -> Column:
    return F.add_months(column, 1)


def add_availability(frame: DataFrame, column: str = "period_month") -> DataFrame:
    return frame.withColumn(column, F.trunc(column, "MM")).withColumn("available_from", available_from(column))


def cutoff(when: dt.datetime | dt.date | str) -> dt.date:
    """The wall-clock date of a stamp; an offset is dropped, not converted."""
    if isinstance(when, str):
        when = dt.datetime.fromisoformat(when)
    return when.date() if isinstance(when, dt.datetime) else when


def as_of(frame: DataFrame, when: dt.datetime | dt.date | str, column: str = "period_month") -> DataFrame:
    """Rows available at ``when``."""
    return frame.where(F.col(column) < F.lit(cutoff(when).replace(day=1)))


def window(frame: DataFrame, start: str, end: str, column: str = "period_month") -> tuple[DataFrame, DataFrame]:
    """Rows of the declared months, and a one-row frame that counts the others."""
    inside = F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return frame.where(inside), frame.agg(F.count_if(~inside).alias("dropped"))


def month_span(frame: DataFrame, keys: list[str], column: str = "period_month") -> DataFrame:
    """first, last, months, missing per key."""
    spans = frame.groupBy(*keys).agg(F.min(column).alias("first"), F.max(column).alias("last"), F.countDistinct(column).alias("months"))
    expected = (F.months_between("last", "first") + 1).cast("long")
    return spans.withColumn("missing", expected - F.col("months"))


def gaps(frame: DataFrame, keys: list[str], column: str = "period_month") -> DataFrame:
    """Interior months a key lacks."""
    spans = frame.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    every = spans.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(column))
    return every.join(frame.select(*keys, column).distinct(), [*keys, column], "left_anti")


def numbered(months: DataFrame, column: str = "period_month") -> DataFrame:
    """Distinct months with their place from 0; one row a month."""
    return months.select(column).distinct().withColumn("pos", F.row_number().over(Window.orderBy(column)) - 1)


def steps(months: DataFrame, protocol: str = "rolling", size: int = 60, column: str = "period_month") -> DataFrame:
    """One row per traded month: the window before it, on the panel's calendar."""
    if protocol not in ("rolling", "expanding"):
        raise Refusal(f"no protocol {protocol!r}")
    every = Window.orderBy(column).rowsBetween(-size if protocol == "rolling" else Window.unboundedPreceding, -1)
    rows = numbered(months, column).withColumn("window", F.collect_list(column).over(every)).where(F.col("pos") >= size)
    end = F.element_at("window", -1)
    return rows.select(
        F.lit(protocol).alias("protocol"), F.col(column).alias("traded"), F.element_at("window", 1).alias("window_start"), end.alias("window_end"),
        F.size("window").alias("months"), available_from(end).alias("available_from"), end.alias("gated_by"), F.lit("monthly").alias("refit"), "window",
    )


def blocks(rows: DataFrame, steps_: DataFrame, column: str = "period_month") -> DataFrame:
    """The rows every step may read: an equi-join on the exploded window."""
    wanted = steps_.select("protocol", "traded", "window_start", "months", F.explode("window").alias(column))
    return wanted.join(rows, column)


def observed(steps_: DataFrame, read: DataFrame, components: DataFrame | None = None, column: str = "period_month") -> DataFrame:
    """The step records completed with what only a run knows: how many months of rows its
    window held, and the components its estimate kept (protocol, traded, retained)."""
    taken = read.groupBy("protocol", "traded").agg(F.countDistinct(column).cast("int").alias("observations"))
    out = steps_.drop("window").join(taken, ["protocol", "traded"], "left")
    if components is None:
        return out.withColumn("components", F.lit(None).cast("int"))
    return out.join(components.select("protocol", "traded", F.col("retained").cast("int").alias("components")), ["protocol", "traded"], "left")


def look_ahead(steps_: DataFrame, read: DataFrame, months: DataFrame, size: int = 60, column: str = "period_month") -> DataFrame:
    """Violations of the boundary, one row each: rule and traded month. Must be empty."""
    front = months.agg(F.min(column).alias("front"))
    count = read.groupBy("protocol", "traded").agg(F.countDistinct(column).alias("observed"), F.max(column).alias("newest"))
    rows = steps_.join(count, ["protocol", "traded"], "left").crossJoin(F.broadcast(front))
    order = Window.partitionBy("protocol").orderBy("traded")
    rules = {
        "row at or after the traded month": F.col("newest") >= F.col("traded"),
        "window does not end before the traded month": F.col("window_end") != F.add_months("traded", -1),
        "availability differs": (F.col("available_from") != F.add_months("window_end", 1)) | (F.col("available_from") > F.col("traded")),
        "window not contiguous": F.months_between("window_end", "window_start") + 1 != F.col("months"),
        "too few observations": F.coalesce(F.col("observed"), F.lit(0)) < F.col("months") - (F.col("window_start") == F.col("front")).cast("int"),
        "traded months not increasing": F.lag("traded").over(order) >= F.col("traded"),
        "window too short": F.col("months") < size,
    }
    found = rows.withColumn("rules", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return found.select("protocol", "traded", F.explode("rules").alias("rule"))
