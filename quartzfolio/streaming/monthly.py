"""The availability rule on a stream: days that close, with the month they count for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_months(stream: DataFrame, stamp: str, key: str, value: str, late: str = "5 days") -> DataFrame:
    """key, period_month, available_from, day, total, n per key and day of ``stamp``, with
    the month that the day counts for and the day that month becomes readable.

    A month has no fixed length, so windows are days, under a watermark: state stays
    bounded and a row later than ``late`` is dropped; a batch frame gives the same
    totals. The sum of a month's days is one more grouping where the rows are read.
    """
    days = stream.withWatermark(stamp, late).groupBy(F.window(stamp, "1 day").alias("day"), F.col(key))
    out = days.agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    month = F.trunc(F.to_date(F.col("day.start")), "MM")
    return out.select(key, month.alias("period_month"), F.add_months(month, 1).alias("available_from"), F.col("day.start").alias("day"), "total", "n")
