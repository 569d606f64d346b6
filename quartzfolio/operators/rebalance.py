"""Traded books from targets: an ordered fold over a run's months, in the JVM.

A step reads the book before it, so a run's months are one array and one fold; runs are
independent rows. The array holds a vector of weights for each month, a size the panel
gives and the fact tables don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as L

#: No-trade band a sleeve, and the most one-way turnover of a step (fixed values).
BAND, TURNOVER_CAP = 0.01, 0.05
#: Rounding that a trade may lie beyond the cap by and still be one of the cap's size: two
#: targets at the bounds are the cap apart to the last digits.
EDGE = 1e-9
_STEP = "struct<book:array<double>,turnover:double,movement:double,turnover_binding:boolean,untaken:double,funding:double>"


def distance(a: Column, b: Column) -> Column:
    """One-way turnover between two books: half of the sum of absolute changes."""
    return L.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2


def step(target: Column, held: Column, cap: Column, band: float = BAND, most: float = TURNOVER_CAP) -> Column:
    """One rebalance: sleeves that would move by the band or less keep their holding, the
    result is brought back to the constraint set (``funding``: how far that moved it), and
    a trade beyond ``most`` is scaled down as a whole (``untaken``: what was left). A trade
    of ``most`` itself, give or take ``EDGE``, is made whole."""
    banded = F.zip_with(target, held, lambda t, h: F.when(F.abs(t - h) > band, t).otherwise(h))

    def traded(z: Column) -> Column:
        bound = z["wanted"] > most + EDGE
        scale = F.when(bound, most / z["wanted"]).otherwise(1.0)
        book = F.zip_with(z["aim"], held, lambda a, h: F.when(bound, h + (a - h) * scale).otherwise(a))
        took = F.least(z["wanted"], F.lit(most))
        left = F.when(bound, z["wanted"] - took).otherwise(0.0)
        return F.struct(book.alias("book"), took.alias("turnover"), took.alias("movement"), bound.alias("turnover_binding"), left.alias("untaken"), z["funding"].alias("funding"))

    def funded(b: Column) -> Column:
        return L.let(L.capped_simplex(b, cap), lambda aim: L.let(F.struct(aim.alias("aim"), distance(aim, held).alias("wanted"), (2 * distance(aim, b)).alias("funding")), traded))

    return L.let(banded, funded).cast(_STEP)


def fold(targets: DataFrame, band: float = BAND, most: float = TURNOVER_CAP, key: str = "run_id") -> DataFrame:
    """Every month's book of (key, traded, instrument, ord, target, cap), with turnover,
    movement, turnover_binding, untaken and funding. The first month is funded at its
    target, outside the measured trades: no turnover and no movement. A month whose
    sleeves are not those of the month before raises: its book could not be carried."""
    months = targets.groupBy(key, "traded").agg(F.array_sort(F.collect_list(F.struct("ord", "instrument", "target"))).alias("m"), F.first("cap").alias("cap"))
    months = months.select(key, "cap", F.struct("traded", F.col("m.instrument").alias("names"), F.col("m.ord").alias("ord"), F.col("m.target").cast(L.VECTOR).alias("target")).alias("m"))
    runs = months.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("months"), F.first("cap").alias("cap"))
    cap = F.col("cap")
    first = lambda m: F.struct(m["target"].alias("book"), F.lit(0.0).alias("turnover"), F.lit(None).cast("double").alias("movement"), F.lit(False).alias("turnover_binding"), F.lit(0.0).alias("untaken"), F.lit(0.0).alias("funding")).cast(_STEP)
    start = F.struct(F.lit(None).cast("array<string>").alias("names"), F.array().cast(f"array<{_STEP}>").alias("out"))

    def advance(acc: Column, m: Column) -> Column:
        same = F.when(acc["names"].isNull() | (acc["names"] == m["names"]), m["target"]).otherwise(F.raise_error(F.lit("the book held does not cover the sleeves of the target")).cast(L.VECTOR))
        here = F.when(acc["names"].isNull(), first(m)).otherwise(L.let(F.try_element_at(acc["out"], F.lit(-1))["book"], lambda held: step(same, held, cap, band, most)))
        return F.struct(m["names"].alias("names"), F.concat(acc["out"], F.array(here)).alias("out"))

    held = F.aggregate("months", start, advance, lambda acc: acc["out"])
    steps = runs.withColumn("out", held).select(key, "cap", F.explode(F.arrays_zip("months", "out")).alias("s"))
    cells = F.arrays_zip(F.col("s.months.names").alias("instrument"), F.col("s.months.ord").alias("ord"), F.col("s.months.target").alias("target"), F.col("s.out.book").alias("book"))
    rows = steps.select(key, F.col("s.months.traded").alias("traded"), F.explode(cells).alias("c"), "s.out.turnover", "s.out.movement", "s.out.turnover_binding", "s.out.untaken", "s.out.funding", "cap")
    return rows.select(key, "traded", "c.*", "turnover", "movement", "turnover_binding", "untaken", "funding", "cap")
