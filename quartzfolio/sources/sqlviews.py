"""The panel as SQL views: coverage, the as-of rule and returns stated a second time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataStop
from ..operators.calendar import cutoff

#: Views of a panel and the columns each must have (fixed values); raw legs are optional.
RAW_LEGS = {"leg_a": ("day", "pct"), "leg_b": ("day", "pct")}
#: The excess returns as one statement over raw legs, in words that Spark and other
#: engines share: splice of the rate legs, monthly compounding, the gate on what was
#: available at a moment, the declared window, translation and excess. Its places are
#: names of relations ({prices}, {fx}, {leg_a}, {leg_b}) and dates.
RETURNS = """WITH rate AS (
    SELECT day, pct FROM {leg_a} WHERE day < DATE '{splice}' UNION ALL SELECT day, pct FROM {leg_b} WHERE day >= DATE '{splice}'
), cash AS (
    SELECT CAST(date_trunc('month', day) AS DATE) AS period_month, exp(sum(ln(1 + pct / 100 / 360))) - 1 AS rf FROM rate
    GROUP BY CAST(date_trunc('month', day) AS DATE) HAVING max(day) < CAST(date_trunc('month', DATE '{when}') AS DATE)
), moved AS (
    SELECT instrument, currency, period_month, adj_close / lag(adj_close) OVER (PARTITION BY instrument ORDER BY period_month) - 1 AS local FROM {prices}
    WHERE period_month < CAST(date_trunc('month', DATE '{when}') AS DATE) AND period_month BETWEEN DATE '{start}' AND DATE '{end}'
), quoted AS (
    SELECT currency, period_month, close / lag(close) OVER (PARTITION BY currency ORDER BY period_month) - 1 AS fx FROM {fx}
    WHERE period_month < CAST(date_trunc('month', DATE '{when}') AS DATE) AND period_month BETWEEN DATE '{start}' AND DATE '{end}'
)
SELECT m.instrument, m.currency, m.period_month, m.local, q.fx, c.rf,
    CASE WHEN m.currency = 'EUR' THEN m.local ELSE (1 + m.local) / (1 + q.fx) - 1 END - c.rf AS excess
FROM moved m LEFT JOIN quoted q ON q.currency = m.currency AND q.period_month = m.period_month JOIN cash c ON c.period_month = m.period_month
WHERE m.local IS NOT NULL"""

LEGS = {"prices": ("instrument", "period_month", "adj_close", "currency"), "fx": ("currency", "period_month", "close"), "cash": ("period_month", "rf")}


class Views:
    """Temporary views of a panel's legs, under names of their own."""

    def __init__(self, **legs: DataFrame):
        for name, columns in LEGS.items():
            if name not in legs:
                raise DataStop("missing leg", name)
            if absent := [c for c in columns if c not in legs[name].columns]:
                raise DataStop("missing column", f"{name}: {', '.join(absent)}")
        for name, columns in RAW_LEGS.items():
            if name in legs and (absent := [c for c in columns if c not in legs[name].columns]):
                raise DataStop("missing column", f"{name}: {', '.join(absent)}")
        mark = uuid.uuid4().hex
        self.spark, self.names = legs["prices"].sparkSession, {name: f"{name}_{mark}" for name in legs}
        for name, frame in legs.items():
            frame.createOrReplaceTempView(self.names[name])

    def sql(self, text: str, **values) -> DataFrame:
        return self.spark.sql(text.format(**self.names), args=values)

    def as_of(self, when) -> DataFrame:
        """Rows of the price leg available at ``when``."""
        return self.sql("SELECT * FROM {prices} WHERE period_month < trunc(CAST(:day AS DATE), 'MM')", day=str(cutoff(when)))

    def coverage(self, when) -> DataFrame:
        """instrument, first, last, months, visible."""
        return self.sql(
            """SELECT instrument, min(period_month) AS first, max(period_month) AS last, count(*) AS months,
                count_if(period_month < trunc(CAST(:day AS DATE), 'MM')) AS visible
            FROM (SELECT DISTINCT instrument, period_month FROM {prices}) GROUP BY instrument""",
            day=str(cutoff(when)),
        )

    def statement(self, splice: str, when, start: str, end: str) -> DataFrame:
        """``RETURNS`` over the raw legs as it stood at ``when``."""
        if absent := [n for n in RAW_LEGS if n not in self.names]:
            raise DataStop("missing leg", ", ".join(absent))
        return self.spark.sql(RETURNS.format(**self.names, splice=splice, when=cutoff(when), start=start, end=end))

    def returns(self) -> DataFrame:
        """period_month, instrument, excess on the joined months."""
        return self.sql("""
            WITH months AS (SELECT DISTINCT period_month FROM {prices} INTERSECT SELECT period_month FROM {fx} INTERSECT SELECT period_month FROM {cash}),
            fxret AS (SELECT currency, period_month, close / lag(close) OVER (PARTITION BY currency ORDER BY period_month) - 1 AS fx FROM {fx}),
            moved AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY instrument ORDER BY period_month) - 1 AS local FROM {prices}
                WHERE period_month IN (SELECT period_month FROM months))
            SELECT m.period_month, m.instrument, (1 + local) * CASE WHEN m.currency = 'EUR' THEN 1.0 ELSE 1 / (1 + fx) END - 1 - rf AS excess
            FROM moved m LEFT JOIN fxret f ON f.currency = m.currency AND f.period_month = m.period_month LEFT JOIN {cash} c ON c.period_month = m.period_month
            WHERE local IS NOT NULL""")


def coverage_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """instruments, months and differences of two coverage tables (instrument, first,
    last, months); an instrument that only one has is a difference."""
    keys = ("first", "last", "months")
    a = left.select("instrument", *[F.col(c).alias(f"a_{c}") for c in keys])
    b = right.select("instrument", *[F.col(c).alias(f"b_{c}") for c in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    rows = a.join(b, "instrument", "full_outer").withColumn("same", same)
    out = rows.agg(F.count("a_first").alias("instruments"), F.sum("a_months").alias("months"), F.count_if(~F.col("same")).alias("differences"))
    return out.withColumn("agrees", F.col("differences") == 0)
