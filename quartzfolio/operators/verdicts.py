"""Haircut, sign rule and the verdict ladder of a comparison row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verdict vocabulary (fixed values).
IS_BENCHMARK = "the policy benchmark itself"
IS_EQUAL_WEIGHT = "the equal-weight bar itself"
IS_EXPANDING = "the expanding repeat of the rolling cell"
REPRODUCES = "negative result: the book reproduces equal weight"
NO_DIFFERENCE = "no difference detected"
BEHIND = "significantly behind the benchmark once the cost is charged"
RESAMPLING_LOST = "no difference detected: the advantage does not survive the bootstrap resampling"
NOT_UNIQUE = "the advantage clears every bar, and no cell is uniquely best: the leader's rank is not retained in bootstrap resamples"
SIGN_LOST = "no difference detected: the sign does not hold under the expanding window"
LEG_NOT_RUN = "different on the paired test; the expanding leg was not run for this cell"
CANDIDATE = "recommendation candidate"
NEGATIVE = (NO_DIFFERENCE, REPRODUCES, RESAMPLING_LOST, NOT_UNIQUE, SIGN_LOST)
RETENTION_FLOOR = 0.80


def clears(z: Column, bar: Column | float) -> Column:
    return F.coalesce(F.abs(z) >= bar, F.lit(False))


def sign_holds(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).otherwise((F.abs(a) > 1e-6) & (F.abs(b) > 1e-6) & (F.signum(a) == F.signum(b)))


def verdict() -> Column:
    """The ladder over run_id, is_repeat, reproduces, z, bar, retention, is_leader,
    leader_retention, information_ratio and expanding_sign; the first rung decides."""
    rungs = [
        (F.col("run_id") == "policy", IS_BENCHMARK),
        (F.col("run_id") == "equal_weight", IS_EQUAL_WEIGHT),
        (F.col("is_repeat"), IS_EXPANDING),
        (F.col("reproduces"), REPRODUCES),
        (~clears(F.col("z"), F.col("bar")), NO_DIFFERENCE),
        (F.col("retention") < RETENTION_FLOOR, RESAMPLING_LOST),
        (F.col("is_leader") & (F.col("leader_retention") < RETENTION_FLOOR), NOT_UNIQUE),
        (F.col("information_ratio") <= 0, BEHIND),
        (F.col("expanding_sign").isNull(), LEG_NOT_RUN),
        (~F.col("expanding_sign"), SIGN_LOST),
    ]
    out = F
    for condition, word in rungs:
        out = out.when(condition, word)
    return out.otherwise(CANDIDATE)


def negative_results(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict").isin(*NEGATIVE))


#: What the bar rests on, carried with each claim.
BAR_NOTE = "the bar is this study's own choice after the literature; no rule demands it"


def claimed(cost_bp: float = 10.0) -> Column:
    """The ingredients of a recommendation; null for every other row."""
    held = F.struct(
        F.col("z").alias("statistic"), "bar", F.col("information_ratio").alias("information_ratio_net"), F.lit(cost_bp).alias("cost_bp"),
        (F.col("cap_binding_steps") / F.col("months")).alias("cap_binding_frequency"), "cap_binding_steps", F.col("months").alias("steps"), F.lit(BAR_NOTE).alias("statement"),
    )
    return F.when(F.col("verdict") == CANDIDATE, held)
