"""The pre-registered grid as two Spark phases: parallel targets, ordered books.

A target depends on its own window alone, so phase one is one grouped map over
(estimator, protocol, traded month): each group takes its covariance from a table and
solves every run that reads it. Phase two folds a run's targets in month order, in column functions. A run with any
refusal becomes a cut and has no book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import kernels as K
from ..operators import calendar as C
from ..operators.metrics import COST_BP, PERIODS
from ..operators.rebalance import BAND, TURNOVER_CAP, fold
from .draws import SEED, SHIFTS

CAP, UNCAPPED, GAMMA, CVAR_LEVEL = 0.35, 1.0, 1 / 3, 0.05

#: Scale of the prior's uncertainty, and the scales of its sensitivity (fixed values).
TAU_SCALE, TAU_SCALES = 1.0, (0.1, 1.0, 10.0)
#: The pre-registered runs: id, stage, family, estimator, mean, cap, protocol (fixed values).
RUNS = (
    ("equal_weight", "A", "equal_weight", "sample", None, CAP, "rolling"),
    ("policy", "A", "policy", "sample", None, CAP, "rolling"),
    ("mean_variance_shrunk", "A", "mean_variance", "sample", "jorion", CAP, "rolling"),
    ("minimum_variance", "A", "minimum_variance", "sample", None, CAP, "rolling"),
    ("maximum_diversification", "A", "maximum_diversification", "sample", None, CAP, "rolling"),
    ("erc_unbounded", "A", "erc", "sample", None, UNCAPPED, "rolling"),
    ("erc_bounded", "A", "erc", "sample", None, CAP, "rolling"),
    ("hierarchical_risk_parity", "A", "hierarchical_risk_parity", "sample", None, CAP, "rolling"),
    ("mean_cvar", "A", "mean_cvar", "sample", None, CAP, "rolling"),
    ("minimum_variance_shrinkage", "B", "minimum_variance", "shrinkage", None, CAP, "rolling"),
    ("minimum_variance_factor", "B", "minimum_variance", "factor", None, CAP, "rolling"),
    ("erc_shrinkage", "B", "erc", "shrinkage", None, CAP, "rolling"),
    ("erc_factor", "B", "erc", "factor", None, CAP, "rolling"),
    ("mean_variance_sample", "C", "mean_variance", "sample", "sample", CAP, "rolling"),
    ("mean_variance_black_litterman", "C", "mean_variance", "sample", "black_litterman", CAP, "rolling"),
    ("mean_variance_none", "C", "mean_variance", "sample", "none", CAP, "rolling"),
    ("minimum_variance_uncapped", "A", "minimum_variance", "sample", None, UNCAPPED, "rolling"),
    ("maximum_diversification_uncapped", "A", "maximum_diversification", "sample", None, UNCAPPED, "rolling"),
    ("mean_variance_shrunk_expanding", "A", "mean_variance", "sample", "jorion", CAP, "expanding"),
    ("minimum_variance_expanding", "A", "minimum_variance", "sample", None, CAP, "expanding"),
)
CELLS = tuple(r[0] for r in RUNS[:16])
PAIRS = {"minimum_variance": "minimum_variance_uncapped", "maximum_diversification": "maximum_diversification_uncapped", "erc_bounded": "erc_unbounded"}
ESTIMATORS = ("sample", "shrinkage", "factor")
SPEC = "run_id string, stage string, family string, estimator string, mean string, cap double, protocol string"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUNS), SPEC)


def validate(runs: tuple = RUNS) -> None:
    ids = [r[0] for r in runs]
    if len(set(ids)) != len(ids) or len(ids) != 20:
        raise Refusal("the registry needs 20 runs with different ids")
    by_id = {r[0]: r for r in runs}
    for r in runs:
        if r[2] not in K.FAMILIES or r[3] not in ESTIMATORS or r[4] not in (None, "none", "sample", "jorion", "black_litterman") or r[6] not in ("rolling", "expanding"):
            raise Refusal(f"{r[0]} names an axis value that does not exist")
    for a, b in PAIRS.items():
        if [x for k, x in enumerate(by_id[a]) if k not in (0, 5)] != [x for k, x in enumerate(by_id[b]) if k not in (0, 5)]:
            raise Refusal(f"{a} and {b} differ in more than the cap")


def all_steps(months: DataFrame, size: int = 60) -> DataFrame:
    return C.steps(months, "rolling", size).unionByName(C.steps(months, "expanding", size))


def window_rows(returns: DataFrame, steps: DataFrame, universe: DataFrame) -> DataFrame:
    """protocol, traded, period_month, ord, instrument, excess of every window."""
    rows = returns.join(F.broadcast(universe.select("instrument", "ord", "policy")), "instrument")
    return C.blocks(rows.select("period_month", "ord", "instrument", "excess", "policy"), steps)


def require_observations(frame: pd.DataFrame, held: pd.Index, least: int = 59) -> None:
    """Refuses a window with a hole: only its first month may be absent, and ``least``
    months are needed."""
    months, start = int(frame["months"].iloc[0]), frame["window_start"].iloc[0]
    if len(held) < least:
        raise Refusal(f"the window from {start} holds {len(held)} months of {least} at least")
    if months - len(held) > 1 or (months - len(held) == 1 and held[0] == start):
        raise Refusal(f"the window from {start} holds {len(held)} of its {months} months: a hole")


def _matrix(frame: pd.DataFrame, size: int = 60) -> tuple[np.ndarray, list[str], np.ndarray]:
    wide = frame.pivot(index="period_month", columns="ord", values="excess").sort_index().dropna()
    require_observations(frame, wide.index, size - 1)
    names = frame.drop_duplicates("ord").sort_values("ord")
    return wide.to_numpy(), names["instrument"].tolist(), names["policy"].to_numpy()


def _mean(kind: str | None, x: np.ndarray, cov: np.ndarray, policy: np.ndarray) -> np.ndarray:
    if kind == "jorion":
        return K.jorion(x, cov)
    if kind == "black_litterman":
        return K.black_litterman(x, cov, policy, GAMMA)
    return x.mean(0) if kind == "sample" else np.zeros(len(cov))


TARGETS = "run_id string, protocol string, traded date, instrument string, ord int, target double, intensity double, error string"


def targets(rows: DataFrame, estimates: DataFrame, runs: DataFrame, size: int = 60) -> DataFrame:
    """Phase one: a target vector, or the refusal, per run and traded month.
    ``estimates``: protocol, traded, estimator, cov, report of every window without a hole."""
    specs = [tuple(r) for r in runs.collect()]  # the declared runs
    columns = [c.split()[0] for c in TARGETS.split(", ")]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        protocol, traded, estimator = frame["protocol"].iloc[0], frame["traded"].iloc[0], frame["estimator"].iloc[0]
        own_specs = [r for r in specs if r[3] == estimator and r[6] == protocol]
        try:
            x, names, policy = _matrix(frame, size)
            if frame["cov"].iloc[0] is None:
                raise Refusal("the window has no covariance")
            cov, intensity = np.stack(frame["cov"].iloc[0]).astype(float), frame["report"].iloc[0]
        except (Refusal, np.linalg.LinAlgError) as e:
            return pd.DataFrame([(r[0], protocol, traded, None, None, None, None, str(e)) for r in own_specs], columns=columns)
        out = []
        for run_id, _, family, _, mean, cap, _ in own_specs:
            try:
                options = {"norm": len(names) ** -0.5} if mean == "none" else {}
                w = K.FAMILIES[family](cov, _mean(mean, x, cov, policy), x, cap, policy, **options)
                out += [(run_id, protocol, traded, n, k, float(v), intensity, None) for k, (n, v) in enumerate(zip(names, w, strict=True))]
            except (Refusal, np.linalg.LinAlgError) as e:
                out.append((run_id, protocol, traded, None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=columns)

    kinds = runs.select("estimator", "protocol").distinct()
    met = rows.join(F.broadcast(kinds), "protocol").join(estimates, ["protocol", "traded", "estimator"], "left")
    return met.groupBy("estimator", "protocol", "traded").applyInPandas(solve, TARGETS)


def books(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Phase two: the traded book of every uncut run, month after month."""
    cut = found.where("error is not null").select("run_id").distinct()
    rows = found.join(F.broadcast(cut), "run_id", "left_anti").join(F.broadcast(runs.select("run_id", "cap")), "run_id")
    return fold(rows.select("run_id", "traded", "instrument", "ord", "target", "cap"), BAND, TURNOVER_CAP)


def cuts(found: DataFrame) -> DataFrame:
    return found.where("error is not null").groupBy("run_id").agg(F.min_by("error", "traded").alias("reason"), F.min("traded").alias("first"))


def series(path: DataFrame, returns: DataFrame, value: str = "excess") -> DataFrame:
    """run_id, traded, gross, net, turnover and binding counts."""
    rows = path.join(returns.select(F.col("period_month").alias("traded"), "instrument", value), ["traded", "instrument"])
    out = rows.groupBy("run_id", "traded").agg(
        F.sum(F.col("book") * F.col(value)).alias("gross"), F.first("turnover").alias("turnover"), F.first("movement").alias("movement"),
        F.count_if(F.col("book") > F.col("cap") - 1e-9).alias("at_cap"), F.first("turnover_binding").alias("turnover_binding"),
        (1 / F.sum(F.col("target") * F.col("target"))).alias("concentration"), (1 / F.sum(F.col("book") * F.col("book"))).alias("concentration_traded"),
        F.max("target").alias("largest"), F.max("book").alias("largest_traded"),
    )
    return out.withColumn("net", F.col("gross") - 2 * F.col("turnover") * COST_BP / 1e4)


def establishment(path: DataFrame) -> DataFrame:
    """The one trade that funds a run, outside the measured window, and its cost."""
    first = path.withColumn("_n", F.dense_rank().over(Window.partitionBy("run_id").orderBy("traded"))).where("_n = 1")
    out = first.groupBy("run_id").agg((F.sum(F.abs("target")) / 2).alias("turnover"))
    return out.withColumn("cost", 2 * F.col("turnover") * COST_BP / 1e4)


def summary(rows: DataFrame) -> DataFrame:
    """Per run, what its path did."""
    return rows.groupBy("run_id").agg(
        F.count("*").alias("steps"), (F.avg("turnover") * PERIODS).alias("turnover_annualised"), (2 * F.avg("turnover") * COST_BP / 1e4 * PERIODS).alias("cost_annualised"),
        F.avg("at_cap").alias("cap_binding_frequency"), F.count_if(F.col("at_cap") > 0).alias("cap_binding_steps"), F.count_if("turnover_binding").alias("turnover_cap_binding_steps"),
        F.avg("concentration").alias("concentration"), F.avg("concentration_traded").alias("concentration_traded"), F.max("largest").alias("largest_weight"),
        F.max("largest_traded").alias("largest_weight_traded"), F.coalesce(F.avg("movement"), F.lit(0.0)).alias("weight_stability"), (F.product(1 + F.col("gross")) - 1).alias("gross_cumulative"),
        (F.product(1 + F.col("net")) - 1).alias("net_cumulative"),
    )


def records(runs: DataFrame, found: DataFrame, stamp: dict[str, str], size: int = 60) -> DataFrame:
    """What a rerun needs of every run: its settings, its months, why it was cut if it
    was, the rules that all runs share, what a Black-Litterman mean was made of, and the
    ``stamp`` of data and code."""
    seen = found.groupBy("run_id").agg(F.min("traded").alias("first_traded"), F.max("traded").alias("last_traded"), F.countDistinct("traded").alias("steps"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("traded"))).alias("cut"))
    rules = {"band": BAND, "turnover_cap": TURNOVER_CAP, "gamma": GAMMA, "cvar_level": CVAR_LEVEL, "cost_bp": COST_BP, "seed": SEED, "null_draws": SHIFTS}
    view = F.struct(
        F.lit("returns that the policy weights imply, reversed at gamma").alias("prior"), F.lit("one a sleeve, at the window's mean").alias("view"), F.lit("the sleeve's variance over the months").alias("view_uncertainty"),
        F.lit(TAU_SCALE / size).alias("tau"), F.lit(TAU_SCALE).alias("tau_scale"), F.lit(1.0).alias("omega_scale"), F.lit(list(TAU_SCALES)).alias("sensitivity_tau_scale"),
    )
    convention = F.when(F.col("mean") == "black_litterman", view).alias("black_litterman")
    return runs.join(seen, "run_id", "left").select("*", convention, *[F.lit(v).alias(k) for k, v in (rules | stamp).items()])


def write_manifests(records: DataFrame, path: str) -> None:
    """One JSON line per run under a folder of its own."""
    records.write.mode("overwrite").partitionBy("run_id").json(path)


def grouped(rows: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    """A kernel over each window's matrix: ``kernel(x, names)`` gives rows of tuples.
    A window with a hole, or one the kernel refuses, raises."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, instruments, _ = _matrix(frame)
        head = tuple(frame[k].iloc[0] for k in keys)
        return pd.DataFrame([(*head, *row) for row in kernel(x, instruments)], columns=names)

    return rows.groupBy(*keys).applyInPandas(run, schema)

