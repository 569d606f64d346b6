"""The package by groups: the contract a panel has to meet, and five entry points.

``GROUPS`` names each group's modules; ``LAYERS`` the queries that show what a group
does. ``main`` runs a layer over a folder of tables, prints a line for each result and
gives the results back.
"""

from __future__ import annotations

import importlib
from types import ModuleType, SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from .errors import Refusal

VERSION = "0.3"
#: Groups and their modules, the contract first.
GROUPS = {
    "contract": ("sources.snapshot", "sources.archives", "sources.loader", "sources.panel", "sources.sqlviews", "operators.calendar", "operators.quality"),
    "factor_exposures": ("plans.factors", "plans.components", "functions.arrays"),
    "risk_models": ("plans.components", "operators.attribution"),
    "construction": ("functions.kernels", "operators.rebalance", "operators.labels", "plans.backtest"),
    "evaluation": ("operators.calendar", "operators.metrics", "operators.verdicts", "plans.draws", "plans.study"),
    "attribution": ("operators.attribution", "plans.factors", "plans.analysis"),
}
#: Queries that show a group.
LAYERS = {
    "contract": ("coverage", "returns", "sql_returns", "returns_agreement", "quality_stops"),
    "factor_exposures": ("rolling_factor_fit", "regression_f_tests", "principal_components", "grs_directions", "fama_macbeth"),
    "risk_models": ("covariance_estimators", "rolling_covariance"),
    "construction": ("quadratic_targets", "rebalanced_books", "grid_books"),
    "evaluation": ("walk_forward_record", "metric_block", "rank_retention_table", "effective_tests", "study_rows"),
    "attribution": ("linked_effects", "factor_attribution", "risk_contributions", "risk_budget"),
}


def group(name: str) -> SimpleNamespace:
    """A group's modules under their last names."""
    if name not in GROUPS:
        raise Refusal(f"no group {name}; there are {', '.join(GROUPS)}")
    modules: dict[str, ModuleType] = {m.rsplit(".", 1)[1]: importlib.import_module(f"{__package__}.{m}") for m in GROUPS[name]}
    return SimpleNamespace(**modules)


def main(spark: SparkSession, sf_dir: str, layer: str) -> dict[str, DataFrame]:
    """Prints ``[layer] query: rows, columns`` for each query of a layer; returns them by name."""
    from .queries import QUERIES

    if layer not in LAYERS:
        raise Refusal(f"no layer {layer}; there are {', '.join(LAYERS)}")
    out = {name: QUERIES[name](spark, sf_dir) for name in LAYERS[layer]}
    for name, frame in out.items():
        print(f"[{layer}] {name}: {frame.count()} rows of {', '.join(frame.columns)}")
    return out
