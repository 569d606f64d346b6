"""Spark-first analytics for monthly multi-asset panels.

``facade.GROUPS`` lists the entry groups and their modules, ``queries`` holds the
registry of queries, ``plans.analysis.analyse`` runs a study as one call.
"""

from .facade import GROUPS, VERSION

__all__ = ["GROUPS", "VERSION"]
