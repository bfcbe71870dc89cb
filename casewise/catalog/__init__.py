"""Named queries over the given tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

import importlib

from casewise.catalog.registry import ORACLES, QUERIES

for _area in (
    "rows",
    "joins",
    "times",
    "summaries",
    "values",
    "rule_flags",
    "information_value",
    "matrices",
    "cluster_quality",
    "scoring",
    "case_labels",
    "case_features",
    "case_sets",
):
    importlib.import_module(f"casewise.catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
