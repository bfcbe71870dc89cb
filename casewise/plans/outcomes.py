"""Outcome analysis of a decision spine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.operators.frames import group_stats, monthly_trend, share_of_total, value_share
from casewise.operators.stats import spearman


def outcome_report(
    spine: DataFrame,
    ts: str,
    labels: Sequence[str],
    reason: str,
    trends: Mapping[str, Sequence[str]],
    outcome: str = "decision_outcome",
    group_by: Sequence[str] = ("decision", "decision_outcome", "is_approved"),
    only: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The report's tables by name, or those in ``only``.

    ``trends`` maps a label to the outcomes its monthly mean is taken over.
    """

    def trend_rate(label: str, arms: Sequence[str]) -> Column:
        return F.avg(F.when(F.col(outcome).isin(list(arms)), F.col(label)))

    tables: dict[str, Callable[[], DataFrame]] = {
        "label_rates": lambda: spine.agg(*[F.bround(F.avg(c) * 100, 2).alias(c) for c in labels]),
        "label_ranks": lambda: spearman(spine, labels),
        "trend": lambda: monthly_trend(spine, ts, {f"{label}_rate": trend_rate(label, a) for label, a in trends.items()}),
    }
    for key in group_by:
        tables[f"rates_by_{key}"] = lambda key=key: group_stats(spine, [key], labels, ["avg"])
    for label in labels:
        tables[f"reasons_{label}"] = lambda label=label: value_share(spine, reason, F.col(label) == 1)
    for label in labels[1:]:
        tables[f"share_{labels[0]}_{label}"] = lambda label=label: share_of_total(spine, labels[0], label)
    return {name: tables[name]() for name in (only or tables)}
