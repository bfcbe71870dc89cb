"""Filters, flags and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["case_label", "cohort_filter", "in_codes", "is_not_value", "on_days", "within_days"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bind(col: Column, build: Callable[[Column], Column]) -> Column:
    """``build(col)`` with ``col`` evaluated once, however often ``build`` uses it."""
    return F.get(F.transform(F.array(col), build), F.lit(0))


def within_days(start: str | Column, end: str | Column, days: int) -> Column:
    """1 if ``end`` is no later than ``days`` after ``start``; 0 otherwise or if either is NULL.

    One-sided: an ``end`` before ``start`` also counts.
    """
    gap = F.date_diff(_c(end).cast("date"), _c(start).cast("date"))
    return F.when(gap <= days, 1).otherwise(0)


def case_label(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First rule whose condition holds gives the label; ``default`` may be a column."""
    if not rules:
        raise ValueError("case_label needs at least one rule")
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, label if isinstance(label, Column) else F.lit(label))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def in_codes(col: str | Column, codes: Sequence) -> Column:
    return _c(col).isin(list(codes))


def is_not_value(col: str | Column, value) -> Column:
    """True for a different value and for NULL."""
    return ~_c(col).eqNullSafe(F.lit(value))


def on_days(col: str | Column, lo, hi) -> Column:
    """Dated from day ``lo`` to day ``hi``. The column is compared as it is, so that the
    filter can reach the scan and prune files."""
    first, after = F.lit(lo).cast("date"), F.date_add(F.lit(hi).cast("date"), 1)
    return (_c(col) >= first) & (_c(col) < after)


def cohort_filter(
    created: str | Column, approved: str | Column, lo, hi, months: int = 3
) -> Column:
    """Created in [lo, hi], or approved in [lo, hi] within ``months`` of creation;
    and approved (or, failing that, created) by ``hi``."""
    made, ok = _c(created).cast("date"), _c(approved).cast("date")
    late = on_days(approved, lo, hi) & ok.between(made, F.add_months(made, months))
    return (F.coalesce(ok, made) <= F.lit(hi).cast("date")) & (on_days(created, lo, hi) | late)
