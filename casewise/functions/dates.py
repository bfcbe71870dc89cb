"""Date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise.functions.predicates import _c

__all__ = [
    "days_between",
    "mean_months",
    "mean_years",
    "month_diff",
    "month_key",
    "year_boundaries",
]

# Mean Gregorian month and year in days.
MONTH_DAYS = 30.436875
YEAR_DAYS = 365.2425


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.date_diff(_c(end).cast("date"), _c(start).cast("date"))


def year_boundaries(start: str | Column, end: str | Column) -> Column:
    """Number of New Years crossed, not whole years elapsed."""
    return F.year(_c(end)) - F.year(_c(start))


def mean_months(start: str | Column, end: str | Column) -> Column:
    return days_between(start, end) / F.lit(MONTH_DAYS)


def mean_years(start: str | Column, end: str | Column) -> Column:
    return days_between(start, end) / F.lit(YEAR_DAYS)


def month_key(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def month_diff(later: str | Column, earlier: str | Column) -> Column:
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
