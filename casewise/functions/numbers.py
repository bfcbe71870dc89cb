"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise.functions.predicates import _c

__all__ = [
    "band",
    "clip",
    "count_band",
    "log_loss_pos",
    "round_even",
    "row_max",
    "row_min",
    "row_sum",
    "scale",
    "sigmoid",
]


def clip(col: str | Column, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (bare ``greatest`` would turn it into the bound)."""
    x = _c(col)
    bounded = x if lo is None else F.greatest(x, F.lit(lo))
    bounded = bounded if hi is None else F.least(bounded, F.lit(hi))
    return F.when(x.isNotNull(), bounded)


def band(
    col: str | Column,
    bands: Sequence[tuple[float, bool, str]],
    top: str,
    missing: str = "Undefined",
) -> Column:
    """Label by ascending ``(upper, inclusive, label)`` bands, then ``top``."""
    x = _c(col)
    chain = F.when(x.isNull(), missing)
    for upper, inclusive, label in bands:
        chain = chain.when(x <= upper if inclusive else x < upper, label)
    return chain.otherwise(top)


def count_band(col: str | Column, top: int = 3, missing: str = "Undefined") -> Column:
    """``1`` … ``top - 1`` as text, ``top+`` from there, ``missing`` for NULL and below 1."""
    x = _c(col)
    chain = F.when(x >= top, f"{top}+")
    for value in range(1, top):
        chain = chain.when(x == value, str(value))
    return chain.otherwise(missing)


def round_even(col: str | Column, digits: int = 0) -> Column:
    return F.bround(_c(col), digits)


def row_max(*cols: str | Column) -> Column:
    cs = [_c(c) for c in cols]
    return F.greatest(*cs) if len(cs) > 1 else cs[0]


def row_min(*cols: str | Column) -> Column:
    cs = [_c(c) for c in cols]
    return F.least(*cs) if len(cs) > 1 else cs[0]


def row_sum(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def scale(col: str | Column, lo: float, hi: float, reverse: bool = False) -> Column:
    """Min-max scale with fixed bounds; values outside them are not clipped."""
    unit = (_c(col) - lo) / float(hi - lo)
    return 1 - unit if reverse else unit


def sigmoid(col: str | Column, floor: float = -709.0, cap: float = 709.0) -> Column:
    x = _c(col)
    return 1 / (1 + F.exp(-clip(x, floor, cap)))


def log_loss_pos(label: str | Column, prob: str | Column, eps: float = 1e-10) -> Column:
    """Aggregate: cross entropy of the positive rows only, probabilities kept off 0 and 1."""
    return -F.sum(_c(label) * F.ln(clip(prob, eps, 1 - eps)))
