"""Risk levels: mapping codes and keeping the worst of several."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise.functions.predicates import _c

__all__ = ["LEVELS", "map_array", "map_codes", "worst_in_array", "worst_level"]

# Levels from worst to best; anything else is Undefined.
LEVELS = ("High", "Medium", "Low")
UNDEFINED = "Undefined"


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_codes(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Code to category by a short caller-supplied dictionary. Use a join for long ones."""
    found = F.try_element_at(_lookup(mapping), _c(col))
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def map_array(col: str | Column, mapping: Mapping, default: str = UNDEFINED) -> Column:
    table = _lookup(mapping)
    return F.transform(_c(col), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(default)))


def worst_level(*cols: str | Column) -> Column:
    """High if any column is High, then Medium, then Low, else Undefined."""
    chain = F
    for level in LEVELS:
        hit = F.lit(False)
        for c in cols:
            hit = hit | _c(c).eqNullSafe(F.lit(level))
        chain = chain.when(hit, level)
    return chain.otherwise(UNDEFINED)


def worst_in_array(col: str | Column) -> Column:
    chain = F
    for level in LEVELS:
        chain = chain.when(F.coalesce(F.array_contains(_c(col), level), F.lit(False)), level)
    return chain.otherwise(UNDEFINED)
