"""Dummies, merged flags, scaling and standardising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions import row_max, scale


def scale_columns(df: DataFrame, spec: Mapping[str, tuple[str, float, float, bool]]) -> DataFrame:
    """``{out: (col, lo, hi, reverse)}`` scaled by fixed bounds."""
    return df.withColumns({out: scale(c, lo, hi, rev) for out, (c, lo, hi, rev) in spec.items()})


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]], drop: bool = True) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for a fixed level list; NULL and other levels give 0s.

    Levels are declared, never read from the data, so train and test agree.
    """
    dummies = [
        F.col(c).eqNullSafe(F.lit(level)).cast("int").alias(f"{c}_{level}") for c, ls in levels.items() for level in ls
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if not (drop and c in levels)]
    return df.select(*kept, *dummies)


def merge_flags(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """One flag that is set when any of ``cols`` is; the parts are dropped."""
    quoted = [F.col(f"`{c}`") for c in cols]
    return df.withColumn(out, row_max(*quoted)).drop(*cols)


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation; constant columns are dropped."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    live = [c for c in cols if stats[f"s_{c}"]]
    out = df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) for c in live})
    return out.drop(*[c for c in cols if c not in live])
