"""Lookup joins: code lists and longest-prefix matches.

No broadcast hints: a lookup's size is the caller's, so Catalyst and AQE decide from the
measured size whether to broadcast it or to shuffle both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.frames import left_join_spread


def map_codes_join(
    df: DataFrame, col: str, lookup: DataFrame, out: str, default: str | None = None, keep_input: bool = False
) -> DataFrame:
    """Add ``out`` from a ``(code, category)`` table; unmatched rows get the input or ``default``."""
    table = lookup.select(F.col("code").alias("_code"), F.col("category").alias("_category")).distinct()
    joined = df.join(table, F.col(col) == F.col("_code"), "left")
    value = F.col("_category")
    if keep_input:
        value = F.coalesce(value, F.col(col))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return joined.withColumn(out, value).drop("_code", "_category")


def prefix_lookup(
    df: DataFrame,
    col: str,
    lookup: DataFrame,
    out: str,
    error: str | None = None,
    default: str = "Low",
    invalid: str = "Undefined",
) -> DataFrame:
    """Add the level of the longest prefix of ``col`` found in ``(code, level)``.

    Prefixes are tried on the distinct texts only, so a frequent text costs one probe.
    Rows with a non-NULL ``error`` column get ``invalid``; no matching prefix gives
    ``default``.
    """
    texts = df.select(F.col(col).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    prefixes = texts.select(
        "_text",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1))), lambda n: F.substring("_text", 1, n))
        ).alias("_prefix"),
    )
    best = (
        prefixes.join(lookup.select(F.col("code").alias("_prefix"), "level"), "_prefix")
        .groupBy("_text")
        .agg(F.max_by("level", F.length("_prefix")).alias("_level"))
    )
    joined = left_join_spread(df, best, col, "_text")
    value = F.coalesce(F.col("_level"), F.lit(default))
    if error is not None:
        value = F.when(F.col(error).isNotNull(), F.lit(invalid)).otherwise(value)
    return joined.withColumn(out, value).drop("_text", "_level")
