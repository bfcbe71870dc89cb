"""Rule flags, trigger groups and failed-rule counts, all as one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions import clip, contains_any, row_max, row_min, row_sum
from casewise.operators.stats import pearson


def apply_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add one 0/1 column per rule; a rule that is NULL does not fire."""
    return df.withColumns({n: F.coalesce(r, F.lit(False)).cast("int") for n, r in rules.items()})


def summarize_rules(
    df: DataFrame, cols: Sequence[str], any_col: str = "any_rule", count_col: str = "rule_count", include_any: bool = False
) -> DataFrame:
    """Any-rule flag and rule count; ``include_any`` also counts the flag itself."""
    total = row_sum(*cols)
    flag = row_max(*cols)
    return df.withColumns({any_col: flag, count_col: total + flag if include_any else total})


def fail_flag(df: DataFrame, passes: Sequence[str], out: str = "fail", count_col: str | None = None) -> DataFrame:
    """1 unless every pass column holds; optionally added to a rule count."""
    fail = 1 - row_min(*[F.col(c).cast("int") for c in passes])
    added = {out: fail}
    if count_col:
        added[count_col] = F.col(count_col) + fail
    return df.withColumns(added)


def group_triggers(df: DataFrame, col: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per trigger group: does the text name any code of the group?"""
    return df.withColumns(
        {name: contains_any(col, [c.upper() for c in codes], "upper").cast("int") for name, codes in groups.items()}
    )


def capped_count(df: DataFrame, cols: Sequence[str], out: str, cap: int = 5) -> DataFrame:
    return df.withColumn(out, clip(row_sum(*cols), 0, cap))


def rule_report(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Hit rates ``(feature, rate)`` and the pairwise correlation of the flags."""
    rates = df.agg(*[F.avg(c).alias(c) for c in cols]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("rate")) for c in cols]))
    )
    return rates, pearson(df, cols)
