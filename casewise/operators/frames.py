"""Small table operators: fills, counts, shares, summaries, top rows, unpivots, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from casewise.operators.ordered import exact_quantiles, quantile_table


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; text that does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def fill_median(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Replace NULL by the exact median of the column."""
    medians = quantile_table(df, cols, [0.5], **options)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m[0])) for c, m in medians.items() if m}
    )


def null_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(feature, null_rate)`` for every column, in one pass."""
    cols = list(cols or df.columns)
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return rates.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in cols]))
    )


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """``(rows, keys, duplicates)``; all NULL keys count as one value."""
    return df.agg(
        F.count("*").alias("rows"),
        (F.count_distinct(key) + F.max(F.coalesce(F.col(key).isNull(), F.lit(False)).cast("int"))).alias("keys"),
    ).select("rows", "keys", (F.col("rows") - F.col("keys")).alias("duplicates"))


def group_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fns: Sequence[str] = ("count", "avg")) -> DataFrame:
    """Group size plus ``<column>_<function>``; rows with a NULL key are left out."""
    present = df.na.drop("any", subset=list(keys))
    aggs = [getattr(F, fn)(c).alias(f"{c}_{fn}") for c in cols for fn in fns]
    return present.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def value_share(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """``(value, n, share)``: frequency and share of all rows, NULL rows in the base only."""
    rows = df if where is None else df.filter(where)
    total = rows.agg(F.count("*")).scalar()
    return (
        rows.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / total)
    )


def share_of_total(df: DataFrame, key: str, x: str, out: str = "share") -> DataFrame:
    """Each group's sum of ``x`` over the sum of all rows."""
    total = df.agg(F.sum(x)).scalar()
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(x).alias(f"sum_{x}"))
    return sums.withColumn(out, F.try_divide(F.col(f"sum_{x}"), total))


def monthly_trend(df: DataFrame, ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per month with the given aggregates."""
    month = F.date_format(F.col(ts), "yyyy-MM").alias("month")
    return df.groupBy(month).agg(*[m.alias(n) for n, m in measures.items()])


def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75), **options) -> DataFrame:
    """Per column: count, mean, sample deviation, min, max and a map of exact percentiles."""
    per_column = [
        F.struct(
            F.lit(c).alias("feature"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in cols
    ]
    moments = df.agg(F.array(*per_column).alias("all")).select(F.inline("all"))
    points = (
        exact_quantiles(df, cols, percentiles, **options)
        .groupBy("feature")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prob", "quantile")))).alias("percentiles"))
    )
    return moments.join(points, "feature", "left")


def top_n(df: DataFrame, by: str, n: int, tie_break: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the greatest ``by``, overall or per group."""
    order = [F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    if not group:
        return df.orderBy(*order).limit(n)
    # Spark prunes to n rows per group before the shuffle (window group limit).
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def unpivot_refs(df: DataFrame, key: str, cols: Sequence[str], out: str = "ref", pattern: str = r'[\s,"\]]') -> DataFrame:
    """Reference columns as distinct (key, ref) rows from one scan.

    Texts are trimmed, made distinct, and only then stripped of ``pattern``, so two
    spellings of one reference stay two rows.
    """
    long = df.select(key, F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in cols])).alias(out))
    return (
        long.filter(F.col(out).isNotNull())
        .distinct()
        .withColumn(out, F.regexp_replace(out, pattern, ""))
    )


def rollup_parent(df: DataFrame, key: str, parent: str, carry: Sequence[str]) -> DataFrame:
    """Replace a child's key by its parent's and its ``carry`` columns by the parent's own."""
    parents = df.select(F.col(key).alias("_pkey"), *[F.col(c).alias(f"_p_{c}") for c in carry])
    joined = df.join(parents, F.col(parent) == F.col("_pkey"), "left")
    child = F.col(parent).isNotNull()
    changed = {key: F.coalesce(F.col(parent), F.col(key))}
    changed.update({c: F.when(child, F.col(f"_p_{c}")).otherwise(F.col(c)) for c in carry})
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def left_join_filtered(
    left: DataFrame, right: DataFrame, on: str, right_pred: Column | None = None, left_pred: Column | None = None
) -> DataFrame:
    """Left join with extra predicates in its ``ON``: they never drop a left row."""
    kept = right if right_pred is None else right.filter(right_pred)
    renamed = kept.withColumnRenamed(on, "_on")
    condition = F.col(on) == F.col("_on")
    if left_pred is not None:
        condition = condition & left_pred
    return left.join(renamed, condition, "left").drop("_on")


def left_join_spread(left: DataFrame, right: DataFrame, on: str, right_on: str) -> DataFrame:
    """Left join on ``on == right_on`` that spreads the rows without a key over all tasks; ``right_on`` stays."""
    plain = [f"`{f.name}`" for f in left.schema if isinstance(f.dataType, AtomicType) and f.name != on]
    spread = left.withColumn("_spread", F.when(F.col(on).isNull(), F.xxhash64(*plain)).otherwise(0) if plain else F.lit(0).cast("long"))
    # Always 0, but no literal: the planner would take that out of the keys that rows are dealt by.
    joined = spread.join(right.withColumn("_zero", F.pmod(F.xxhash64(right_on), F.lit(1).cast("long"))), (F.col(on) == F.col(right_on)) & (F.col("_spread") == F.col("_zero")), "left")
    return joined.drop("_spread", "_zero")


def sample_rows(df: DataFrame, fraction: float, key: str | None = None, seed: int = 42) -> DataFrame:
    """A row sample; with ``key`` the choice depends on the key only, not on partitions."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    return df.filter(draw < int(round(fraction * 1_000_000)))


def concat_metrics(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Align metric tables on ``key``, keeping keys found in any of them."""
    first, *rest = frames
    for other in rest:
        first = first.join(other, key, "full")
    return first


def pick_columns(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Column names to use, in the caller's order."""
    wanted = list(include) or df.columns
    return [c for c in wanted if c not in set(exclude)]
