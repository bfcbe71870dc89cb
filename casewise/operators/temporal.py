"""Latest and first rows, interval matches, point-in-time joins and time splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of the time buckets in which an as-of join looks back.
BUCKET_SECONDS = 86_400


def _null_last(ts: str) -> Column:
    """Sort key that orders NULL after every value, as the source warehouse does."""
    return F.struct(F.col(ts).isNull().alias("missing"), F.col(ts).alias("at"))


def _rows_at(df: DataFrame, key: str, ts: str, best: Column) -> DataFrame:
    """All rows at their key's ``best`` time, ties included.

    Map-side aggregation leaves one row per key; AQE may broadcast it or split a skewed
    part of the join, so no task has to sort a whole hot key.
    """
    times = df.groupBy(F.col(key).alias("_key")).agg(best.alias("_best"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(ts).eqNullSafe(F.col("_best"))
    return df.join(times, same, "left_semi")


def _one_row(df: DataFrame, key: str, ts: str, tie_break: Sequence[str], pick_by) -> DataFrame:
    order = F.struct(_null_last(ts), *[F.col(c) for c in tie_break])
    rows = df.groupBy(F.col(key).alias("_key")).agg(pick_by(F.struct(*df.columns), order).alias("_row"))
    return rows.select("_row.*")


def latest_per_key(df: DataFrame, key: str, ts: str, ties: bool = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows with the greatest ``ts`` of their key (``rank() ... desc = 1``).

    A NULL timestamp counts as the greatest. ``ties=False`` keeps one row, the one with
    the greatest ``tie_break`` values.
    """
    if not ties:
        return _one_row(df, key, ts, tie_break, F.max_by)
    return _rows_at(df, key, ts, F.when(~F.max(F.col(ts).isNull()), F.max(ts)))


def first_per_key(df: DataFrame, key: str, ts: str, ties: bool = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows with the least ``ts`` of their key; NULL comes last."""
    if not ties:
        return _one_row(df, key, ts, tie_break, F.min_by)
    return _rows_at(df, key, ts, F.min(ts))


def dedupe(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order`` (``row_number() = 1``)."""
    if not order:
        raise ValueError("dedupe needs an order that decides between rows of one key")
    first, *rest = order
    return first_per_key(df, key, first, ties=False, tie_break=rest)


def time_split(df: DataFrame, ts: str, end, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``days`` before ``end``, and the rows after that day."""
    next_day = F.date_sub(F.lit(end).cast("date"), days - 1)
    return df.filter(F.col(ts) < next_day), df.filter(F.col(ts) >= next_day)


def interval_match(
    anchors: DataFrame,
    events: DataFrame,
    key: str,
    anchor: str,
    ts: str,
    days: int | None = None,
    months: int | None = None,
    aggs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Aggregate the events dated in ``[anchor, anchor + delta]`` of each anchor row.

    Every anchor row is kept; ``aggs`` may use event columns and sees NULLs where nothing
    matched. Both sides meet on (key, time cell): a cell is as long as the interval, so an
    anchor looks into at most two cells and a hot key is spread over its whole history.
    """
    if (days is None) == (months is None):
        raise ValueError("give either days or months")
    width = days + 1 if days is not None else 31 * months + 1
    start = F.col(anchor).cast("date")

    def cell(day: Column) -> Column:
        return F.floor(F.unix_date(day) / width)

    names = anchors.columns
    clash = set(names) & set(events.columns) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    # Equal anchors look once; all their rows receive the result.
    looks = anchors.select(F.col(key), start.alias("_start")).distinct().withColumn(
        "_stop", F.date_add("_start", days) if days is not None else F.add_months("_start", months)
    )
    looks = looks.select(
        F.col(key).alias("_key"),
        "_start",
        "_stop",
        F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_stop")))).alias("_cell"),
    )
    found = events.withColumn("_day", F.col(ts).cast("date")).withColumn("_cell", cell(F.col("_day")))
    matched = looks.join(
        found,
        (F.col("_key") == F.col(key))
        & (looks["_cell"] == found["_cell"])
        & F.col("_day").between(F.col("_start"), F.col("_stop")),
    ).drop(looks["_cell"]).drop(found["_cell"])
    aggregated = matched.groupBy("_key", "_start").agg(*[a.alias(n) for n, a in (aggs or {}).items()])
    kept = anchors.withColumn("_at", start).join(
        aggregated, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_start")), "left"
    )
    return kept.select(*names, *list(aggs or {}))


def asof_join(
    spine: DataFrame,
    history: DataFrame,
    key: str,
    ts: str,
    history_ts: str,
    tie_break: Sequence[str] = (),
    max_age_days: int | None = None,
    strict: bool = False,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Each spine row with the latest history row of its key at or before ``ts``.

    ``strict`` hides a row at exactly ``ts``; ``max_age_days`` hides older ones. Time is cut into buckets of
    ``bucket_seconds``. The last history row of each (key, bucket) is carried over the key's buckets, one row each,
    and joins the rows of the next bucket that has any; there the last seen row is carried on. The rows meet by
    (key, bucket), so a key of any size spreads over its buckets, and the plan is the same at every size: no job
    runs before it starts. Spine rows with a NULL key or time match nothing.
    """
    payload = [c for c in history.columns if c != key]
    clash = set(payload) & set(spine.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    past = history.select(
        F.col(key).alias("_key"),
        F.col(history_ts).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        F.struct(*[F.col(c) for c in tie_break], F.lit(0)).alias("_tie"),
        F.struct(*payload).alias("_past"),
    ).filter(F.col("_at").isNotNull())
    rows = spine.select(
        F.col(key).alias("_key"),
        F.col(ts).alias("_at"),
        F.lit(0 if strict else 1).alias("_side"),
        F.struct(*spine.columns).alias("_row"),
    )
    bucket = F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).alias("_bucket")
    past = past.filter(F.col("_key").isNotNull()).select("*", bucket)
    # Rows without a key or a time see nothing, and would all meet in one task.
    lost = F.col("_key").isNull() | F.col("_at").isNull()
    blind, rows = rows.filter(lost), rows.filter(~lost).select("*", bucket)

    group = ["_key", "_bucket"]
    ends = past.groupBy(*group).agg(F.max_by("_past", F.struct("_at", "_tie")).alias("_end"))
    slots = rows.select(*group).distinct().withColumn("_wanted", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    # At most two rows per bucket of a key reach this window; it looks at earlier buckets only.
    earlier = Window.partitionBy("_key").orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*group, "_wanted", F.last("_end", ignorenulls=True).over(earlier).alias("_past"))
    carry = carry.filter(F.col("_wanted") & F.col("_past").isNotNull()).drop("_wanted")

    # The carried row has no time here and so comes before all others of its bucket.
    both = past.unionByName(carry, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    seen = Window.partitionBy(*group).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_hit", F.last("_past", ignorenulls=True).over(seen)).filter(F.col("_row").isNotNull())
    carried = carried.select("_at", "_row", "_hit").unionByName(
        blind.select("_at", "_row", F.lit(None).cast(both.schema["_past"].dataType).alias("_hit"))
    )
    hit = F.col("_hit")
    if max_age_days is not None:
        fresh = F.date_diff(F.col("_at").cast("date"), hit.getField(history_ts).cast("date")) <= max_age_days
        hit = F.when(fresh, hit)
    return carried.select("_row.*", *[hit.getField(c).alias(c) for c in payload])
