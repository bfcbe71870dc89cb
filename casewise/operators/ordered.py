"""Ranks, running totals and exact quantiles over the whole table.

A window without a partition would sort everything in one task. Here equal values are
first grouped (so a hot value becomes one row), the distinct values are cut into slices
of about equal size at approximate quantiles, each slice is summed on its own and the
few slice totals supply the offsets. Slice edges are collected once, so every use of
them agrees; their number is bounded by ``columns x slices``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows one task may sort or hold the distinct values.
ONE_TASK_ROWS = 1_000_000


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """Long form ``(feature, value)`` in one pass; missing values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def slice_edges(
    df: DataFrame, cols: Sequence[str], slices: int | None = None, one_task: int = ONE_TASK_ROWS
) -> dict[str, list[float]]:
    """Per column: approximate inner quantiles, or nothing if one task can hold its rows."""
    count = slices or max(32, min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    numbers = [F.col(f"`{c}`").cast("double") for c in cols]
    sizes = df.agg(*[F.count(x) for x in numbers]).first()
    large = [i for i, n in enumerate(sizes) if n > one_task]
    edges: dict[str, list[float]] = {c: [] for c in cols}
    if large:
        probs = [i / count for i in range(1, count)]
        found = df.agg(*[F.percentile_approx(numbers[i], probs, 10_000) for i in large]).first()
        edges.update({cols[i]: sorted(set(e)) for i, e in zip(large, found)})
    return edges


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<double>")


def running_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    edges: Mapping[str, Sequence[float]],
    feature: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Group rows by ``value`` (within ``feature``) and add running totals in value order.

    Returns the keys, each aggregate of ``sums`` and its inclusive total ``cum_<name>``.
    ``edges`` comes from :func:`slice_edges`, by feature or by the one ``value`` column.
    """
    keys = [feature] if feature else []
    number = F.col(f"`{value}`")
    grouped = df.filter(number.isNotNull()).groupBy(*keys, number).agg(*[a.alias(n) for n, a in sums.items()])
    order = number.desc() if descending else number.asc()

    if not any(edges.values()):
        # No feature holds more rows than one task may sort.
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
        return grouped.select("*", *[F.sum(n).over(window).alias(f"cum_{n}") for n in sums])

    if feature:
        table = F.create_map(*[x for k, e in edges.items() for x in (F.lit(k), _doubles(e))])
        bounds = F.element_at(table, F.col(feature))
    else:
        bounds = _doubles(edges[value])
    place = F.size(F.filter(bounds, lambda e: e < number.cast("double")))
    sliced = grouped.withColumn("_slice", -place if descending else place)

    # At most one row per slice and feature reaches this window.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return sliced.join(offsets, [*keys, "_slice"]).select(
        *keys,
        number,
        *sums,
        *[(F.sum(n).over(inside) + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in sums],
    )


def average_ranks(df: DataFrame, col: str, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """``(<col>, rank)``: the mean rank of each distinct value of a column."""
    totals = running_totals(df, col, {"_n": F.count("*")}, {col: edges[col]})
    return totals.select(F.col(f"`{col}`"), (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2).alias("rank"))


def rank_column(df: DataFrame, col: str, out: str = "rank", **options) -> DataFrame:
    """Add the mean rank of ``col``; rows with NULL get a NULL rank."""
    ranks = average_ranks(df, col, slice_edges(df, [col], **options)).withColumnRenamed("rank", out)
    return df.join(ranks, col, "left")


def _brackets(row: Sequence, probs: Sequence[float], n: int) -> list[tuple[float, float]]:
    """Disjoint value ranges that should hold the wanted order statistics of one column."""
    if n < 100:
        return [(float("-inf"), float("inf"))]
    at = 0 if n >= 50_000 else 2 * len(probs)  # narrow pairs first, then wide ones
    margin = _MARGINS[0] if n >= 50_000 else _MARGINS[1]
    found = []
    for i, p in enumerate(probs):
        low, high = row[at + 2 * i], row[at + 2 * i + 1]
        found.append((low if p > margin else float("-inf"), high if p < 1 - margin else float("inf")))
    merged: list[tuple[float, float]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


# Half-widths of a bracket around a probability, for large and for small columns. The
# sketch is accurate to 1 / _ACCURACY, so the narrow one leaves room for its error.
_ACCURACY = 10_000
_MARGINS = (3 / _ACCURACY, 0.04)


def _squeeze(x: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Values inside a range stay; each gap between ranges becomes one value inside it."""
    chain = F
    below = float("-inf")
    for low, high in ranges:
        if low > float("-inf"):
            chain = chain.when(x < low, F.lit((below + low) / 2 if below > float("-inf") else below))
        if high == float("inf"):
            return chain.otherwise(x) if chain is not F else x
        chain = chain.when(x <= high, x)
        below = high
    return chain.otherwise(F.lit(float("inf")))


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], one_task: int = ONE_TASK_ROWS
) -> dict[str, list[float]]:
    """Exact quantiles per column, linear between order statistics, NULLs left out.

    A sketch brackets each wanted order statistic; a second scan keeps only the values
    inside the brackets and counts the rest per gap, so little is shuffled. Should a
    statistic lie outside its bracket, all values are counted. The result has
    ``len(cols) * len(probs)`` numbers; a column without values gives an empty list.
    """
    probs = [float(p) for p in probs]
    around = [min(1.0, max(0.0, p + d)) for m in _MARGINS for p in probs for d in (-m, m)]
    numbers = {c: F.col(f"`{c}`").cast("double") for c in cols}
    sketch = df.agg(
        *[F.struct(F.count(x), F.percentile_approx(x, around, _ACCURACY)) for x in numbers.values()]
    ).first()
    sizes = {c: cell[0] for c, cell in zip(cols, sketch)}
    ranges = {c: _brackets(cell[1], probs, cell[0]) for c, cell in zip(cols, sketch) if cell[0]}
    out = _order_statistics(df, numbers, sizes, ranges, probs, one_task)
    lost = [c for c, values in out.items() if any(abs(v) == float("inf") or v != v for v in values)]
    if lost:
        whole = {c: [(float("-inf"), float("inf"))] for c in lost}
        out.update(_order_statistics(df, numbers, sizes, whole, probs, one_task))
    return {c: out.get(c, []) for c in cols}


def _order_statistics(df, numbers, sizes, ranges, probs, one_task) -> dict[str, list[float]]:
    kept = list(ranges)
    if not kept:
        return {}
    squeezed = df.select(*[_squeeze(numbers[c], ranges[c]).alias(c) for c in kept])
    width = {c: 1.0 if (float("-inf"), float("inf")) in r else min(1.0, 2 * _MARGINS[0] * len(probs)) for c, r in ranges.items()}
    large = [c for c in kept if sizes[c] * width[c] > one_task]
    edges = {c: [] for c in kept}
    if large:
        edges.update(slice_edges(squeezed, large, one_task=one_task))
    totals = running_totals(
        unpivot(squeezed, kept),
        "value",
        {"n": F.count("*")},
        edges,
        feature="feature",
    )
    wanted = {c: sorted({k for p in probs for k in _places(p, sizes[c])[:2]}) for c in kept}
    table = F.create_map(*[F.lit(v) for c in kept for v in (c, wanted[c])])
    first = F.col("cum_n") - F.col("n")
    hits = F.filter(F.element_at(table, F.col("feature")), lambda k: (k >= first) & (k < F.col("cum_n")))
    # At most two rows per column and probability.
    found = totals.select("feature", "value", F.explode(hits).alias("place")).collect()
    at = {(r["feature"], r["place"]): r["value"] for r in found}
    out: dict[str, list[float]] = {}
    for c in kept:
        out[c] = []
        for p in probs:
            low, high, share = _places(p, sizes[c])
            a, b = at[c, low], at[c, high]
            # A gap's stand-in is never inside a bracket: mark it so that the caller notices.
            held = all(any(x <= v <= y for x, y in ranges[c]) for v in (a, b))
            out[c].append(a + (b - a) * share if held else float("nan"))
    return out


def _places(prob: float, n: int) -> tuple[int, int, float]:
    """The two ranks (from 0) around a quantile and the weight of the upper one."""
    where = prob * (n - 1)
    low = math.floor(where)
    return low, math.ceil(where), where - low


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **options) -> DataFrame:
    """``(feature, prob, quantile)`` of :func:`quantile_table`."""
    table = quantile_table(df, cols, probs, **options)
    rows = [(c, float(p), q) for c, qs in table.items() for p, q in zip(probs, qs)]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, quantile double")


def bin_column(col: str | Column, edges: Sequence[float]) -> Column:
    """Index of the interval ``(lo, hi]`` holding the value; the lowest one is closed."""
    x = F.col(col) if isinstance(col, str) else col
    inner = sorted(set(edges))[1:-1]
    index = F.lit(0)
    for edge in inner:
        index = index + F.when(x > edge, 1).otherwise(0)
    return F.when(x.isNotNull(), index)


def below(col: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges lie below the value, by binary search; for many edges."""
    if not edges:
        return F.when(col.isNotNull(), 0)
    table = F.array(*map(F.lit, edges))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    reach = lambda at, step: (at + step <= len(edges)) & (F.get(table, at + step - 1) < col)
    return F.when(col.isNotNull(), F.aggregate(steps, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at)))


def quantile_bins(df: DataFrame, col: str, bins: int, out: str = "bin", **options) -> DataFrame:
    """Equal-frequency bins by exact quantile edges, equal edges merged."""
    edges = quantile_table(df, [col], [i / bins for i in range(bins + 1)], **options)[col]
    return df.withColumn(out, bin_column(F.col(col).cast("double"), edges))
