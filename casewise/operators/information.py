"""How much each feature tells about a target: information value, MIC, squared Spearman."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.ordered import below, bin_column, quantile_table
from casewise.operators.stats import columns_with_nulls, spearman


def _binned(df: DataFrame, y: str, xs: Sequence[str], uniq: int, bins: int, **options) -> DataFrame:
    """Long ``(feature, bin, y)`` rows: median-imputed, raw if few values, else quantile bins."""
    rows = df.filter(F.col(y).isNotNull())
    checks = rows.agg(
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in xs],
        *[F.approx_count_distinct(c, 0.02).alias(f"near_{c}") for c in xs],
    ).first()
    filled = {c: F.col(c).cast("double") for c in xs}
    holes = [c for c in xs if checks[f"null_{c}"]]
    if holes:
        for c, m in quantile_table(rows, holes, [0.5], **options).items():
            filled[c] = F.coalesce(filled[c], F.lit(m[0] if m else None))
    wide = rows.select(F.col(y).alias("y"), *[x.alias(c) for c, x in filled.items()])

    # The sketch rules out columns far above `uniq`; the others are counted exactly and
    # have few values, so that count stays small.
    maybe_few = [c for c in xs if checks[f"near_{c}"] <= 4 * uniq + 8]
    few = set()
    if maybe_few:
        exact = wide.agg(*[F.count_distinct(c).alias(c) for c in maybe_few]).first()
        few = {c for c in maybe_few if exact[c] <= uniq}
    many = [c for c in xs if c not in few]
    edges = quantile_table(wide, many, [i / bins for i in range(bins + 1)], **options) if many else {}
    binned = {c: F.col(c) if c in few else bin_column(c, edges[c]).cast("double") for c in xs}
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), b.alias("bin")) for c, b in binned.items()])
    return wide.select("y", F.inline(cells)).filter(F.col("bin").isNotNull())


def iv_group(col: str | Column) -> Column:
    """Strength label of an information value; NULL and infinite give the lowest."""
    iv = F.col(col) if isinstance(col, str) else col
    # Cut points and labels of the usual reading of information values.
    return (
        F.when((iv >= 0.5) & (iv < float("inf")), "suspecious")
        .when((iv >= 0.3) & (iv < 0.5), "strong")
        .when((iv >= 0.1) & (iv < 0.3), "medium")
        .when((iv >= 0.02) & (iv < 0.1), "weak")
        .otherwise("useless")
    )


def _finish(df: DataFrame) -> DataFrame:
    iv = F.when(F.col("bins") <= 1, F.lit(0.0)).when(~F.col("zero_cell"), F.bround("raw", 3))
    return df.select(
        "feature", iv.alias("iv"), (F.col("zero_cell") & (F.col("bins") > 1)).alias("zero_cell"), iv_group(iv).alias("strength")
    )


def iv_class(df: DataFrame, y: str, xs: Sequence[str], uniq: int = 10, bins: int = 5, **options) -> DataFrame:
    """Information value against a class target: ``(feature, iv, zero_cell, strength)``.

    Per bin the largest class term counts. A bin that lacks a class has no finite term:
    the value is NULL and ``zero_cell`` is set.
    """
    cells = _binned(df, y, xs, uniq, bins, **options).groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    # From here on there is one row per feature, bin and class.
    of_bin, of_class, of_all = (Window.partitionBy("feature", *k) for k in (["bin"], ["y"], []))
    shares = cells.select(
        "feature",
        "bin",
        F.col("n").alias("hit"),
        F.sum("n").over(of_bin).alias("size"),
        F.sum("n").over(of_class).alias("events"),
        F.sum("n").over(of_all).alias("total"),
        F.count("*").over(of_bin).alias("present"),
        F.size(F.collect_set("y").over(of_all)).alias("classes"),
    )
    own = F.col("hit") / F.col("events")
    rest = F.try_divide(F.col("size") - F.col("hit"), F.col("total") - F.col("events"))
    term = F.when((own > 0) & (rest > 0), (rest - own) * F.ln(rest / own))
    per_bin = shares.groupBy("feature", "bin").agg(
        F.max(term).alias("term"), F.max(F.col("present") < F.col("classes")).alias("hole"), F.max("classes").alias("classes")
    )
    whole = per_bin.groupBy("feature").agg(
        F.count("*").alias("bins"),
        F.sum("term").alias("raw"),
        (F.max("hole") | (F.max("classes") < 2)).alias("zero_cell"),
    )
    return _finish(whole)


def iv_reg(df: DataFrame, y: str, xs: Sequence[str], uniq: int = 10, bins: int = 5, **options) -> DataFrame:
    """Information value against a continuous target: population share against target share."""
    cells = _binned(df, y, xs, uniq, bins, **options).groupBy("feature", "bin").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("mass")
    )
    of_all = Window.partitionBy("feature")  # one row per bin
    shares = cells.select(
        "feature",
        (F.col("n") / F.sum("n").over(of_all)).alias("pop"),
        F.try_divide(F.col("mass"), F.sum("mass").over(of_all)).alias("resp"),
    )
    fits = F.coalesce((F.col("resp") > 0) & (F.col("pop") > 0), F.lit(False))
    whole = shares.groupBy("feature").agg(
        F.count("*").alias("bins"),
        F.sum(F.when(fits, (F.col("pop") - F.col("resp")) * F.ln(F.col("pop") / F.col("resp")))).alias("raw"),
        F.max(~fits).alias("zero_cell"),
    )
    return _finish(whole)


def spearman_sq(df: DataFrame, y: str, xs: Sequence[str], **options) -> DataFrame:
    """``(feature, r2)``: squared Spearman correlation with the target, 3 decimals.

    Each feature is ranked on the rows that have it and the target, whatever the other features lack.
    """
    rows = df.filter(F.col(y).cast("double").isNotNull())
    holes = columns_with_nulls(rows, xs)
    groups = [[x for x in xs if x not in holes], *[[x] for x in holes]]
    found = reduce(DataFrame.unionByName, [spearman(rows.na.drop("any", subset=g), [y, *g], **options) for g in groups if g])
    pairs = found.filter((F.col("var_i") == y) & (F.col("var_j") != y))
    return pairs.select(F.col("var_j").alias("feature"), F.bround(F.col("r") * F.col("r"), 3).alias("r2"))


# The grids are as fine as those of a table of this many rows, however many rows are counted on them.
MIC_ROWS = 50_000
MIC_CLUMPS = 256


def _merged(counts: np.ndarray, parts: int) -> np.ndarray:
    """Neighbouring rows of a table of counts added up to at most ``parts`` of about equal weight."""
    weight = counts.sum(1)
    middle = np.cumsum(weight) - weight / 2
    part = np.minimum((middle * parts / weight.sum()).astype(int), parts - 1)
    return np.add.reduceat(counts, np.flatnonzero(np.diff(part, prepend=-1)), axis=0)


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _best_cuts(counts: np.ndarray, most: int) -> np.ndarray:
    """Information (times rows) between the rows of a table and 1, 2, ... ``most`` runs of its columns, each cut best.

    What a run leaves unknown about the rows adds up over runs, so the least sum for one run more follows from
    the least sums of all shorter beginnings.
    """
    upto = np.concatenate([np.zeros((1, len(counts))), np.cumsum(counts.T, axis=0)])
    # left[s, t]: what columns s to t-1, taken as one run, leave unknown.
    left = np.full((len(upto), len(upto)), np.inf)
    for start in range(len(upto) - 1):
        inside = upto[start + 1 :] - upto[start]
        left[start, start + 1 :] = _x_log_x(inside.sum(1)) - _x_log_x(inside).sum(1)
    unknown = left[0, -1]
    least, found = left[0].copy(), [0.0]
    for _ in range(1, most):
        least = np.minimum(least, (least[:, None] + left).min(0))
        found.append(unknown - least[-1])
    return np.array(found)


def _mic_of(counts: np.ndarray, alpha: float, c: float, grid_rows: int) -> float:
    """Highest normalised information over grids with equal-frequency rows and freely cut columns."""
    counts = counts[counts.sum(1) > 0][:, counts.sum(0) > 0]
    n = counts.sum()
    budget = max(min(n, grid_rows) ** alpha, 4.0)
    best = 0.0
    for rows in range(2, min(int(budget // 2), len(counts)) + 1):
        merged = _merged(counts, rows)
        if len(merged) < 2:
            continue
        columns = int(budget // rows)
        clumps = _merged(merged.T, max(int(c * columns), 1)).T
        found = _best_cuts(clumps, min(columns, clumps.shape[1]))
        fewer = np.minimum(np.arange(1, len(found) + 1), rows)
        best = max(best, (found[1:] / n / np.log(fewer[1:])).max(initial=0.0))
    return min(best, 1.0)


def mic(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    alpha: float = 0.6,
    c: float = 15,
    clumps: int = MIC_CLUMPS,
    grid_rows: int = MIC_ROWS,
) -> DataFrame:
    """``(feature, mic)``: greatest normalised mutual information over grids of up to ``n ** alpha`` cells.

    One axis of a grid is cut into bins of equal frequency, the other where the information is highest, among ``c``
    times as many candidate bins as it has (``clumps`` at most); both ways round. All rows that have the feature and the target are
    counted, on ``clumps`` bins an axis at the quantiles of one sketch (within 1e-4 of a rank, whatever the
    partitioning); the search sees only those counts, at most ``clumps ** 2`` a feature. ``n`` is at
    most ``grid_rows`` in the number of cells. A feature without such rows has no result row, a constant one 0.
    """
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs]).na.drop(subset=["_y"])
    shares = [i / clumps for i in range(1, clumps)]
    cuts = rows.agg(*[F.percentile_approx(f"`{x}`", shares, 10_000) for x in ["_y", *xs]]).first()
    bins = {x: below(F.col(f"`{x}`"), sorted(set(at or []))) for x, at in zip(["_y", *xs], cuts)}
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), bins[x].alias("x")) for x in xs])
    counted = rows.select(bins["_y"].alias("y"), F.inline(cells)).where("x is not null").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))

    def score(cells: pd.DataFrame) -> float:
        table = np.zeros((clumps, clumps))
        table[cells["row"], cells["column"]] = cells["n"]
        return _mic_of(table, alpha, c, grid_rows)

    def scores(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [group["feature"].iloc[0]], "mic": [score(group)]})

    # One task a feature and way round.
    way = lambda number, row, column: F.struct(F.lit(number).alias("way"), F.col(row).alias("row"), F.col(column).alias("column"))
    ways = F.array(way(0, "x", "y"), way(1, "y", "x"))
    both = counted.select("feature", "n", F.inline(ways))
    found = both.groupBy("feature", "way").applyInPandas(scores, "feature string, mic double")
    return found.groupBy("feature").agg(F.round(F.max("mic"), 4).alias("mic"))
