"""Correlation, covariance and cross-product tables.

Every operator returns a long table ``(var_i, var_j, <measure>)`` over the upper triangle
with the diagonal, in the caller's column order. The correlations of two columns rest on the
rows that have both; covariances and cross products on the rows that have all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.operators.ordered import average_ranks, running_totals, slice_edges

# Up to here one aggregate holds all pairs in generated code; beyond it each task sums
# its own D x D block in NumPy and Spark adds the blocks.
NATIVE_COLUMNS = 12
# Ranks of columns with few distinct values go to every task, up to this many numbers in all.
SHARED_RANKS = 200_000
# Up to this many other columns the rows meet their ranks column by column, beyond it as one long table.
JOINED_COLUMNS = 2


def _number(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).na.drop("any")


def _native_pairs(df: DataFrame, cols: Sequence[str], measure: Callable[[Column, Column], Column], scaled: bool = False) -> DataFrame:
    """All pairs in one aggregate; ``scaled`` divides by the roots of each column with itself on the rows of the pair."""
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    quoted = [F.col(f"`{c}`") for c in cols]
    wanted = {f"s_{i}_{j}": measure(quoted[i], quoted[j]) for i, j in at}
    if scaled:
        for i, j in [(i, j) for a, b in at if a != b for i, j in [(a, b), (b, a)]]:
            own = F.when(quoted[j].isNotNull(), quoted[i])
            wanted[f"own_{i}_{j}"] = measure(own, own)
    one = df.agg(*[value.alias(name) for name, value in wanted.items()])

    def cell(i: int, j: int) -> Column:
        s = F.col(f"s_{i}_{j}")
        if not scaled:
            return s
        if i == j:
            return F.when(s > 0, 1.0)
        return F.try_divide(s, F.sqrt(f"own_{i}_{j}") * F.sqrt(f"own_{j}_{i}"))

    cells = [
        F.struct(F.lit(cols[i]).alias("var_i"), F.lit(cols[j]).alias("var_j"), cell(i, j).alias("s")) for i, j in at
    ]
    return one.select(F.inline(F.array(*cells)))


def _packed(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """The columns as one array ``x``: a filter over many columns would cost the planner dearly."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    kept = df.select(x.alias("x"), *([F.col(weight).alias("w")] if weight else []))
    return kept.filter(~F.exists("x", lambda v: v.isNull()))


def _block_pairs(rows: DataFrame, centre: Sequence[float]) -> DataFrame:
    """``(i, j, s)``, sums of ``w * (x_i - c_i) * (x_j - c_j)``: one D x D block per task, then a sum."""
    mid = np.asarray(centre, dtype=float)
    upper = np.triu_indices(len(mid))
    weighted = "w" in rows.columns

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(mid), len(mid)))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()) - mid
                wx = x * batch[["w"]].to_numpy(dtype=float) if weighted else x
                total += wx.T @ x
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "s": total[upper]})

    return rows.mapInPandas(block, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def _named(pairs: DataFrame, cols: Sequence[str], value: Column) -> DataFrame:
    label = F.array(*map(F.lit, cols))
    return pairs.select(F.get(label, F.col("i")).alias("var_i"), F.get(label, F.col("j")).alias("var_j"), value)


def _means(rows: DataFrame, size: int) -> tuple[int, list[float]]:
    row = rows.agg(F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i))) for i in range(size)]).first()
    return row[0], [v if v is not None else 0.0 for v in row[1:]]


def _pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(var_i, var_j, r)``: one table of pair sums per task, over the rows that have both columns, then a sum."""
    x = F.array(*[_number(c) for c in cols])
    middle = df.agg(*[F.avg(_number(c)) for c in cols]).first()
    mid = np.array([0.0 if v is None else v for v in middle])
    i, j = np.triu_indices(len(cols))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, square, both = (np.zeros((len(mid), len(mid))) for _ in range(4))
        for batch in batches:
            if len(batch):
                value = np.stack([np.asarray(v, dtype=float) for v in batch["x"]]) - mid
                there = np.stack([np.asarray(v, dtype=float) for v in batch["present"]])
                value = np.where(there == 1, value, 0.0)
                n, one = n + there.T @ there, one + value.T @ there
                square, both = square + (value**2).T @ there, both + value.T @ value
        cells = {"n": n[i, j], "a": one[i, j], "b": one[j, i], "aa": square[i, j], "bb": square[j, i], "ab": both[i, j]}
        yield pd.DataFrame({"i": i, "j": j} | cells)

    rows = df.select(F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"), F.transform(x, lambda v: v.isNotNull().cast("int")).alias("present"))
    names = ["n", "a", "b", "aa", "bb", "ab"]
    parts = rows.mapInPandas(block, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])

    def spread(square: str, total: str) -> Column:
        # What rounding leaves of a constant column is no variance.
        left = F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(left > 1e-12 * F.col(square), left)

    own = spread("aa", "a")
    r = F.when(F.col("i") == F.col("j"), F.when(own > 0, 1.0)).otherwise(
        F.try_divide(F.col("ab") - F.try_divide(F.col("a") * F.col("b"), F.col("n")), F.sqrt(own) * F.sqrt(spread("bb", "b")))
    )
    return _named(sums, cols, r.alias("r"))


def _normalize(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cross products to correlations. All pairs fit one row: there are D(D+1)/2."""
    diagonal = F.when(F.col("i") == F.col("j"), F.struct("i", F.sqrt("s").alias("sd")))
    whole = pairs.agg(
        F.collect_list(F.struct("i", "j", "s")).alias("cells"), F.array_sort(F.collect_list(diagonal)).alias("spread")
    )
    each = whole.select("spread", F.inline("cells"))

    def sd(at: str) -> Column:
        return F.get("spread", F.col(at)).getField("sd")

    r = F.when(F.col("i") == F.col("j"), F.when(F.col("s") > 0, 1.0)).otherwise(F.try_divide("s", sd("i") * sd("j")))
    return _named(each, cols, r.alias("r"))


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance as ``cov``."""
    if len(cols) <= NATIVE_COLUMNS:
        return _native_pairs(_complete(df, cols), cols, F.covar_samp).withColumnRenamed("s", "cov")
    rows = _packed(df, cols)
    n, centre = _means(rows, len(cols))
    return _named(_block_pairs(rows, centre), cols, (F.col("s") / (n - 1)).alias("cov"))


def sscp(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean cross product as ``sscp``."""
    if len(cols) <= NATIVE_COLUMNS:
        return _native_pairs(_complete(df, cols), cols, lambda a, b: F.avg(a * b)).withColumnRenamed("s", "sscp")
    rows = _packed(df, cols)
    n = rows.count()
    return _named(_block_pairs(rows, [0.0] * len(cols)), cols, (F.col("s") / n).alias("sscp"))


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation as ``r``, each pair over the rows that have both; NULL where a column is constant."""
    if len(cols) <= NATIVE_COLUMNS:
        numbers = df.select(*[_number(c).alias(c) for c in cols])
        return _native_pairs(numbers, cols, F.covar_pop, scaled=True).withColumnRenamed("s", "r")
    return _pair_correlations(df, cols)


def complete_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """As :func:`pearson`, over the rows that have every column: one matrix without negative eigenvalues."""
    return pearson(df.filter(~F.exists(F.array(*[_number(c) for c in cols]), lambda v: v.isNull())), cols)


def _ranked(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Mean ranks ``_r0``, ``_r1``, … minus their mean, one row per combination of values
    with its count ``_w``: equal rows are counted first, so a frequent value is joined
    to its rank once per combination."""
    rows = _complete(df, cols)
    edges = slice_edges(rows, cols, **options)
    ranked = rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("_w"))
    for i, c in enumerate(cols):
        ranks = average_ranks(rows, c, edges).toDF(f"_v{i}", f"_rank{i}")
        ranked = ranked.join(ranks, F.col(f"`{c}`") == F.col(f"_v{i}"))
    middle = rows.agg((F.count("*") + 1) / 2).scalar()
    return ranked.select("_w", *[(F.col(f"_rank{i}") - middle).alias(f"_r{i}") for i in range(len(cols))])


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that lack a number in some row."""
    missing = df.agg(*[F.max(_number(c).isNull()) for c in cols]).first()
    return [c for c, some in zip(cols, missing) if some]


def spearman(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """Spearman correlation as ``r``: Pearson of mean ranks, each pair ranked on the rows that have both."""
    if columns_with_nulls(df, cols):
        return masked_spearman(df, cols, **options)
    return complete_spearman(df, cols, **options)


def masked_spearman(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """As :func:`spearman`, for columns with NULLs: one ranking serves all pairs.

    Each distinct value of a column counts, for every other column, its rows that have that one too; running totals
    of these counts are the value's ranks in all pairs at once. Ranks then go back to the (distinct) rows, where each
    task sums its products per pair. The number of jobs does not depend on the number of columns. Ranks of columns
    with few values are sent to the rows, so that only columns with many values move them.
    """
    d = len(cols)
    numbers = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(cols)])
    values = [f"v{i}" for i in range(d)]
    has = [F.col(v).isNotNull().cast("long") for v in values]
    found = numbers.agg(
        F.array(*[F.sum(has[i] * has[j]) for i in range(d) for j in range(d)]), F.array(*[F.approx_count_distinct(v) for v in values])
    ).first()
    middle = (np.array([n or 0 for n in found[0]], dtype=float).reshape(d, d) + 1) / 2
    few, room = [], SHARED_RANKS
    for n, v in sorted(zip(found[1], values)):
        room -= n * d
        if room >= 0:
            few.append(v)
    many = [v for v in values if v not in few]
    if len(many) > JOINED_COLUMNS:
        few, many = [], values
    edges = slice_edges(numbers, many, **options) if many else {}
    names = [f"n{j}" for j in range(d)]
    ranked = F.array(*[F.col(f"cum_{n}") - F.col(n) / 2 + 0.5 for n in names]).alias("rank")

    def long(of: Sequence[str]) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).alias("value")) for v in of]))

    def ranks(of: Sequence[str], edges: dict) -> DataFrame:
        counted = numbers.select(long(of), *[h.alias(f"h{j}") for j, h in enumerate(has)])
        totals = running_totals(counted, "value", {n: F.sum(f"h{j}") for j, n in enumerate(names)}, edges, feature="feature")
        return totals.select("feature", "value", ranked)

    if len(many) <= JOINED_COLUMNS:
        # Equal rows are one row with a weight, so that a frequent value moves once per combination.
        of = numbers.groupBy(*values).agg(F.count("*").alias("w")) if many else numbers.withColumn("w", F.lit(1))
        if few:
            known = ranks(few, {}).toPandas()  # about SHARED_RANKS numbers
            for v in few:
                table = known.loc[known["feature"] == v, ["value", "rank"]].assign(rank=lambda t: t["rank"].map(list))
                shared = df.sparkSession.createDataFrame(table, f"_{v} double, r{v[1:]} array<double>")
                of = of.join(F.broadcast(shared), F.col(v) == F.col(f"_{v}"), "left").drop(f"_{v}")
        for v in many:
            own = ranks([v], {v: edges[v]}).select(F.col("value").alias(f"_{v}"), F.col("rank").alias(f"r{v[1:]}"))
            there = of.filter(F.col(v).isNotNull()).join(own, F.col(v) == F.col(f"_{v}")).drop(f"_{v}")
            # Rows without a value have no rank: they never meet in one task.
            of = there.unionByName(of.filter(F.col(v).isNull()).withColumn(f"r{v[1:]}", F.lit(None).cast("array<double>")))
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"r{i}").alias("rank")) for i in range(d)])
        again = of
        if d > NATIVE_COLUMNS:
            again = of.select("w", F.filter(cells, lambda cell: cell.getField("rank").isNotNull()).alias("r")).filter(F.size("r") > 0)
    else:
        # Equal rows are one row with a weight, known by two hashes of all their cells.
        cells = [*values, *[F.isnull(v) for v in values]]
        rows = numbers.groupBy(*values).agg(F.count("*").alias("w")).select("*", F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))
        placed = rows.select("a", "b", "w", long(values)).filter(F.col("value").isNotNull()).join(ranks(values, edges), ["feature", "value"])
        again = placed.groupBy("a", "b").agg(F.first("w").alias("w"), F.collect_list(F.struct(F.substring("feature", 2, 9).cast("int").alias("i"), "rank")).alias("r"))
        if d <= NATIVE_COLUMNS:
            again = again.select("w", *[F.get(F.filter("r", _of_column(at)), F.lit(0)).getField("rank").alias(f"r{at}") for at in range(d)])
    i, j = np.triu_indices(d)
    if d <= NATIVE_COLUMNS:

        def rank(a: int, b: int) -> Column:
            return F.when(F.col(f"r{b}").isNotNull(), F.get(f"r{a}", F.lit(b)) - float(middle[a, b]))

        cells = [F.struct(F.lit(int(a)).alias("i"), F.lit(int(b)).alias("j"), *[F.sum(F.col("w") * x * y).alias(n) for n, x, y in (
            ("ab", rank(a, b), rank(b, a)), ("aa", rank(a, b), rank(a, b)), ("bb", rank(b, a), rank(b, a)))]) for a, b in zip(i, j)]
        return _named(again.agg(F.array(*cells).alias("c")).select(F.inline("c")), cols, _rank_correlation().alias("r"))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, square = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.iloc[first : first + 2048]
                rank, there = np.zeros((len(part), d, d)), np.zeros((len(part), d))
                for n, (at, found) in enumerate(zip(part["i"], part["rank"])):
                    at = np.asarray(at)
                    rank[n, at] = np.stack(found) - middle[at]
                    there[n, at] = 1
                rank *= there[:, None, :]
                weighted = rank * part["w"].to_numpy(dtype=float)[:, None, None]
                both += (weighted * rank.transpose(0, 2, 1)).sum(axis=0)
                square += (weighted * rank).sum(axis=0)
        yield pd.DataFrame({"i": i, "j": j, "ab": both[i, j], "aa": square[i, j], "bb": square[j, i]})

    parts = again.select("w", F.col("r.i").alias("i"), F.col("r.rank").alias("rank")).mapInPandas(block, "i int, j int, ab double, aa double, bb double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])
    return _named(sums, cols, _rank_correlation().alias("r"))


def _of_column(at: int) -> Callable[[Column], Column]:
    return lambda cell: cell.getField("i") == at


def _rank_correlation() -> Column:
    return F.when(F.col("i") == F.col("j"), F.when(F.col("aa") > 0, 1.0)).otherwise(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")))


def complete_spearman(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    names = [f"_r{i}" for i in range(len(cols))]
    ranked = _ranked(df, cols, **options)
    if len(cols) > NATIVE_COLUMNS:
        return _normalize(_block_pairs(_packed(ranked, names, "_w"), [0.0] * len(cols)), cols)
    pairs = _native_pairs(ranked, names, lambda a, b: F.sum(F.col("_w") * a * b), scaled=True)
    named = F.create_map(*[F.lit(x) for pair in zip(names, cols) for x in pair])
    return pairs.select(
        F.element_at(named, F.col("var_i")).alias("var_i"), F.element_at(named, F.col("var_j")).alias("var_j"), F.col("s").alias("r")
    )


def to_matrix(pairs: DataFrame, cols: Sequence[str], measure: str = "r") -> np.ndarray:
    """The long table as a symmetric D x D array on the driver; NULL becomes NaN."""
    place = {c: i for i, c in enumerate(cols)}
    out = np.full((len(cols), len(cols)), np.nan)
    for row in pairs.collect():
        i, j = place[row["var_i"]], place[row["var_j"]]
        out[i, j] = out[j, i] = np.nan if row[measure] is None else row[measure]
    return out
