"""Mixing sources to target weights [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.llm.common import body, saved, small

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20_24


def text_size(col: str = "text") -> Column:
    return F.regexp_count(body(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of ``(source, source_size)`` rows.

    A target is ``min(most * size, level * weight)``, with the one level at which the
    targets add up to all sizes. Sources that stop come first in the order of
    ``most * size / weight``, so running sums over that order give the level.
    The windows see one row per source. An empty source gets 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * F.lit(float(most))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sizes.withColumn("_n", F.row_number().over(by_name))
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_ratio", cap / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_free", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_capped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_free"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
    )
    target = F.least(cap, F.coalesce(F.col("_level") * F.col("_weight"), cap))
    return out.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows with ``_size, _source_size, _target, _copies`` added."""
    sizes = docs.select("source", text_size().alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = saved(source_targets(sizes, weights, most)).toDF("_source", "_source_size", "_target")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (
        docs.withColumns({"_size": text_size(), "_draw": draw})
        .join(small(targets), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_copies", (F.floor("_rate") + (F.col("_draw") < F.col("_rate") - F.floor("_rate")).cast("long")).cast("int"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``doc_id, text, source`` with its size, its source's target, and its copies.

    Copies are ``floor(rate)`` plus one with probability ``rate - floor(rate)``, drawn from a
    hash of id, text and seed, so reruns agree and repeated rows draw alike. A null text has size 0,
    a null source is a source of its own, an empty table gives no rows. Other columns are ignored.
    """
    return with_copies(docs.select("doc_id", "text", "source"), **options).select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows themselves, each as often as the mix takes it, columns unchanged whatever their names.

    A row without words has no size and is taken like others of its source; null texts, null sources, repeated rows
    and empty tables are as in ``mix``. Texts of any length are carried whole.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    rows = with_copies(packed, **options).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
