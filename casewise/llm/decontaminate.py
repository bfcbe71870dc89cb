"""Benchmark decontamination by a prefix-filtered containment join [native]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import bound, row_key, saved, small, words

WINDOW = 13
SHINGLE = 5


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(item_id, w, n)``: every window of an item as joined words, shorter items whole."""
    wanted = bound(
        words(),
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))),
                lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("w"), F.least(F.size(w), F.lit(window)).alias("n")),
            ),
        ),
    )
    return items.select("item_id", F.explode(wanted).alias("_s")).select("item_id", "_s.w", "_s.n").distinct()


def _shingles(tokens, size):
    """``(position from 1, hash)`` of all runs of ``size`` words."""
    return F.when(
        F.size(tokens) >= size,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - size + 1),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), F.slice(tokens, i, size)).alias("h")),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``doc_id, text``: its ``row_key`` ``k``, words, hit words, and the items that occur.

    A window lies in a text only if all its shingles do, so one shingle is the necessary prefix:
    the one fewest text positions hold. Its place in the window gives the only possible start,
    which must fit the text's length; the words there are then compared in full. Null and empty
    texts have no words and no hits; items without words have no windows; repeated rows are judged alike.
    """
    wins = saved(item_windows(items.select("item_id", "text"), window))
    sizes = [r[0] for r in wins.select(F.least("n", F.lit(shingle))).distinct().collect()]
    kinds = saved(wins.select("w", "n").distinct())

    def pieces(size: int) -> DataFrame:
        some = kinds.where(F.least("n", F.lit(shingle)) == size)
        return some.select("w", "n", F.explode(bound(F.split("w", " "), lambda t: _shingles(t, size))).alias("_s"))

    keyed = docs.select("doc_id", "text", row_key().alias("_k"))
    counts = keyed.select("doc_id", "_k", F.size(words()).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    if not sizes:
        return counts.select("doc_id", F.col("_k").alias("k"), "n_words", none.alias("n_hit"), F.array().cast("array<string>").alias("items"))
    parts = reduce(DataFrame.unionByName, map(pieces, sizes))
    parts = saved(parts.select("w", "n", F.col("_s.pos").alias("off"), F.col("_s.h").alias("h")))

    found = bound(words(), lambda t: F.concat(*[_shingles(t, size) for size in sizes]))
    known = small(saved(parts.select("h").distinct()))
    at = keyed.select("_k", F.explode(found).alias("_s")).select("_k", "_s.pos", "_s.h")
    hits = saved(at.join(known, "h"))
    often = hits.groupBy("h").count()
    rarest = (
        parts.join(often, "h", "left")
        .groupBy("w", "n")
        .agg(F.count("count").alias("_seen"), F.count(F.lit(1)).alias("_all"), F.min(F.struct("count", "off", "h")).alias("_m"))
        .where("_seen = _all")
        .select("w", "n", "_m.off", "_m.h")
    )
    start = F.col("pos") - F.col("off") + 1
    pairs = hits.join(small(saved(rarest)), "h").select("_k", start.alias("start"), "n", "w").where("start >= 1").distinct()
    texts = keyed.select("_k", "text").join(pairs.select("_k").distinct(), "_k", "left_semi").dropDuplicates(["_k"])
    wanted = pairs.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("start", "n", "w"))).alias("_c"))
    spans = saved(
        texts.join(wanted, "_k").select(
            "_k",
            bound(
                words(),
                lambda t: F.filter("_c", lambda c: (c.start + c.n - 1 <= F.size(t)) & (F.array_join(F.slice(t, c.start, c.n), " ") == c.w)),
            ).alias("_c"),
        )
    )
    covered = F.aggregate(
        "_c",
        F.struct(F.lit(0).alias("end"), none.alias("hit")),
        lambda a, c: F.struct(
            F.greatest(a.end, c.start + c.n - 1).alias("end"),
            (a.hit + F.greatest(c.start + c.n - 1 - F.greatest(a.end, c.start - 1), F.lit(0))).alias("hit"),
        ),
        lambda a: a.hit,
    )
    per_item = (
        spans.select("_k", F.explode("_c").alias("_s"))
        .select("_k", "_s.w")
        .distinct()
        .join(small(wins.select("w", F.col("item_id").cast("string").alias("item"))), "w")
        .groupBy("_k")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hit = spans.select("_k", covered.alias("n_hit")).join(per_item, "_k", "left")
    return counts.join(hit, "_k", "left").select(
        "doc_id",
        F.col("_k").alias("k"),
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
