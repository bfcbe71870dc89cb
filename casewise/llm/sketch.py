"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests [native].

A paragraph is a line or, within it, a sentence. A sketch has 24 cells in three ranges; each digest
lies in one cell of each range, which holds a count, the xor of its digests and the xor of their checks.
Sketches subtract cell by cell, and peeling cells of one digest recovers the difference. A difference that does
not peel is tried again in the same row with a larger sketch, made of several that share the digests by hash;
only those parts of it that still do not peel grow further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.llm.common import body, bound, row_key, saved, small

CELLS = 24
# A grown sketch consists of parts of so many cells, for about so many digests each.
PART_CELLS = 12
LOAD = 2
MOST_PARTS = 256
RETRIES = 3
CHUNK = 10_000
ENDS = r"(?<=[.!?])\s+|\n"


def digests(text: Column) -> Column:
    parts = F.filter(F.split(text, ENDS), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _place(digest: Column, third: int, width: int) -> Column:
    return (F.pmod(F.xxhash64(digest, F.lit(third)), F.lit(width)) + third * width).cast("int")


def _empty(size: int = CELLS) -> Column:
    return F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check")), size)


def _toggle(cells: Column, digest: Column, sign: Column, size: int = CELLS) -> Column:
    """The digest put into its three cells (or taken out, by sign)."""
    return bound(
        F.struct(*[_place(digest, t, size // 3).alias(f"p{t}") for t in range(3)], F.xxhash64(digest, F.lit("check")).alias("check")),
        lambda at: F.transform(
            cells,
            lambda c, i: F.when(
                (i == at["p0"]) | (i == at["p1"]) | (i == at["p2"]),
                F.struct((c["n"] + sign).alias("n"), c["key"].bitwiseXOR(digest).alias("key"), c["check"].bitwiseXOR(at["check"]).alias("check")),
            ).otherwise(c),
        ),
    )


def sketch(items: Column) -> Column:
    return F.aggregate(items, _empty(), lambda cells, d: _toggle(cells, d, F.lit(1)))


def held(cells: Column) -> Column:
    """How many digests a sketch holds, by the counts of its first range."""
    return F.aggregate(F.slice(cells, 1, CELLS // 3), F.lit(0), lambda n, c: n + c["n"])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            (x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")
        ),
    )


def _pure(c: Column) -> Column:
    return (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"], F.lit("check")) == c["check"])


def peel(difference: Column, size: int = CELLS) -> Column:
    """The digests in which two sketches differ; null if the cells do not come out empty.

    Each step takes out the digests of all cells that hold just one; without such cells the steps that are left do nothing.
    """

    def step(a: Column, _: Column) -> Column:
        alone = F.array_distinct(F.transform(F.filter(a["cells"], _pure), lambda c: F.struct(c["n"].alias("sign"), c["key"].alias("digest"))))
        taken = bound(
            alone,
            lambda pure: F.struct(
                F.aggregate(pure, a["cells"], lambda cells, d: _toggle(cells, d["digest"], -d["sign"], size)).alias("cells"),
                F.concat(a["found"], F.transform(pure, lambda d: d["digest"])).alias("found"),
                (F.size(pure) > 0).alias("live"),
            ),
        )
        return F.when(a["live"], taken).otherwise(a)

    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("live"))
    clean = lambda a: F.when(~F.exists(a["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)), a["found"])
    # A step that takes something out leaves a used cell empty, so there are no more such steps than cells.
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step, clean)


def _signed(a: Column, b: Column) -> Column:
    side = lambda items, sign: F.transform(items, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))
    return F.concat(side(a, 1), side(b, -1))


def _parts(items: Column, level: int) -> Column:
    """Signed digests dealt by hash to about one list per ``LOAD`` of them, ``MOST_PARTS`` at most."""
    parts = F.least(F.lit(MOST_PARTS), F.floor(F.size(items) / F.lit(LOAD)).cast("int") + 2)

    def dealt(x: Column) -> Column:
        part = lambda d: F.pmod(F.xxhash64(d["digest"], F.lit("part"), F.lit(level)), x["parts"])
        return F.transform(x["items"], lambda d: F.struct(d["digest"].alias("digest"), d["sign"].alias("sign"), part(d).alias("part")))

    return bound(
        F.struct(items.alias("items"), parts.alias("parts")),
        lambda x: bound(dealt(x), lambda all_: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: F.filter(all_, lambda d: d["part"] == p))),
    )


def _apart(items: Column) -> Column:
    """The digests of one sign only: for parts that no sketch has peeled."""
    of = lambda sign: F.transform(F.filter(items, lambda d: d["sign"] == sign), lambda d: d["digest"])
    return F.concat(F.array_except(of(1), of(-1)), F.array_except(of(-1), of(1)))


def _grown(items: Column, level: int) -> Column:
    """The difference of signed digests by a sketch of several parts, each of which grows again if it does not peel."""

    def solve(part: Column) -> Column:
        cells = F.aggregate(part, _empty(PART_CELLS), lambda c, d: _toggle(c, d["digest"], d["sign"], PART_CELLS))
        again = _grown(part, level + 1) if level < RETRIES else _apart(part)
        found = bound(cells, lambda c: peel(c, PART_CELLS))
        return F.when(F.size(part) == 0, F.array().cast("array<bigint>")).otherwise(F.coalesce(found, again))

    return F.flatten(F.transform(_parts(items, level), solve))


def differences(a: Column, b: Column, cells: Column) -> Column:
    """The digests in which two lists differ, from ``cells``, the subtracted sketches of the lists.

    A difference that does not peel is sketched anew with about ``PART_CELLS / LOAD`` cells a digest, then parts that do
    not peel again, ``RETRIES`` times. A part that never peels (two digests that share all cells and all parts:
    below 1e-5) is compared as a list.
    """
    return F.coalesce(bound(cells, lambda c: peel(c)), _grown(_signed(a, b), 1))


def _bounds(ids: DataFrame, parts: int) -> tuple[list, int]:
    """Quantiles of the ids that cut them into ``parts`` ranges, and the ranges that null ids fill."""
    shares = [i / parts for i in range(1, parts)]
    n, known, cuts = ids.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", shares, 10 * parts)).first()
    return cuts or [], -(-parts * (n - known) // n) if n else 0


def _range(cuts: list, nulls: int) -> Column:
    """The range of a row in the order of id and ``_k``; ids that hold several cuts, and null ids, are cut by ``_k``."""
    high = F.shiftright(F.col("_k"), 32) + F.lit(1 << 31)
    slice_of = lambda n: F.shiftright(high * n, 32)
    if not cuts:
        return slice_of(F.lit(max(nulls, 1))).cast("int")
    table = F.array(*map(F.lit, cuts))
    # Powers of two below the number of cuts: a binary search for the cuts below the id, and for those up to it.
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    before = lambda ok: F.aggregate(
        powers, F.lit(0), lambda at, p: F.when((at + p <= len(cuts)) & ok(F.get(table, at + p - 1)), at + p).otherwise(at)
    )
    below, upto = before(lambda cut: cut < F.col("doc_id")), before(lambda cut: cut <= F.col("doc_id"))
    place = below + slice_of(F.greatest(upto - below, F.lit(1)))
    return F.when(F.col("doc_id").isNull(), slice_of(F.lit(max(nulls, 1)))).otherwise(place + nulls).cast("int")


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct row of ``doc_id, _k, _text`` with the text of its successor, and the keys of repeated rows.

    Rows are dealt by range of id, so a text moves once. The first row of each range also goes to the range before it
    (that of the first range to the last one), where it only serves as a successor.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("_part", _range(*_bounds(docs.select("doc_id"), parts)))
    keys = saved(docs.groupBy("_part", "doc_id", "_k").agg(F.count("*").alias("_times")))
    # One row per range.
    firsts = keys.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_k"))["_k"].alias("_k"))
    order = Window.orderBy("_part")
    last = F.last("_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guards = saved(firsts.select("_k", F.coalesce(F.lag("_part").over(order), last).alias("_guards")))
    repeated = keys.where("_times > 1").select("_k", "_times")
    once = docs.join(small(repeated), "_k", "left_anti")
    again = docs.join(small(repeated), "_k", "left_semi").dropDuplicates(["_k"])
    homes = F.array(F.struct(F.col("_part"), F.lit(False).alias("_guard")), F.struct(F.col("_guards").alias("_part"), F.lit(True).alias("_guard")))
    dealt = (
        once.unionByName(again)
        .join(small(guards), "_k", "left")
        .select("doc_id", "_k", "_text", F.inline(F.filter(homes, lambda h: h["_part"].isNotNull())))
        .repartition("_part")
    )
    inside = Window.partitionBy("_part").orderBy("_guard", F.col("doc_id").asc_nulls_first(), "_k")
    return dealt.withColumn("_next", F.lead("_text").over(inside)).where(~F.col("_guard")).select("doc_id", "_k", "_text", "_next"), repeated


def text_form(cells: str) -> Column:
    return F.array_join(
        F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["check"]))), "-"
    )


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Shared digests over all digests of both; 1 if neither has any."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likenesses.

    The edited text replaces the last quarter by the beginning of the next document. Null is the empty text, which
    has no digests; two empty texts have likeness 1. Rows with equal id and text count as one in the order and
    get equal results; null ids come first; a single document follows itself; an empty table gives no rows. Likeness
    comes from the digests that the sketches hold and those that peeling finds to differ. Very long texts are read
    whole, in one row. Other columns are ignored.
    """
    rows, repeated = with_next(docs.select("doc_id", row_key().alias("_k"), body().alias("_text")))
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter))
    texts = rows.select("doc_id", "_k", "_text", "_next", edited.alias("_edited"))
    lists = texts.select(
        "doc_id",
        "_k",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        *[digests(F.col(text)).alias(side) for side, text in (("own", "_text"), ("edited", "_edited"), ("next", "_next"))],
    )
    cells = lists.withColumns({f"{side}_cells": sketch(F.col(side)) for side in ("own", "edited", "next")})
    differing = {
        f"{side}_d": F.size(differences(F.col("own"), F.col(side), subtract(F.col("own_cells"), F.col(f"{side}_cells")))) for side in ("edited", "next")
    }
    out = cells.withColumns(differing)
    if not repeated.isEmpty():
        # A row that repeats very often is written by several tasks.
        out = out.join(small(repeated), "_k", "left").withColumn("_times", F.coalesce("_times", F.lit(1)))
        out = out.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / CHUNK)))).repartition("_k", "_chunk")
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("_times") - F.col("_chunk") * CHUNK))))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form("own_cells").alias("fingerprint"),
        text_form("edited_cells").alias("edited_fingerprint"),
        likeness(held(F.col("own_cells")), held(F.col("edited_cells")), F.col("edited_d")).alias("near_edited"),
        likeness(held(F.col("own_cells")), held(F.col("next_cells")), F.col("next_d")).alias("near_next"),
    )
