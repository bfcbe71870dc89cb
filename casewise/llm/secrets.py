"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import body, bound

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# Least entropy of a window, in bits, by the narrowest class that holds the candidate.
CLASSES = ((r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.8))
# Plain words (lower, upper or capitalised), numbers and UUIDs are no secrets.
PLAIN = r"[A-Z]?[a-z]++|[A-Z]++"
JOINTS = r"[/_=+-]++"
ALLOWED = rf"^(?:{JOINTS})?+(?:(?:{PLAIN})(?:{JOINTS}|$))++$|^[0-9/_=+-]+$|^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$"
SAMPLE = r"(?i:example|sample|placeholder)"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, pattern: str, rank: int, value_group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has ``least`` characters or more.

    Their places follow from the lengths of the matches and of what lies between them.
    """

    def placed(found: Column) -> Column:
        whole, value, between = found[0], found[1], found[2]
        walk = F.aggregate(
            F.sequence(F.lit(0), F.size(whole) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
            lambda a, i: bound(
                a["at"] + F.char_length(between[i]),
                lambda start: F.struct(
                    (start + F.char_length(whole[i])).alias("at"),
                    F.when(
                        F.char_length(value[i]) >= least,
                        F.concat(
                            a["spans"],
                            F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(whole[i])).alias("end"))),
                        ),
                    )
                    .otherwise(a["spans"])
                    .alias("spans"),
                ),
            ),
        )
        return walk["spans"]

    found = F.array(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)),
        F.split(text, pattern, -1),
    )
    return F.when(text.rlike(pattern), bound(found, placed)).otherwise(F.array().cast(SPAN))


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, over windows of ``width`` characters.

    Each step adds one character's count and takes one away; the sum of ``c * log2(c)`` follows by differences.
    """

    def g(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)

    def highest(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            new = codes[i]
            old = F.when(i >= width, codes[i - width]).otherwise(F.lit(-1))
            had = a["counts"][new]
            left = F.when(i >= width, a["counts"][old] + (old == new).cast("int"))
            total = a["sum"] + g(had + 1) - g(had) + F.when(i >= width, g(left - 1) - g(left)).otherwise(0.0)
            return bound(
                total,
                lambda t: F.struct(
                    F.transform(a["counts"], lambda c, at: c + (at == new).cast("int") - (at == old).cast("int")).alias("counts"),
                    t.alias("sum"),
                    F.when(i >= width - 1, F.greatest(a["best"], F.log2(F.lit(float(width))) - t / width)).otherwise(a["best"]).alias("best"),
                ),
            )

        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: a["best"])

    return bound(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)), highest)


def is_sample(value: Column) -> Column:
    """A documentation sample: the longest part that is no plain word says so, and no other is as long as a window.

    Labels around a value (``sample_key=``, ``/example/``) are plain words and say nothing of it.
    """
    parts = F.filter(F.split(value, JOINTS), lambda p: ~p.rlike(f"^(?:{PLAIN})$"))

    def longest(of: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(of, F.char_length)), F.lit(0))

    return bound(
        parts,
        lambda a: longest(F.filter(a, lambda p: ~p.rlike(SAMPLE))) < F.least(F.lit(WINDOW), longest(F.filter(a, lambda p: p.rlike(SAMPLE)))),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` per row of ``doc_id, text``; spans are (start, rank in KINDS, end) in code points, ends exclusive.

    Fixed patterns always stay. A candidate string adds an ``entropy`` span if it is not on the allow list,
    overlaps no fixed span, and one of its windows reaches its class's entropy. A null text is empty;
    repeated rows give equal results; other columns are ignored.
    """
    text = F.col("_text")
    base = F.concat(matches(text, ASSIGN, 0, 2, 12), matches(text, ACCESS, 1, 0, 18), matches(text, HEX.replace("+", "{16,}"), 2, 0, 16))

    def wild(s: Column) -> Column:
        value = F.substring(text, s.start + 1, s.end - s.start)

        def judged(v: Column) -> Column:
            need = F.when(v.rlike(CLASSES[0][0]), CLASSES[0][1]).when(v.rlike(CLASSES[1][0]), CLASSES[1][1]).otherwise(CLASSES[2][1])
            return F.when(v.rlike(ALLOWED) | is_sample(v), F.lit(False)).otherwise(window_entropy(v) >= need)

        free = ~F.exists("_base", lambda b: (b.start < s.end) & (s.start < b.end))
        return F.when(free, bound(value, judged)).otherwise(F.lit(False))

    return (
        docs.select("doc_id", body().alias("_text"))
        .withColumn("_base", base)
        .withColumn("_more", F.filter(matches(text, CANDIDATE, 3), wild))
        .select("doc_id", F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", "_more")).alias("spans"))
    )


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s.start.cast("string"), s.end.cast("string"))), ",")


def how_many(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
