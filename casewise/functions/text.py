"""Text extraction and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewise.functions.predicates import _bind, _c

__all__ = [
    "contains_any",
    "email_domain",
    "extract_first",
    "name_score",
    "outward_code",
    "single_name",
    "startswith_any",
    "strip_chars",
]


def extract_first(col: str | Column, pattern: str = "[0-9]{4,}") -> Column:
    """First match in the trimmed text, NULL if there is none."""
    return F.regexp_substr(F.trim(_c(col)), F.lit(pattern))


def strip_chars(col: str | Column, pattern: str = r'[\s,"\]]') -> Column:
    return F.regexp_replace(_c(col), pattern, "")


def email_domain(col: str | Column, keep: Sequence[str] | None = None, other: str = "other") -> Column:
    """Text after the last ``@`` and then after the last ``#``; rare domains become ``other``."""
    domain = F.substring_index(F.substring_index(_c(col), "@", -1), "#", -1)
    if keep is None:
        return domain
    return F.when(domain.isin(list(keep)), domain).otherwise(F.lit(other))


def contains_any(col: str | Column, codes: Sequence[str], case: str | None = None) -> Column:
    """True if the text holds one of ``codes``; ``case`` is None, ``lower`` or ``upper``."""
    text = _c(col)
    text = {"lower": F.lower, "upper": F.upper}[case](text) if case else text
    hit = F.lit(False)
    for code in codes:
        hit = hit | F.coalesce(text.contains(code), F.lit(False))
    return hit


def startswith_any(col: str | Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.coalesce(_c(col).startswith(prefix), F.lit(False))
    return hit


def single_name(first: str | Column, last: str | Column) -> Column:
    """True unless both names are missing or both are given and not empty."""
    a, b = _c(first), _c(last)
    given = F.coalesce(a != "", F.lit(False)) & F.coalesce(b != "", F.lit(False))
    return ~((a.isNull() & b.isNull()) | given)


def outward_code(col: str | Column) -> Column:
    """Outward part of a postal code as ``struct(value, error)``.

    Texts of up to four characters are already outward; longer ones lose their last
    three characters. The result must have two to four characters.
    """
    text = F.regexp_replace(_c(col), r"^\s+|\s+$", "")
    packed = F.replace(text, F.lit(" "), F.lit(""))
    outward = F.when(F.length(text) <= 4, text).otherwise(
        F.when(F.length(packed) > 3, packed.substr(F.lit(1), F.length(packed) - 3)).otherwise("")
    )
    error = F.when(text.isNull() | (text == ""), "empty postcode").when(
        ~F.length(outward).between(2, 4), "outward part must have 2 to 4 characters"
    )
    return F.struct(F.when(error.isNull(), outward).alias("value"), error.alias("error"))


def _tokens(col: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))
    return F.array_sort(F.array_distinct(F.filter(F.split(clean, " "), lambda t: t != "")))


def name_score(left: str | Column, right: str | Column) -> Column:
    """Likeness of two names, 0 to 100.

    100 if they share a word. Otherwise the words of each are sorted and joined, the
    shorter text is slid along the longer one, and the score is the best
    ``1 - levenshtein / length`` of any window. NULL or empty names score 0.
    """

    def slide(pair: Column) -> Column:
        short, long = pair["short"], pair["long"]
        size = F.length(short)
        windows = F.transform(
            F.sequence(F.lit(1), F.length(long) - size + 1),
            lambda start: 1 - F.levenshtein(short, F.substring(long, start, size)) / size,
        )
        return F.floor(F.array_max(windows) * 100 + 0.5).cast("int")

    def score(words: Column) -> Column:
        a, b = words["a"], words["b"]
        x, y = F.array_join(a, " "), F.array_join(b, " ")
        swap = F.length(x) > F.length(y)
        pair = F.struct(F.when(swap, y).otherwise(x).alias("short"), F.when(swap, x).otherwise(y).alias("long"))
        empty = (F.coalesce(F.size(a), F.lit(0)) < 1) | (F.coalesce(F.size(b), F.lit(0)) < 1)
        return F.when(empty, 0).when(F.arrays_overlap(a, b), 100).otherwise(_bind(pair, slide))

    return _bind(F.struct(_tokens(_c(left)).alias("a"), _tokens(_c(right)).alias("b")), score)
