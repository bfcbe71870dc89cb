"""JSON text: paths, feature cells and officer lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.predicates import _bind, _c

__all__ = ["json_get", "mean_age", "parse_people", "unwrap_cells"]

CELL = "struct<input:string,output:struct<value:string,error:string>>"
PEOPLE = (
    "array<struct<officerId:string,person:struct<firstName:string,lastName:string,"
    "dateOfBirth:string,nationalities:array<string>>>>"
)


def json_get(col: str | Column, path: str, kind: str = "string") -> Column:
    """Typed value at ``path``; bad JSON, a missing path and a wrong type all give NULL."""
    return F.try_variant_get(F.try_parse_json(_c(col)), path, kind)


def unwrap_cells(
    df: DataFrame, cols: Sequence[str], parts: Sequence[str] = ("value",)
) -> DataFrame:
    """Replace JSON feature cells by their ``value``, ``error`` and ``input`` parts.

    With the single part ``value`` columns keep their names; otherwise each part gets
    a suffix. All cells are parsed in one projection.
    """
    paths = {"value": "output.value", "error": "output.error", "input": "input"}
    wanted = []
    for c in df.columns:
        if c not in cols:
            wanted.append(F.col(c))
            continue
        cell = F.from_json(F.col(c), CELL)
        for part in parts:
            value = cell
            for step in paths[part].split("."):
                value = value.getField(step)
            wanted.append(value.alias(c if list(parts) == ["value"] else f"{c}_{part}"))
    return df.select(*wanted)


def parse_people(col: str | Column) -> Column:
    """Officer list as ``array<struct<id, first, last, born, nationalities>>``.

    Bad JSON or one officer without a usable birth date makes the whole list NULL. If an
    officer id repeats, the last entry wins and keeps the first one's place.
    """
    raw = F.from_json(_c(col), PEOPLE)
    people = F.transform(
        raw,
        lambda o: F.struct(
            F.coalesce(o.officerId, F.lit("")).alias("id"),
            F.lower(F.coalesce(o.person.firstName, F.lit(""))).alias("first"),
            F.lower(F.coalesce(o.person.lastName, F.lit(""))).alias("last"),
            o.person.dateOfBirth.try_cast("date").alias("born"),
            F.coalesce(o.person.nationalities, F.array().cast("array<string>")).alias("nationalities"),
        ),
    )

    def last_by_id(found: Column) -> Column:
        ids = F.array_distinct(F.transform(found, lambda p: p["id"]))
        rows = F.transform(ids, lambda i: F.element_at(F.filter(found, lambda p: p["id"] == i), -1))
        return F.when(~F.exists(found, lambda p: p["born"].isNull()), rows)

    return _bind(people, last_by_id)


def mean_age(people: str | Column, at: str | Column, fallback_born: str | Column, first_only: bool = False) -> Column:
    """Whole mean years of the officers, counted from the first of their birth month.

    Without officers the applicant's own birth date is used. ``first_only`` takes the
    first officer's age instead of the mean.
    """
    year_days = 365.2425  # mean Gregorian year
    when = _c(at).cast("date")
    ages = F.transform(
        _c(people), lambda p: F.date_diff(when, F.trunc(p["born"], "month")) / F.lit(year_days)
    )
    many = F.try_element_at(ages, F.lit(1)) if first_only else (
        F.aggregate(ages, F.lit(0.0), lambda s, a: s + a) / F.size(ages)
    )
    own = F.date_diff(when, _c(fallback_born).cast("date")) / F.lit(year_days)
    return F.when(F.size(_c(people)) > 0, many).otherwise(own).cast("int")
