"""Officers of a company: matching the applicant and grading nationalities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions import name_score, worst_in_array
from casewise.operators.frames import left_join_spread


def match_person(people: str, first: str, last: str, born: str, threshold: int = 90, field: str = "nationalities") -> Column:
    """Nationalities (or another ``field``) of the first officer born in the applicant's month and year whose
    first and last name both score ``threshold`` or more; NULL without one.

    Officers of a row are compared with that row's applicant only, inside the row.
    """
    birthday = F.col(born).cast("date")

    def fits(p: Column) -> Column:
        # No NULL: that would have the names compared.
        same_month = F.coalesce(F.trunc(p["born"], "month") == F.trunc(birthday, "month"), F.lit(False))
        return same_month & (name_score(p["first"], F.lower(first)) >= threshold) & (
            name_score(p["last"], F.lower(last)) >= threshold
        )

    return F.get(F.filter(F.col(people), fits), F.lit(0)).getField(field)


def nationality_level(nationalities: Column, countries: Mapping[str, str]) -> Column:
    """Worst level of a list of country codes; unknown codes and no list are Undefined."""
    table = F.create_map(*[F.lit(v) for pair in countries.items() for v in pair])
    return worst_in_array(F.transform(nationalities, lambda c: F.try_element_at(table, c)))


def nationality_levels_join(df: DataFrame, nationalities: str, countries: DataFrame, out: str) -> DataFrame:
    """As :func:`nationality_level` with a ``(code, level)`` table of any size; equal lists are graded once."""
    lists = df.select(F.col(nationalities).alias("_key")).where("size(_key) > 0").distinct()
    codes = lists.select("_key", F.explode("_key").alias("code"))
    worst = (
        codes.join(countries, "code")
        .groupBy("_key")
        .agg(F.min(F.when(F.col("level") == "High", 1).when(F.col("level") == "Medium", 2).when(F.col("level") == "Low", 3)).alias("_n"))
    )
    label = F.when(F.col("_n") == 1, "High").when(F.col("_n") == 2, "Medium").when(F.col("_n") == 3, "Low")
    joined = left_join_spread(df, worst, nationalities, "_key")
    return joined.withColumn(out, F.coalesce(label, F.lit("Undefined"))).drop("_key", "_n")
