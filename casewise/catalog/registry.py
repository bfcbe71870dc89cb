"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one directory as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._path}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: build(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r6(col: str | Column) -> Column:
    """Six decimals, so both engines print the same number; adding 0 turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)
