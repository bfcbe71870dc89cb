"""Query, Parquet, CSV and model sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_query(
    spark: SparkSession,
    sql: str,
    args: dict | None = None,
    tables: dict[str, DataFrame] | None = None,
    fmt: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Run a SQL text with named parameters (``:from_date``) and return its rows.

    ``tables`` binds DataFrames used in the text as ``{name}``, so no global views
    are left behind. With ``fmt`` the text goes to an outside warehouse connector.
    """
    if fmt is not None:
        return spark.read.format(fmt).options(**(options or {})).option("query", sql).load()
    return spark.sql(sql, args=args, **(tables or {}))


def normalize_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Lower-case column names and keep the part after the last ``sep``."""
    names = [c.lower().split(sep)[-1] for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after normalisation: {twice}")
    return df.toDF(*names)


def read_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows with ``start <= ts < end``; a plain comparison, so Parquet can prune on it."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def rows_to_frame(spark: SparkSession, rows: Iterable, schema: str | StructType) -> DataFrame:
    """Small driver rows (a spine, a lookup) as a DataFrame with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and a declared schema, so ids such as ``00123`` stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """Save a Spark ML model, or a coefficient table as Parquet."""
    if isinstance(model, DataFrame):
        write_parquet(model, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, kind: str = "kmeans"):
    """Load what :func:`save_model` wrote; ``kind`` is ``kmeans`` or ``table``."""
    return KMeansModel.load(path) if kind == "kmeans" else spark.read.parquet(path)
