"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one of our own only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for saved rows if there are few of them; else AQE chooses the join."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def body(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: str | Column = "text") -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(body(col), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also when lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Equal for repeated rows only; null ids are told apart by their text."""
    return F.xxhash64(F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
