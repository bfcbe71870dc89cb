"""The training-corpus pipeline: language, near duplicates, benchmarks, mixture, token file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm import decontaminate as bench
from casewise.llm import jaccard, language, mixing, rans
from casewise.llm.common import row_key, shared_folder, table

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised with a posterior of ``LEAST_SCORE`` or more."""
    model = language.train(docs.where(language.learnable()).select("doc_id", "text", "lang"))
    judged = language.detect(docs.select(F.struct(*docs.columns).alias("row"), "text"), *model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows packed, so that none of their columns clashes with the key."""
    return docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("_row_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, the first by (id with nulls last, row key); of rows equal in id and text, one."""
    chosen = jaccard.classes(docs.select("doc_id", "text")).where("chosen").select(F.col("k").alias("_row_key")).distinct()
    # Repeated rows go before the join, so that many of them never meet in one task.
    return keyed(docs).dropDuplicates(["_row_key"]).join(chosen, "_row_key", "left_semi").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the contamination rule marks, whatever their ids; others with the same id stay."""
    found = bench.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    marked = found.where(bench.is_contaminated()).select(F.col("k").alias("_row_key")).distinct()
    return keyed(docs).join(marked, "_row_key", "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns one row per document as read back from it."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rans.write(docs, folder)
    return rans.read_digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_file", token_file),
]

# Learned pieces, MinHash classes and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
