"""Stages that turn ``documents`` into packed training sequences.

Documents that fail the quality rules go, one document of each group of near copies stays, documents with benchmark passages go, personal
data is replaced by its kind, and what is left is packed. Every stage reads all rows that the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import host_rules, leaks, near_copies, packing, private, tokens
from talentweave.llm.common import table
from talentweave.session import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = private.redact(docs, private.train(docs))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", hide_private),
    ("packing", pack),
]
#: The stages use trained models and Python, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each one's rows are written and read by the next."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, rows, sf_dir).write.mode("errorifexists").parquet(path)
        rows = spark.read.parquet(path)
    return rows
