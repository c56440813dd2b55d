"""Tables on disk: envelopes, appends, partition reads, compaction, match files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.schemas import ENVELOPE, parsed
from talentweave.sources.ledger import packed_scans

ROWS_PER_FILE = 1_000_000


def decode_envelope(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns from messages whose ``value`` is JSON bytes or text."""
    data = F.from_json(F.col(value).cast("string"), parsed(ENVELOPE))
    return messages.select(data.alias("data")).select("data.*")


def to_key_value(df: DataFrame, payload: Column, name: str) -> DataFrame:
    """``key`` and JSON ``value`` with id, payload and source."""
    body = F.struct(F.col("id"), payload.alias(name), F.col("source"))
    return df.select(F.col("id").alias("key"), F.to_json(body).alias("value"))


def topic_of(category: Column) -> Column:
    return F.when(category == "job", K.TOPIC_JOBS).otherwise(K.TOPIC_RESUMES)


def producer_to_topic(envelopes: DataFrame) -> DataFrame:
    """``(topic, key, value)`` rows, ready for a message sink or a landing table partitioned by topic."""
    body = F.to_json(F.struct("id", "raw_data", "source", "type", "category"))
    return envelopes.select(topic_of(F.col("category")).alias("topic"), F.col("id").alias("key"), body.alias("value"))


def write_topics(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").partitionBy("topic").parquet(path)


def with_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.left("id", F.lit(1)))


def append_partitioned(df: DataFrame, path: str) -> None:
    """Append, one folder per kind of document."""
    with_kind(df).write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("kind").parquet(path)


def read_table_partitions(spark: SparkSession, path: str, prefix: str, ddl: str) -> DataFrame:
    """Rows whose id starts with ``prefix``; only that folder is read. A missing table gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.schema(f"{ddl}, kind string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ddl)
        raise
    return table.where(F.col("kind") == prefix).drop("kind")


def compact_tables(spark: SparkSession, path: str, target: str, file_bytes: int = 128 << 20) -> DataFrame:
    """Write the table to a new folder in files of about ``file_bytes``; the old one stays untouched.

    The scan packs files by their sizes into tasks and each task writes what it read: no count, no shuffle. Tables of a ledger
    are merged in place by ``ledger.compact``.
    """
    with packed_scans(spark, file_bytes):
        spark.read.parquet(path).write.mode("errorifexists").partitionBy("kind").parquet(target)
    return spark.read.parquet(target)


def write_matches(matches: DataFrame, path: str) -> None:
    """Append in one layout, whatever the number of queries, so that all appends are read together."""
    matches.write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)
