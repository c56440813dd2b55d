"""Readers for résumé and posting files, and the union of all described inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentweave import constants as K
from talentweave.functions import text as T
from talentweave.schemas import POSTING_CSV
from talentweave.sources.files import whole_files
from talentweave.sources.ranges import RANGE_BYTES, file_records

CORRUPT = "_corrupt_record"
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One record per non-blank line; lines that are no JSON land in ``_corrupt_record``."""
    return spark.read.schema(f"{ddl}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_json_doc(spark: SparkSession, path: str, ddl: str, step: int = RANGE_BYTES) -> DataFrame:
    """Files that hold one object or a list of objects each; lists become rows. Large files are read by several tasks."""
    schema = StructType.fromDDL(f"{ddl}, {CORRUPT} string")
    parsed = F.from_json("record", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return file_records(spark, path, "json", step).select(parsed.alias("r")).select("r.*")


def _csv_rows(spark: SparkSession, path: str, step: int) -> DataFrame:
    """Text columns by the header of the first file. Large files are read by several tasks; fields may hold line ends."""
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    if not names:
        return spark.read.options(**CSV_OPTIONS).csv(path)
    # Fields by place, as names may hold any characters.
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("record", F.lit(ddl), {"escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = file_records(spark, path, "csv", step).where("pos > 0").select(parsed.alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])


def read_csv_column(spark: SparkSession, path: str, column: str = K.DEFAULT_CSV_COLUMN, step: int = RANGE_BYTES) -> DataFrame:
    """``raw_data`` from one text column of a CSV with header; null becomes empty."""
    return _csv_rows(spark, path, step).select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("raw_data"))


def read_posting_csv(spark: SparkSession, path: str, step: int = RANGE_BYTES) -> DataFrame:
    """The posting columns by their names in the header, in any order and beside others; a missing one is null."""
    rows = _csv_rows(spark, path, step)
    return rows.select(*[
        (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(POSTING_CSV)
    ])


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one record: ``raw_data`` and its ``path``."""
    if (files := whole_files(spark, path, text=True)) is not None:
        return files.select(F.col("content").cast("string").alias("raw_data"), "path")
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("value").alias("raw_data"), F.col("_metadata.file_path").alias("path"))


def read_binary_base64(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one record: its bytes as base64 text and its ``path``."""
    rows = whole_files(spark, path, text=False)
    if rows is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Depending on the session, base64 breaks its output into lines.
    return rows.select(F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("raw_data"), "path")


def _jsonl_envelope(spark: SparkSession, path: str, column: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(T.strip(F.col("value")) != "").select(F.col("value").alias("raw_data"))


def _json_envelope(spark: SparkSession, path: str, column: str) -> DataFrame:
    # A string field keeps a nested object as its JSON text; an item that is no JSON stays as it is.
    listed = F.from_json(F.concat(F.lit("["), "record", F.lit("]")), "array<string>")
    item = F.when(F.size(listed) == 1, F.get(listed, F.lit(0))).otherwise(F.col("record"))
    return file_records(spark, path, "json").select(F.when(F.col("pos") == 0, F.col("record")).otherwise(item).alias("raw_data"))


def _text_envelope(spark: SparkSession, path: str, column: str) -> DataFrame:
    return read_text_files(spark, path).select("raw_data")


def _pdf_envelope(spark: SparkSession, path: str, column: str) -> DataFrame:
    return read_binary_base64(spark, path).select("raw_data")


READERS = {
    "jsonl": _jsonl_envelope,
    "json": _json_envelope,
    "csv": read_csv_column,
    "txt": _text_envelope,
    "pdf": _pdf_envelope,
}


def ingest_union(spark: SparkSession, descriptors: list[dict]) -> DataFrame:
    """``(raw_data, source, type, category, error)`` of all described inputs that exist and have a known type.

    A descriptor has ``path``, ``source``, ``type``, and may have ``col`` and ``category`` (résumé when left out).
    Records of any size are taken; ``error`` is for later steps.
    """
    out = spark.createDataFrame([], "raw_data string, source string, type string, category string")
    for d in descriptors:
        reader = READERS.get(d["type"])
        if reader is None:
            continue
        try:
            rows = reader(spark, d["path"], d.get("col", K.DEFAULT_CSV_COLUMN))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        tags = [F.lit(d["source"]).alias("source"), F.lit(d["type"]).alias("type"), F.lit(d.get("category", "cv")).alias("category")]
        out = out.unionByName(rows.select("raw_data", *tags))
    return out.withColumn("error", F.lit(None).cast("string"))
