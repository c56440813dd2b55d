"""Tables made of folders, and the ledger that says which folders count.

A table ``t`` below a base folder holds its rows in folders such as ``t/run=3``. The ledger is a table of small files below ``_ledger``; one commit is
one file with all its rows, so that it is there as a whole or not at all. A folder counts from the commit that adds it to the one that
removes it: rows of a run that broke off, or of files that were merged into others, are never read together with the rows that replace
them. One writer at a time may commit; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at timestamp, run long, action string, table string, path string"
ADD, REMOVE = "add", "remove"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All commits so far; none if there is no ledger yet."""
    try:
        return spark.read.schema(SCHEMA).json(f"{folder}/_ledger")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SCHEMA)
        raise


def commit(spark: SparkSession, folder: str, run: int, added: dict[str, str], removed: Iterable[tuple[str, str]] = ()) -> None:
    """Put ``added`` (folder by table) in and take ``removed`` (table, folder) out, in one step."""
    rows = [(run, ADD, t, p) for t, p in added.items()] + [(run, REMOVE, t, p) for t, p in removed]
    table = spark.createDataFrame(rows, "run long, action string, table string, path string")
    table.select(F.current_timestamp().alias("at"), "*").coalesce(1).write.mode("append").json(f"{folder}/_ledger")


def written(spark: SparkSession, folder: str) -> set[tuple[int, str]]:
    """``(run, table)`` of every folder that was ever added by a run of its own, also if a merged folder took its place."""
    rows = entries(spark, folder).groupBy("run").agg(
        F.collect_set(F.when(F.col("action") == ADD, F.col("table"))).alias("tables"), F.count_if(F.col("action") == REMOVE).alias("gone"))
    return {(r["run"], t) for r in rows.where("gone = 0").collect() for t in r["tables"]}


def next_run(spark: SparkSession, folder: str) -> int:
    """A number above that of every commit."""
    return 1 + (entries(spark, folder).agg(F.max("run")).first()[0] or 0)


def live(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """``(run, table, path)`` of the folders that count, by run; paths are below ``folder``."""
    found = entries(spark, folder).groupBy("table", "path").agg(
        F.max(F.when(F.col("action") == ADD, F.col("run"))).alias("run"), F.max((F.col("action") == REMOVE).cast("int")).alias("gone"))
    # One row for each run and table: the number of runs, not of documents.
    return sorted((r["run"], r["table"], r["path"]) for r in found.where("gone = 0 and run is not null").collect())


def read(spark: SparkSession, folder: str, table: str, ddl: str | None = None) -> DataFrame | None:
    """The rows of the folders that count, or None without any. Partition columns below a folder stay columns."""
    paths = [f"{folder}/{p}" for _, t, p in live(spark, folder) if t == table]
    if not paths:
        return None
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.option("basePath", f"{folder}/{table}").parquet(*paths)


@contextmanager
def packed_scans(spark: SparkSession, file_bytes: int) -> Iterator[None]:
    """Let scans pack files by size into partitions of about ``file_bytes``, so that a write after it needs no shuffle to merge them."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(file_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def compact(spark: SparkSession, folder: str, table: str, *partition: str, file_bytes: int = 128 << 20) -> int:
    """Put the rows of all folders of a table into one new folder of larger files, and swap them in one commit; gives its run.

    A reader that listed the folders before the commit reads the old ones, which stay on disk, and one that lists them later the new one.
    A run that breaks off before the commit leaves a folder that doesn't count.
    """
    old = [p for _, t, p in live(spark, folder) if t == table]
    run = next_run(spark, folder)
    target = f"{table}/run={run}"
    with packed_scans(spark, file_bytes):
        read(spark, folder, table).drop("run").write.mode("overwrite").partitionBy(*partition).parquet(f"{folder}/{target}")
    commit(spark, folder, run, {table: target}, [(table, p) for p in old])
    return run
