"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "talentweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library expects; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a test folder in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="talentweave-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """Path below the shared folder, private to this application."""
    return "/".join([shared_folder(spark).rstrip("/"), spark.sparkContext.applicationId, *parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call returned."""
    return scratch_path(spark, f"{name}-{os.urandom(6).hex()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later steps read the rows, and keep their partitioning."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small table out to all cores. A large one comes in enough row groups and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


#: Codec of written tables.
PACKED = "zstd"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it is over, not when the driver happens to collect its garbage. For plans that run only once."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


_written: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` to the shared folder the first time, read the table back afterwards.

    This cuts the lineage of tables that many queries start from; the files outlive lost executors.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:10]
        path = fresh_path(spark, f"{name}-{tag}")
        rows = build()
        with shuffles_dropped(spark):
            rows.write.mode("errorifexists").option("compression", PACKED).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table written here, so that what their making shuffled is gone before the next step."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settled_for_now(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``settled``, with the table gone afterwards."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    try:
        with shuffles_dropped(spark):
            df.write.option("compression", PACKED).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_landed: dict[tuple[str, str, str], str] = {}


def landed_once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of input files that ``write(path)`` makes the first time."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = fresh_path(spark, name)
        with shuffles_dropped(spark):
            write(path)
        _landed[key] = path
    return _landed[key]
