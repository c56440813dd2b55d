"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read back, so that no later step runs ``df`` again."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker; its users bound its size."""
    module = sys.modules.setdefault("talentweave_worker_cache", types.ModuleType("talentweave_worker_cache"))
    return module.__dict__.setdefault(name, {})


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time, as Python values."""
    for batch in batches:
        parts = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(p[i].as_py() for p in parts)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def positioned(df: DataFrame, order: list[str], name: str, position: str = "position") -> DataFrame:
    """Rows with their place in the given order, from 0, and written to the shared folder.

    The order should be total. Rows are dealt by ranges of the whole order, so equal leading keys spread over
    tasks; only the row count of each partition meets in one place.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    numbered = written(numbered, name)
    counts = numbered.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, start = 0, {}
    for r in sorted(counts):
        start[r["_p"]] = before
        before += r["n"]
    starts = df.sparkSession.createDataFrame(list(start.items()), "_p bigint, _start bigint")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p")
        .withColumn(position, F.col("_start") + local).drop("_p", "_m", "_start")
    )
