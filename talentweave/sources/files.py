"""Folders of very many files, each of them one record.

Spark's own file sources hold a status of every file on the driver and open each with some milliseconds of work. Here folders are listed level by
level in tasks, the names are a table, and tasks open the files by their URI, as pyarrow does; so the driver holds no name, and a file costs little
more than its opening. A store that pyarrow doesn't reach is left to Spark's sources.
"""

from __future__ import annotations

import bz2
import gzip
import os
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.session import fresh_path

FILES_PER_TASK, TASK_BYTES = 20_000, 64 << 20
#: Bytes and names that a task holds before it hands them on.
BATCH_BYTES, BATCH_NAMES = 4 << 20, 10_000
FOUND = "path string, size long, folder boolean, keyed boolean"
CONTENT = "path string, content binary"

#: Java's URIs keep other letters as they are.
NOT_IN_URI = re.compile(r'[\x00- "#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]')

Batches = Iterator[pa.RecordBatch]


def _local(path: str) -> str | None:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe=":/@?&="))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def as_uri(path: str) -> str:
    """A path of a store as Spark's ``_metadata.file_path`` writes it."""
    return NOT_IN_URI.sub(lambda m: quote(m.group()), path)


def opened_by_tasks(path: str) -> bool:
    """Whether the store of a qualified path is one that pyarrow reaches."""
    try:
        return _local(path) is not None or bool(_store(path))
    except (OSError, ImportError, pa.ArrowException):
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's sources leave out too."""
    meta = name.startswith(("_metadata", "_common_metadata"))
    return not meta and (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """``(name, size, is a folder)`` of what lies in a folder."""
    if (place := _local(folder)) is not None:
        with os.scandir(place) as found:
            for e in found:
                try:
                    yield e.name, e.stat().st_size, e.is_dir()
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
        return
    store, place = _store(folder)
    for e in store.get_file_info(fs.FileSelector(place)):
        yield e.base_name, e.size or 0, e.type == fs.FileType.Directory


def _lister(every: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        rows: list[tuple[str, int, bool, bool]] = []
        for batch in batches:
            for folder, keyed, top in zip(*(c.to_pylist() for c in batch.columns)):
                for name, size, is_folder in _entries(folder):
                    # An empty file is no record, as in Spark's sources.
                    if _hidden(name) or not (is_folder or (size and (every or keyed or top))):
                        continue
                    rows.append((f"{folder.rstrip('/')}/{name}", size, is_folder, keyed or (is_folder and "=" in name)))
                    if len(rows) >= BATCH_NAMES:
                        yield _found(rows)
                        rows = []
        yield _found(rows)

    return run


def _found(rows: list[tuple[str, int, bool, bool]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 4
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "size", "folder", "keyed"])


def list_files(spark: SparkSession, places: list[tuple[str, int, bool]], every: bool) -> DataFrame:
    """``(path, size)`` of the files in ``places`` and in the folders below: all of them, or those below a folder named ``key=value``."""
    cores = spark.sparkContext.defaultParallelism
    here = [(p, size) for p, size, folder in places if not folder and size and not _hidden(p.rsplit("/", 1)[-1])]
    files = spark.createDataFrame(here, "path string, size long")
    folders = spark.createDataFrame([(p, False, True) for p, _, folder in places if folder], "path string, keyed boolean, top boolean")
    while not folders.isEmpty():
        listed = fresh_path(spark, "files")
        folders.repartition(cores).mapInArrow(_lister(every), FOUND).write.parquet(listed)
        found = spark.read.schema(FOUND).parquet(listed)
        files = files.unionByName(found.where("not folder").select("path", "size"))
        folders = found.where("folder").select("path", "keyed", F.lit(False).alias("top"))
    return files


def _plain(path: str, content: bytes) -> bytes:
    """Text of a file whose name says that it is compressed."""
    if path.endswith(".gz"):
        return gzip.decompress(content)
    if path.endswith(".bz2"):
        return bz2.decompress(content)
    if path.endswith(".deflate"):
        return zlib.decompress(content)
    if path.endswith(".zst"):
        return pa.input_stream(pa.py_buffer(content), compression="zstd").read()
    if path.endswith((".snappy", ".lz4")):
        raise ValueError(f"not a compression that is read here: {path}")
    return content


def _content(path: str) -> bytes:
    if (place := _local(path)) is not None:
        with open(place, "rb") as file:
            return file.read()
    store, place = _store(path)
    with store.open_input_file(place) as file:
        return file.read()


def _reader(text: bool) -> Callable[[Batches], Batches]:
    def rows(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    def run(batches: Batches) -> Batches:
        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = _plain(path, _content(path)) if text else _content(path)
                if paths and held + len(content) > BATCH_BYTES:
                    yield rows(paths, contents)
                    paths, contents, held = [], [], 0
                paths.append(as_uri(path) if text else path)
                contents.append(content)
                held += len(content)
        yield rows(paths, contents)

    return run


def whole_files(spark: SparkSession, path: str, text: bool) -> DataFrame | None:
    """``(path, content)`` of the files of a path or pattern, or None if there are none or only Spark reaches them.

    Texts are those in the folder itself and below its ``key=value`` folders, and are unpacked; else it is all files below, as they are.
    """
    at = qualified(spark, path)
    if not opened_by_tasks(at):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    if not found:
        return None
    files = list_files(spark, [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in found], every=not text)
    total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).first()
    n, size = total["files"], total["bytes"] or 0
    # As many tasks as files and bytes ask for, but all cores while there are files for them.
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // FILES_PER_TASK), min(n, -(-size // TASK_BYTES)))
    return files.select("path").repartition(tasks).mapInArrow(_reader(text), CONTENT)


def write_text_files(rows: DataFrame, path: str) -> None:
    """One file for each row of ``(key, value)``: its text and a line end. A task's files lie in a folder of their own."""
    spark = rows.sparkSession
    at = qualified(spark, path)
    if not opened_by_tasks(at):
        rows.write.partitionBy("key").text(path)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)

    def write(batches: Batches) -> Batches:
        part, seen = TaskContext.get().partitionId(), {}
        folder = f"{at}/slice={part}"
        place = _local(folder)
        store, there = (None, None) if place is not None else _store(folder)
        made = False
        for batch in batches:
            for key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if not made:
                    os.makedirs(place, exist_ok=True) if place is not None else store.create_dir(there)
                    made = True
                # Named by key, so that a repeated task writes the same files.
                seen[key] = seen.get(key, -1) + 1
                name = f"part-{part:05d}-{key}{f'-{seen[key]}' if seen[key] else ''}.txt"
                with open(f"{place}/{name}", "wb") if place is not None else store.open_output_stream(f"{there}/{name}") as file:
                    file.write((value or b"") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select(F.col("key").cast("string"), F.col("value").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()
