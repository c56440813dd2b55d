"""Records of large CSV and JSON files, read by byte ranges.

A range can't tell by itself whether it begins inside quotes or how deep in brackets. A first pass gives each range's effect on both, running
sums over the ranges of a file give the state each one begins with, and a second pass reads the records: a range has those whose
separator lies in it, and reads on past its end for its last one. So a file of any size is read by many tasks, and a task holds one range and
one record.

CSV: quotes only around fields, doubled inside; blank lines are no records. JSON: the items of a list; a file that is no list is one record,
also when it is blank. Files are opened by their URI in the tasks, as pyarrow does.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.session import cut_lineage

RANGE_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Bytes read at a time past a range's end.
FURTHER = 1 << 20
QUOTE, BACKSLASH, NEWLINE, COMMA, OPEN_LIST = b'"\\\n,['
BLANK = b" \t\r\n"
RECORD = "path string, at long, pos long, record string"

State = tuple[int, int, int]  # inside quotes, depth of brackets, odd number of backslashes before


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@?&="))
    return system.open_input_file(place)


def _read(file: pa.NativeFile, first: int, last: int) -> np.ndarray:
    file.seek(first)
    return np.frombuffer(file.read(last - first), np.uint8)


def _odd_before(file: pa.NativeFile, at: int) -> int:
    """Whether an odd number of backslashes ends before a place."""
    count = 0
    while at:
        first = max(0, at - 4096)
        file.seek(first)
        data = file.read(at - first)
        run = len(data) - len(data.rstrip(b"\\"))
        count += run
        if run < len(data):
            break
        at = first
    return count & 1


def _csv_marks(data: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    """Places behind separators, and the state behind the bytes."""
    inside = np.bitwise_xor.accumulate((data == QUOTE).view(np.uint8)) ^ np.uint8(state[0])
    return np.flatnonzero((data == NEWLINE) & (inside == 0)) + 1, (int(inside[-1]), 0, 0)


def _json_signs(data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, int]:
    """Inside quotes and depth change at each byte, and the odd backslashes behind the bytes."""
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1))
    # Backslashes that end at each byte; a run from the first byte on goes on from the bytes before.
    run = place - other + np.where(other < 0, state[2], 0)
    odd = np.concatenate([[state[2]], run[:-1]]) & 1
    inside = np.bitwise_xor.accumulate(((data == QUOTE) & (odd == 0)).view(np.uint8)) ^ np.uint8(state[0])
    # '{' and '[' differ in one bit, as do '}' and ']'.
    change = ((data | 32) == ord("{")).astype(np.int32) - ((data | 32) == ord("}"))
    return inside, change, int(run[-1] & 1)


def _json_marks(data: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    inside, change, odd = _json_signs(data, state)
    change[inside == 1] = 0
    depth = state[1] + np.cumsum(change)
    ends = (inside == 0) & (
        ((data == COMMA) & (depth == 1)) | ((change == 1) & (depth == 1)) | ((change == -1) & (depth == 0))
    )
    return np.flatnonzero(ends) + 1, (int(inside[-1]), int(depth[-1]), odd)


def _records(file: pa.NativeFile, first: int, last: int, size: int, state: State, marks) -> Iterator[tuple[int, bytes]]:
    """``(place, record)`` of the records whose separator lies in the range."""
    data = _read(file, first, last)
    places, state = marks(data, state) if len(data) else (np.zeros(0, np.int64), state)
    begins = [0, *places.tolist()] if first == 0 else places.tolist()
    if not begins:
        return
    whole = data.tobytes()
    for a, b in zip(begins, begins[1:]):
        yield first + a, whole[a:b - 1]
    parts = [whole[begins[-1]:]]
    while last < size:
        data = _read(file, last, min(last + FURTHER, size))
        places, state = marks(data, state)
        if len(places):
            parts.append(data[:places[0] - 1].tobytes())
            break
        parts.append(data.tobytes())
        last += len(data)
    yield first + begins[-1], b"".join(parts)


def _facts(kind: str, step: int):
    """Effect of each range: quotes, depth from outside and from inside quotes, first byte that is not blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as file:
                    data = _read(file, at, min(at + step, size)) if size else np.zeros(0, np.uint8)
                    if kind == "csv" or not len(data):
                        found.append((int(np.count_nonzero(data == QUOTE)) & 1, 0, 0, None, 0))
                        continue
                    odd = _odd_before(file, at)
                inside, change, _ = _json_signs(data, (0, 0, odd))
                black = np.flatnonzero(~np.isin(data, np.frombuffer(BLANK, np.uint8)))
                found.append((int(inside[-1]), int(change[inside == 0].sum()), int(change[inside == 1].sum()), int(data[black[0]]) if len(black) else None, odd))
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)],
                names=["path", "at", "size", "quotes", "outside", "inside", "head", "odd"],
            )

    return run


def _reader(kind: str, step: int):
    marks = _csv_marks if kind == "csv" else _json_marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(path: str, at: int, size: int, quotes: int, depth: int, head: int | None, odd: int) -> Iterator[tuple[int, bytes]]:
            with _open(path) as file:
                if kind == "csv" or head == OPEN_LIST:
                    yield from _records(file, at, min(at + step, size), size, (quotes, depth, odd), marks)
                elif at == 0:
                    yield 0, file.read()

        for batch in batches:
            for path, at, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                places, texts, held = [], [], 0
                for place, record in found(path, at, *rest):
                    # What stands before a list and behind it is no item.
                    if record.strip(BLANK) or (kind == "json" and rest[3] != OPEN_LIST):
                        places.append(place)
                        texts.append((record.removesuffix(b"\r") if kind == "csv" else record.strip(BLANK)).decode("utf-8", "replace"))
                        held += len(record)
                    if held > 4 << 20:
                        yield _rows(path, at, places, texts)
                        places, texts, held = [], [], 0
                yield _rows(path, at, places, texts)

    return run


def _rows(path: str, at: int, places: list[int], texts: list[str]) -> pa.RecordBatch:
    n = len(places)
    columns = [pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "at", "pos", "record"])


def file_records(spark: SparkSession, path: str, kind: str, step: int = RANGE_BYTES) -> DataFrame:
    """``(path, at, pos, record)`` of the files of a path: records of ``csv`` (the header among them, at ``pos`` 0) or ``json``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))  # lists, reads no content
    total = files.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / step))).alias("ranges"), F.sum("size").alias("bytes")).first()
    # As many tasks as the bytes ask for, but all cores while there are ranges for them.
    tasks = max(min(total["ranges"] or 1, spark.sparkContext.defaultParallelism), -(-(total["bytes"] or 0) // TASK_BYTES), 1)
    last = F.greatest(F.lit(0), F.col("size") - 1)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("at"), "size")
    facts = ranges.repartition(tasks, "path", "at").mapInArrow(
        _facts(kind, step), "path string, at long, size long, quotes long, outside long, inside long, head long, odd long",
    )
    facts = cut_lineage(facts)  # a row a range; the second pass looks at them more than once
    whole = Window.partitionBy("path").orderBy("at")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    known = facts.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn(
        "head", F.first("head", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).withColumn("change", F.when(F.col("q") == 0, F.col("outside")).otherwise(F.col("inside")))
    states = known.select("path", "at", "size", "q", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), "head", "odd")
    # Records come in the order of the files.
    return states.repartitionByRange(tasks, "path", "at").sortWithinPartitions("path", "at").mapInArrow(_reader(kind, step), RECORD)
