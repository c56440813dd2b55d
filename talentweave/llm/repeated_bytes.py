"""Removal of repeated byte strings by external induced suffix sorting.

Every string of ``window`` bytes that starts at two or more places is removed wherever it lies. Windows go to the smallest k-gram
inside them, so equal windows meet in one group whatever surrounds them; a group whose k-gram occurs once needs no more work. A
group's stretches (a text with the starts that chose this occurrence) are first folded by content: starts in a stretch that occurs
twice are repeated. What stays different is sorted, shard by shard: suffix order and common prefixes of all stretches of a shard, by
induced sorting with disk-backed queues. A start is repeated if it has ``window`` bytes in common with a neighbour in that order.

Groups with very many different stretches, which no shard should hold, count a digest of each of their windows instead;
counts fold before they are shuffled. k-grams and stretches of very many rows are joined where their rows are. Nothing is dropped on any way.

Texts are UTF-8 bytes; null texts are empty. Matches never cross documents. Shorter texts keep all bytes. Rows are told apart by
doc_id and text; repeated rows are copies of each other. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table, written
from talentweave.llm.induced import suffix_order
from talentweave.llm.near_copies import text_key
from talentweave.llm.records import opened
from talentweave.llm.repeats_windows import GRAM, gram_hashes, stretches
from talentweave.session import fresh_path

WINDOW = 400
#: Bytes of stretches that a shard should hold, and different stretches of one k-gram from which windows count by digest.
SHARD_BYTES, GROUP_STRETCHES = 3 << 20, 4096
#: Rows of a k-gram or a stretch from which its facts are sent to all tasks; at most one key in so many rows is.
HOT_ROWS = 4096
#: Tuples that the queues of one sort hold in memory.
QUEUE_TUPLES = 1 << 22

_stretch_schema = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.string()), ("gram", pa.int64()), ("content", pa.binary()), ("first", pa.int64()), ("last", pa.int64()),
])


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def all_stretches(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, key, text in rows_of(batches, "doc_id", "text_key", "text"):
                data = text.encode()
                gram, first, last = stretches(np.frombuffer(data, np.uint8), window)
                for g, a, b in zip(gram.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                    yield doc_id, key, g, hashlib.blake2b(data[a:b + window], digest_size=16).digest(), a, b

        yield from batched(rows(), _stretch_schema, 16384)

    return _chosen(docs).mapInArrow(run, "doc_id long, text_key string, gram long, content binary, first long, last long")


def likely_parts(strings: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """``(string, first, last)`` runs of starts whose windows hold no k-gram that occurs once among the strings."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    hashes = gram_hashes(np.frombuffer(b"".join(strings), np.uint8))
    ordered = np.sort(hashes)
    twice = np.zeros(1 << 24, bool)
    twice[(ordered[1:][ordered[1:] == ordered[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    single = np.concatenate([[0], np.cumsum(~twice[(hashes >> np.uint64(40)).astype(np.int64)])])
    out = []
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        first = np.arange(end - size, end - window + 1)
        fine = np.flatnonzero(single[first + window - GRAM + 1] == single[first])
        out += [(i, x, y) for x, y in runs(fine)]
    return out


def repeated_starts(strings: list[bytes], window: int, **queue: object) -> list[np.ndarray]:
    """Of each string, the starts (0 and on) whose ``window`` bytes start elsewhere among the strings, too."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in strings]
    parts = likely_parts(strings, window)
    if parts:
        text, sizes = _joined([strings[i][a:b + window] for i, a, b in parts])
        position, prefix = suffix_order(text, window, **queue)
        enough = prefix >= window
        enough[:-1] |= enough[1:]
        marked = np.zeros(len(text), bool)
        marked[position[enough]] = True
        # A match over a string's end holds that end, so it is none.
        for (i, a, _), end, size in zip(parts, np.cumsum(sizes), sizes, strict=True):
            starts = np.flatnonzero(marked[end - size:end])
            out[i].append(starts[starts + window < size] + a)
    return [np.concatenate(x) for x in out]


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one, with a 0 after each string, and the sizes with it."""
    sizes = np.array([len(s) + 1 for s in strings])
    text = np.zeros(int(sizes.sum()), np.uint16)
    at = 0
    for s in strings:
        text[at:at + len(s)] = np.frombuffer(s, np.uint8)
        text[at:at + len(s)] += 1
        at += len(s) + 1
    return text, sizes


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True))


_run_schema = pa.schema([("gram", pa.int64()), ("content", pa.binary()), ("from", pa.int64()), ("to", pa.int64())])


def _sorted_shards(folder: str, window: int):
    """Sort shard by shard; rows of a shard follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        task = TaskContext.get().taskAttemptId()

        def at(name: str, mode: str) -> object:
            store.create_dir(path, recursive=True)
            where = f"{path}/{task}-{name}"
            return store.open_output_stream(where) if mode == "w" else store.open_input_stream(where)

        def done(held: list[tuple]) -> Iterator[tuple]:
            found = repeated_starts([r[3] for r in held], window, limit=QUEUE_TUPLES, store=at)
            for (_, gram, content, _), starts in zip(held, found, strict=True):
                for a, b in runs(starts):
                    yield gram, content, a, b

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in rows_of(batches, "shard", "gram", "content", "bytes"):
                if held and held[0][0] != row[0]:
                    yield from done(held)
                    held = []
                held.append(row)
            if held:
                yield from done(held)

        yield from batched(rows(), _run_schema)

    return run


_digest_schema = pa.schema([("gram", pa.int64()), ("content", pa.binary()), ("start", pa.int64()), ("digest", pa.binary())])


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for gram, content, data in rows_of(batches, "gram", "content", "bytes"):
                for i in range(len(data) - window + 1):
                    yield gram, content, i, hashlib.blake2b(data[i:i + window], digest_size=16).digest()

        yield from batched(rows(), _digest_schema, 16384)

    return run


_piece_schema = pa.schema([("gram", pa.int64()), ("content", pa.binary()), ("kinds", pa.int64()), ("bytes", pa.binary())])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for text, parts in rows_of(batches, "text", "parts"):
                data = text.encode()
                for p in parts:
                    yield p["gram"], p["content"], p["kinds"], data[p["first"]:p["last"] + window]

        yield from batched(rows(), _piece_schema, 1024)

    return run


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the facts of their keys, rows without any left out; ``n`` counts the rows of a key.

    Keys of very many rows have one fact with that count, which goes to the rows; they take no other facts.
    """
    hot = F.broadcast(facts.where(F.col(n) >= HOT_ROWS))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(n) < HOT_ROWS), keys)
    return rest.unionByName(rows.join(hot, keys))


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_key`` and ``ranges`` (first and last start of repeated windows) of documents that have some."""
    found = written(all_stretches(docs, window), "stretches")
    per_gram = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(joined(found, per_gram, ["gram"], "n").drop("n"), "shared")
    contents = shared.groupBy("gram", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "first", "last")).alias("of"),
    )
    kinds = written(contents, "contents")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # One row a document with all pieces to cut; texts move once.
    wanted = (
        joined(kinds, several, ["gram"], "kinds").select("gram", "content", "kinds", "of.*")
        .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "content", "kinds", "first", "last")).alias("parts"))
    )
    texts = _chosen(docs).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    pieces = texts.join(wanted, (F.col("_k") == F.col("text_key")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    pieces = pieces.select("text", "parts").mapInArrow(_cut(window), "gram long, content binary, kinds long, bytes binary")
    # Equal rows of a table would give a piece twice.
    pieces = written(pieces.dropDuplicates(["gram", "content"]), "pieces")
    usual = pieces.where(F.col("kinds") <= GROUP_STRETCHES)
    size = usual.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    sharded = usual.withColumn("shard", F.pmod(F.xxhash64("gram", F.lit(5)), F.lit(shards)).cast("int"))
    # Shards are of one size, so tasks may as well be dealt by number.
    sorted_ = sharded.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "gram", "content").select("shard", "gram", "content", "bytes")
    by_sort = sorted_.mapInArrow(_sorted_shards(fresh_path(docs.sparkSession, "queues"), window), "gram long, content binary, from long, to long")
    windows = written(pieces.where(F.col("kinds") > GROUP_STRETCHES).select("gram", "content", "bytes").mapInArrow(_digests(window), "gram long, content binary, start long, digest binary"), "digests")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    by_digest = windows.join(twice, "digest").select("gram", "content", F.col("start").alias("from"), F.col("start").alias("to"))
    different = by_sort.union(by_digest).withColumn("copies", F.lit(1).cast("long"))
    # All starts of a stretch with copies are repeated, whatever else was found in it.
    copied = kinds.where("copies > 1").select("gram", "content", F.lit(0).cast("long").alias("from"), (F.col("of.last") - F.col("of.first")).alias("to"), "copies")
    verdicts = written(different.union(copied), "verdicts")
    placed = joined(shared, verdicts, ["gram", "content"], "copies").select(
        "doc_id", "text_key", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to"))
    return placed.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


_kept_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_spans(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows starting in the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (start, end in bytes) of every row."""
    ranges = repeated_ranges(docs, window).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    return _chosen(docs).join(ranges, (F.col("_k") == F.col("text_key")) & F.col("_d").eqNullSafe(F.col("doc_id")), "left").select("doc_id", "text", "ranges")


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text, ranges in rows_of(batches, "doc_id", "text", "ranges"):
                data = text.encode()
                spans = removed_spans([(r["from"], r["to"]) for r in ranges or ()], WINDOW)
                yield doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()

        yield from batched(rows(), _kept_schema)

    return remove_repeats(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
