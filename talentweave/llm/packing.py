"""Packing by lexical retrieval.

Token ids are the terms. Document frequencies are counted over all documents. Documents are dealt to shards of an inverted index by
a route: the smallest hash among their rarest frequent terms, so documents with words in common tend to meet; equal
routes are told apart by doc_id, so a route that a third of all documents share fills as many shards as it needs. A shard seeds a window with its longest unused
document, asks its index with the seed's heaviest terms for unused neighbours by BM25, and fills the window with them in that order;
without neighbours, the next longest documents follow. What is over at a window's end is cut and seeds the next window, so windows
are full; a shard's last window is cut into powers of two, which need no padding.

Null texts are empty: their end id alone. Rows with equal doc_id are documents of their own. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table, written
from talentweave.llm.tokens import Encoder, sliced, tokenizer_path
from talentweave.llm.words import mixed

WINDOW = 4096
VOCABULARY = 1 << 16
#: Ids of an index shard, its documents at most, and terms of a query.
SHARD_IDS, SHARD_DOCS, QUERY_TERMS = 1 << 21, 4096, 12
NEIGHBOURS = 64
K1, B = 1.2, 0.75
#: Terms that route a document: its rarest, but shared by this many documents at least.
ROUTE_TERMS, ROUTE_LEAST = 8, 3

_doc_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_piece_schema = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, starts = encoder.encode_all(part.column("text"))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts)), packed], schema=_doc_schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n long, ids binary")


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each row of a column of ids, ascending, laid end to end, and where each row begins. One sort does a batch."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u2", ends[-1])[ends[0]:] if data and ends[-1] else np.zeros(0, "<u2")
    # Row and term in one number; four bytes are enough for a usual batch, and sort faster.
    kind = np.uint32 if len(column) <= VOCABULARY else np.uint64
    keys = np.repeat(np.arange(len(column), dtype=kind) << kind(16), np.diff(ends)) | ids.astype(kind)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    rows = np.bincount((keys >> kind(16)).astype(np.int64), minlength=len(column))
    return (keys & kind(0xFFFF)).astype(np.int64), np.append(0, np.cumsum(rows))


def frequencies(found: DataFrame) -> np.ndarray:
    """Documents of each term: each task counts, a row a term and task is summed; the vocabulary bounds the result."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(distinct_terms(batch.column(0))[0], minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = found.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def routed(found: DataFrame, df: np.ndarray) -> DataFrame:
    """Adds ``route``: documents with rare terms in common tend to share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = mixed(np.arange(VOCABULARY, dtype=np.uint64)).view(np.int64)
        usable = df >= ROUTE_LEAST
        for batch in batches:
            routes = []
            every, starts = distinct_terms(batch.column("ids"))
            kept = usable[every]
            every, starts = every[kept], np.append(0, np.cumsum(kept))[starts].tolist()
            for first, last in zip(starts[:-1], starts[1:]):
                terms = every[first:last]
                if len(terms) > ROUTE_TERMS:
                    terms = terms[np.argpartition(df[terms], ROUTE_TERMS)[:ROUTE_TERMS]]
                routes.append(int(hashes[terms].min()) if len(terms) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.int64())], names=[*batch.schema.names, "route"])

    return found.mapInArrow(run, "doc_id long, n long, ids binary, route long")


class Index:
    """Inverted index of a shard with BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, total: int, mean: float):
        sizes = np.array([len(d) for d in docs])
        # Four-byte keys and two-byte terms, which sort faster; a shard has fewer documents than there are terms.
        owner = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
        keys, tf = np.unique(owner << np.uint32(16) | np.concatenate(docs), return_counts=True)
        doc, term = (keys >> np.uint32(16)).astype(np.int64), keys.astype(np.uint16)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.impact = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))).astype(np.float32)
        self.first = np.append(0, np.cumsum(np.bincount(doc, minlength=len(docs))))
        self.terms_by_doc, self.impact_by_doc = term, self.impact
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], self.impact[order]
        self.cuts = np.append(0, np.cumsum(np.bincount(term, minlength=VOCABULARY)))

    def neighbours(self, seed: int, unused: np.ndarray, count: int = NEIGHBOURS) -> np.ndarray:
        """Unused documents by score for the seed's heaviest terms."""
        a, b = self.first[seed], self.first[seed + 1]
        terms, impact = self.terms_by_doc[a:b], self.impact_by_doc[a:b]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-impact, QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.cuts[t], self.cuts[t + 1]) for t in terms]
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), len(unused))
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > count:
            found = found[np.argpartition(-score[found], count)[:count]]
        return found[np.lexsort((found, -score[found]))]


def packed_shard(docs: list[np.ndarray], df: np.ndarray, total: int, mean: float) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document number, start, length): full windows, then powers of two."""
    if not docs:
        return
    index = Index(docs, df, total, mean)
    sizes = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    by_size = np.argsort(-sizes, kind="stable")
    at = 0
    window: list[tuple[int, int, int]] = []
    room, left = WINDOW, int(sizes.sum())
    queue: list[int] = []
    while left:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if not queue:
            # The window's first document asks for more; else the longest unused one goes on.
            asked = index.neighbours(window[0][0], unused) if window else np.zeros(0, np.int64)
            if len(asked):
                queue = asked[::-1].tolist()
            else:
                while not unused[by_size[at]]:
                    at += 1
                queue = [int(by_size[at])]
        doc = queue.pop()
        unused[doc] = False
        start = 0
        while start < sizes[doc]:
            take = int(min(room, sizes[doc] - start))
            window.append((doc, start, take))
            start += take
            room -= take
            left -= take
            if room == 0:
                yield window
                window, room, queue = [], WINDOW, []
    rest = sum(p[2] for p in window)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        sequence, need = [], size
        while need:
            doc, start, length = window[0]
            take = min(length, need)
            sequence.append((doc, start, take))
            need -= take
            window[0] = (doc, start + take, length - take)
            if take == length:
                window.pop(0)
        yield sequence
        rest -= size


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces with their ids and places in sequences."""
    found = written(encoded(docs, tokenizer), "ids")
    df = frequencies(found)
    facts = found.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    total, mean = facts["docs"], float(facts["mean"] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36

        def rows() -> Iterator[tuple]:
            held: list[tuple[int, np.ndarray]] = []
            size, sequence = 0, base
            for doc_id, ids in rows_of(batches, "doc_id", "ids"):
                held.append((doc_id, np.frombuffer(ids, "<u2")))
                size += len(held[-1][1])
                if size >= SHARD_IDS or len(held) >= SHARD_DOCS:
                    for pieces in packed_shard([d for _, d in held], df, total, mean):
                        yield from placed(held, pieces, sequence)
                        sequence += 1
                    held, size = [], 0
            for pieces in packed_shard([d for _, d in held], df, total, mean):
                yield from placed(held, pieces, sequence)
                sequence += 1

        yield from batched(rows(), _piece_schema, 1024)

    def placed(held: list, pieces: list[tuple[int, int, int]], sequence: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, length in pieces:
            doc_id, ids = held[doc]
            piece = ids[start:start + length]
            yield doc_id, start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, piece.tobytes()
            offset += length

    by_route = routed(found, df).repartitionByRange("route", "doc_id").sortWithinPartitions("route", "doc_id", "ids")
    return by_route.select("doc_id", "ids").mapInArrow(run, PIECE)


def op3_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")
