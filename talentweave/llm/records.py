"""Token ids as length-delimited binary records with an offset index beside them.

A record is ``length (u64) | masked crc of the length (u32) | payload | masked crc of the payload (u32)``, all little-endian;
the checksum is CRC-32C, masked by a rotation by 15 bits and a constant, so that checksums of data that itself holds checksums
stay sound. The payload is ``flags (u32) | doc_id (i64) | ids (u16 or u32 each)``. Records lie in ascending doc_id order,
null ids first, within and across shards. The index of a shard has one ``(offset, length)`` pair of u64 a record, so a reader
can fetch records in any order without scanning the file.

A shard file is written under a name that no other attempt uses, and counts only when the table of shards names it: a
lost executor or a second attempt leaves at most an unnamed file. Files go through Arrow's file systems, so the folder may be
in any store these know.

Null texts are empty texts and give the end id alone. Rows with equal doc_id follow each other by text. An empty table gives no
shards. Extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table, written
from talentweave.llm.tokens import Encoder, sliced, tokenizer_path
from talentweave.session import fresh_path

MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
HEADER = "<Iq"
NULL_ID, WIDE = 1, 2
BLOCK = 64
#: Records are framed together up to so many bytes, so a task holds no more than this and one record.
GROUP_BYTES = 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC steps for a byte, and for moving a CRC past ``BLOCK`` zero bytes, by the byte of the CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    move = np.zeros((4, 256), np.uint32)
    for k in range(4):
        crc = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            crc = step[crc & 0xFF] ^ (crc >> np.uint32(8))
        move[k] = crc
    return step, move


STEP, MOVE = _tables()


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message; all blocks of all messages advance together, then each message's blocks are joined.

    Leading zeros don't change a CRC that starts at zero, so messages are padded in front to whole blocks.
    """
    sizes = np.array([len(m) for m in messages], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(blocks) * BLOCK
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for m, end in zip(messages, ends, strict=True):
        if m:
            data[end - len(m):end] = np.frombuffer(m, np.uint8)
            data[end - len(m):end - len(m) + min(4, len(m))] ^= 0xFF  # the usual start value
    columns = np.ascontiguousarray(data.reshape(-1, BLOCK).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = STEP[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    first = ends // BLOCK - blocks
    total = np.zeros(len(messages), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    first, counts = first[order], blocks[order]
    for j in range(int(blocks.max()) if len(blocks) else 0):
        live = int(np.searchsorted(-counts, -j, "left"))  # messages with more than j blocks
        t = total[:live]
        total[:live] = MOVE[0][t & 0xFF] ^ MOVE[1][(t >> 8) & 0xFF] ^ MOVE[2][(t >> 16) & 0xFF] ^ MOVE[3][t >> 24] ^ crc[first[:live] + j]
    out = np.empty_like(total)
    out[order] = total
    short = sizes < 4  # the start value does not fit into the message: bit by bit
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(short):
        c = 0xFFFFFFFF
        for b in messages[i]:
            c = int(STEP[(c ^ b) & 0xFF]) ^ (c >> 8)
        out[i] = c ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + h.tobytes() + p + t.tobytes() for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def unframed(frames: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; a wrong length or checksum raises."""
    payloads = [f[12:-4] for f in frames]
    heads, tails = masked(crc32c([f[:8] for f in frames])), masked(crc32c(payloads))
    for f, p, h, t in zip(frames, payloads, heads.tolist(), tails.tolist(), strict=True):
        length, head = struct.unpack("<QI", f[:12])
        if length != len(p) or head != h or struct.unpack("<I", f[-4:])[0] != t:
            raise ValueError("damaged record")
    return payloads


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize > 2
    return struct.pack(HEADER, (doc_id is None) * NULL_ID | wide * WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(HEADER, data)
    return None if flags & NULL_ID else doc_id, np.frombuffer(data, "<u4" if flags & WIDE else "<u2", offset=struct.calcsize(HEADER))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


_shard_schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())])
_record_schema = pa.schema([
    ("doc_id", pa.int64()), ("shard", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()), ("record", pa.int64()), ("offset", pa.int64()),
])


def write_records(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write shards and indexes below ``folder``; one row a shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(tokenizer), TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{os.urandom(6).hex()}"
        store, path = opened(folder)
        index: list[tuple[int, int]] = []
        offset = n_ids = 0
        data = None

        def put(payloads: list[bytes]) -> None:
            nonlocal offset
            frames = framed(payloads)
            for f in frames:
                index.append((offset, len(f)))
                offset += len(f)
            data.write(b"".join(frames))

        held: list[bytes] = []
        size = 0
        for part in (p for batch in batches for p in sliced(batch, "text")):
            if data is None:
                store.create_dir(path, recursive=True)
                data = store.open_output_stream(f"{path}/{name}.rec")
            ids, starts = encoder.encode_all(part.column("text"))
            n_ids += len(ids)
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                held.append(payload(doc_id, ids[a:b]))
                size += len(held[-1])
                if size >= GROUP_BYTES:
                    put(held)
                    held, size = [], 0
        if data is not None:
            if held:
                put(held)
            data.close()
            with store.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            yield from batched(iter([(shard, name, len(index), n_ids, offset)]), _shard_schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (
        chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, file string, records long, n_ids long, bytes long")
    )


def shuffled_order(records: int, seed: int) -> np.ndarray:
    """Order in which a training reader may fetch a shard's records by their index."""
    return np.random.default_rng(seed).permutation(records)


def fetch(store: fs.FileSystem, path: str, order: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """``(record, offset, payload)`` in file order, or in the given order through the index."""
    with store.open_input_file(f"{path}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
    with store.open_input_file(f"{path}.rec") as f:
        if order is not None:
            for i in order:
                offset, length = index[i]
                yield int(i), int(offset), unframed([f.read_at(int(length), int(offset))])[0]
            return
        at = 0
        while at < len(index):
            start = int(index[at, 0])
            end = max(at + 1, int(np.searchsorted(index[:, 0], start + GROUP_BYTES)))
            data = f.read_at(int(index[end - 1].sum()) - start, start)
            frames = [data[o - start:o - start + n] for o, n in index[at:end].tolist()]
            for i, p in enumerate(unframed(frames), at):
                yield i, int(index[i, 0]), p
            at = end


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """One row a record of the named shards, read from the files; starts count from the shard's first id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            store, path = opened(folder)
            for shard, name in rows_of(batches, "shard", "file"):
                start = 0
                for record, offset, data in fetch(store, f"{path}/{name}"):
                    doc_id, ids = parsed(data)
                    yield doc_id, shard, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), record, offset
                    start += len(ids)

        yield from batched(rows(), _record_schema)

    return shards.mapInArrow(
        read, "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long, record long, offset long",
    )


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "records")
    shards = written(write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path()), "shards")
    before, starts = 0, []
    for r in shards.select("shard", "n_ids").orderBy("shard").collect():  # one row a shard
        starts.append((r["shard"], before))
        before += r["n_ids"]
    starts = spark.createDataFrame(starts, "shard long, _before long")
    named = shards.select("shard", "file").repartitionByRange(max(1, shards.count()), "shard")
    read = read_records(named, folder).join(F.broadcast(starts), "shard")
    return read.select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "record", "offset",
    )
