"""Text embeddings: token hashing by default, any other encoder through a hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import text as T
from talentweave.operators.render import role_prefix


def hashed_vectors(df: DataFrame, text: str = "text", size: int = K.VECTOR_SIZE) -> DataFrame:
    """Add ``embedding``: token counts per hash slot, scaled to length 1.

    Spark splits and hashes; the tasks only count small integers, one Arrow batch at a time.
    """
    slots = F.transform(T.words_of(F.lower(F.col(text))), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("smallint"))
    with_slots = df.withColumn("_slots", slots)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "embedding array<float>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(row * size + flat, minlength=batch.num_rows * size).reshape(-1, size).astype(np.float64)
            norm = np.linalg.norm(counts, axis=1, keepdims=True)
            unit = (counts / np.where(norm == 0, 1, norm)).astype(np.float32)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * size, size, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [vectors]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "embedding"])

    return with_slots.mapInArrow(count, out_schema)


def encoded_vectors(
    df: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 256
) -> DataFrame:
    """Add ``embedding`` from an encoder that is loaded once per task and sees ``batch`` texts at a time."""
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "embedding array<float>"])

    def run(frames):
        encode = load_encoder()
        for frame in frames:
            texts = frame[text].tolist()
            parts = [np.asarray(encode(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            yield frame.assign(embedding=[v for part in parts for v in part])

    return df.mapInPandas(run, out_schema)


def embed_texts(
    df: DataFrame, kind: str, is_query: bool, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None
) -> DataFrame:
    """``(id, kind, role, text, embedding)``: one row per document, text with its role prefix."""
    prefixed = role_prefix(df.select("id", "text"), is_query)
    tagged = prefixed.select(
        "id", F.lit(kind).alias("kind"), F.lit("query" if is_query else "passage").alias("role"), "text"
    )
    return hashed_vectors(tagged) if load_encoder is None else encoded_vectors(tagged, load_encoder)


def append_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").partitionBy("kind", "role").parquet(path)
