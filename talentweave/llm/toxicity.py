"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its words, word pairs and pairs with one word between them, each hashed to one of 2^20
coordinates. Every coordinate has its own learning rate; the L1 term alone keeps most weights at zero, so what tasks get is a short
list of weights, at most one a coordinate. Training reads a bounded sample of labelled rows, with all of their coordinates: in each of
a few rounds a fixed number of tasks run FTRL over their part from the same state, and their steps are averaged. Scores read every
whole text.

Words are runs of letters (any byte of a character outside ASCII counts as one), in lower case. Null and empty texts score by
the bias alone. Rows without a label, or with a null id, are scored but not learnt from; rows that share an id share its largest
label. Without any usable label all scores are 0.5. Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table
from talentweave.session import fresh_path

BITS = 20
#: Labelled rows to learn from, as an expected number, and tasks that learn.
TRAIN_ROWS, TRAIN_TASKS, ROUNDS, EPOCHS = 16_000, 4, 3, 2
#: Tasks that hash the sample, each writing a file for every task that learns.
SAMPLE_TASKS = 16
#: Toxic rows are rare; their gradients count as many times as clean rows outnumber them, up to this.
MOST_WEIGHT = 8.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.7
BIAS = (1 << BITS) - 1
#: Texts are hashed together up to so many bytes.
GROUP_BYTES = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = True
LETTER[128:] = True
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(document, coordinate)`` of every word, pair and skip pair of some texts, repeats included."""
    data = b"\n".join((t or "").lower().encode() for t in texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    letter = np.concatenate([[False], LETTER[raw], [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = (raw[letter[1:-1]].astype(np.uint64) + np.uint64(1)) * POWERS[place & 63]
    word = _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes))
    bounds = np.cumsum([len((t or "").lower().encode()) + 1 for t in texts])
    doc = np.searchsorted(bounds, starts, "right")
    pair, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = _mixed(word[:-1] * np.uint64(0x9FB21C651E98DF25) + word[1:] + np.uint64(1))[pair]
    skips = _mixed(word[:-2] * np.uint64(0xD6E8FEB86659FD93) + word[2:] + np.uint64(2))[skip]
    found = np.concatenate([word, pairs, skips]) >> np.uint64(64 - BITS)
    return np.concatenate([doc, doc[1:][pair], doc[2:][skip]]), found.astype(np.int64)


def feature_sets(texts: list[str | None]) -> list[np.ndarray]:
    doc, found = features(texts)
    keys = np.unique((doc << BITS) | found)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
    return [np.union1d(keys[a:b] & ((1 << BITS) - 1), [BIAS]) for a, b in zip(cuts, cuts[1:], strict=False)]


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(
    sets: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, weight: float = 1.0, epochs: int = EPOCHS, seed: int = 7,
) -> None:
    """Move the coordinate states by some passes, in an order that the seed shuffles."""
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            x = sets[i]
            zi, ni = z[x], n[x]
            w = weights_of(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            if labels[i]:
                g *= weight
            grown = np.sqrt(ni + g * g)
            z[x] = zi + g - (grown - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g


_set_schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("label", pa.int32()), ("found", pa.list_(pa.int32()))])
_step_schema = pa.schema([("at", pa.int32()), ("z", pa.float64()), ("n", pa.float64())])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learner(z: np.ndarray, n: np.ndarray, weight: float, r: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task's part of a round; gives its steps away from the common state."""
    z, n = z.astype(np.float32), n.astype(np.float32)  # as sent to the tasks

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, labels, parts = [], [], [], set()
        for batch in batches:
            found, ends = batch.column("found"), np.cumsum(pc.list_value_length(batch.column("found")).to_numpy(zero_copy_only=False))
            sets += np.split(found.flatten().to_numpy().astype(np.int64), ends[:-1])
            parts.update(pc.unique(batch.column("part")).to_pylist())
            ids.append(batch.column("doc_id").to_numpy())
            labels.append(batch.column("label").to_numpy())
        if not sets:
            return
        if len(parts) > 1:
            raise ValueError(f"parts {parts} in one task")
        order = np.argsort(np.concatenate(ids), kind="stable")
        zs, ns = z.astype(np.float64), n.astype(np.float64)
        ftrl([sets[i] for i in order], np.concatenate(labels)[order].astype(float), zs, ns, weight, seed=r)
        moved = np.flatnonzero(ns != n)
        for at in np.array_split(moved, len(moved) // 65_536 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(zs[at] - z[at]), pa.array(ns[at] - n[at])], schema=_step_schema)

    return learn


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> pd.Series:
    """Weights by coordinate, without zeros. ``labels`` has doc_id and label (0 or 1)."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = rows / max(1, known.count())
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / float(1 << 53)
    chosen = known.where(order < share) if share < 1 else known
    part = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(TRAIN_TASKS)).cast("int").alias("part")
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id").select("doc_id", part, "label", "text")  # ``rows`` ids or so
        .repartition(SAMPLE_TASKS, "doc_id")
    )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in rows_of(batches, "doc_id", "part", "label", "text"):
                held.append(row)
                if len(held) == 64:
                    yield from ((*r[:3], x) for r, x in zip(held, feature_sets([r[3] for r in held]), strict=True))
                    held = []
            yield from ((*r[:3], x) for r, x in zip(held, feature_sets([r[3] for r in held]), strict=True))

        yield from batched(rows(), _set_schema, 512)

    # The only copy of the sample. Rounds shuffle nothing: each learning task reads its folder.
    ddl, path = "doc_id long, part int, label int, found array<int>", fresh_path(docs.sparkSession, "toxicity")
    sample.mapInArrow(sets_of, ddl).write.mode("errorifexists").partitionBy("part").parquet(path)
    sample = docs.sparkSession.read.schema(ddl).parquet(path)
    sizes = dict(sample.groupBy("label").count().collect())
    if len(sizes) < 2:
        return pd.Series([], index=np.zeros(0, np.int64), dtype=float)
    weight = min(MOST_WEIGHT, max(1.0, sizes.get(0, 0) / sizes[1]))
    # A union of frames of one partition each has one partition too, unless one frame has an unknown number: here the empty one.
    parts = reduce(DataFrame.union, [sample.where(F.col("part") == p).coalesce(1) for p in range(TRAIN_TASKS)], sample.where("part < 0"))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in range(ROUNDS):
        steps = parts.mapInArrow(_learner(z, n, weight, r), "at int, z double, n double").toArrow()  # a row a task and coordinate at most
        at = steps["at"].to_numpy()
        z = z + np.bincount(at, steps["z"].to_numpy(), 1 << BITS) / TRAIN_TASKS
        n = n + np.bincount(at, steps["n"].to_numpy(), 1 << BITS) / TRAIN_TASKS
    w = weights_of(z, n)
    return pd.Series(w[w != 0], index=np.flatnonzero(w))


def score(docs: DataFrame, weights: pd.Series) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    at, w = weights.index.to_numpy(np.int64), weights.to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = w
        bias = dense[BIAS]

        def scored(texts: list[str | None]) -> np.ndarray:
            doc, found = features(texts)
            keep = dense[found] != 0
            keys = np.unique((doc[keep] << BITS) | found[keep])
            found = keys & ((1 << BITS) - 1)
            total = np.bincount(keys >> BITS, np.where(found == BIAS, 0, dense[found]), len(texts)) + bias
            return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

        for batch in batches:
            texts, out, size, held = batch.column("text"), [], 0, []
            for i in range(batch.num_rows):
                held.append(texts[i].as_py())
                size += len(held[-1] or "")
                if size >= GROUP_BYTES:
                    out.append(scored(held))
                    held, size = [], 0
            if held:
                out.append(scored(held))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
