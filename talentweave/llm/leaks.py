"""Benchmark passages in documents, by CGK embedding and bit sampling, then exact edit distance.

Words are runs of letters and digits in lower case. A random walk reads a word sequence and copies the current word at every step; a
random bit of the step and the word decides whether it moves on. Two sequences a few edits apart give walks that are equal at
most steps. Keys of a few sampled steps therefore collide for a window and an item in at least one of many tables. Edits of one kind
pull two walks apart for good, so half of a walk's keys come from its first steps, where few edits lie behind. Over 15 to 100 words with a
fifth of them deleted, inserted, replaced or mixed, a test finds 99 in a hundred passages or more; exact ones are never missed.
Candidates are verified by edit distance over words against the best end near the window.

A window within ``k`` edits of an item of ``n`` words shares n - 2 - 3k of its word triples; regions of a text with fewer
triples of any item can't hold a match and aren't embedded, unless an item is so short that this tells nothing. Items are read
in blocks of bounded size, each against all documents.

Null and empty texts have no passages; items without words match nothing. Items shorter than five words must match exactly.
Repeated rows match alike. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table
from talentweave.llm.words import mixed, word_hashes

EDITS = 0.2
WALKS, SAMPLES, STEPS_A_KEY = 16, 12, 3
#: Steps that every other key of a walk is taken from.
FIRST_STEPS = 16
#: Items that tasks hold at once.
ITEM_BLOCK = 20_000
SEED = np.uint64(0x632BE59BD9B4E019)

INSIDE = np.zeros(256, bool)
INSIDE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def allowed(n: int) -> int:
    return int(EDITS * n) if n >= 5 else 0


def words_of(text: str | None) -> np.ndarray:
    return word_hashes([(text or "").lower().encode()], INSIDE)[0]


def triples(words: np.ndarray) -> np.ndarray:
    if len(words) < 3:
        return np.zeros(0, np.uint64)
    return mixed(words[:-2] * np.uint64(0x9FB21C651E98DF25) + words[1:-1] * np.uint64(0xD6E8FEB86659FD93) + words[2:])


def size_class(n: int) -> int:
    """Classes of item lengths, each a quarter larger than the one before."""
    return int(np.log(max(n, 1)) / np.log(1.25) + 1e-9)


def class_steps(c: int) -> int:
    """Walk steps that the shortest item of a class surely fills: a walk moves on every other step."""
    return max(STEPS_A_KEY, int(1.4 * 1.25 ** c))


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: int, steps: int) -> np.ndarray:
    """Outputs (steps, starts) of one random walk from each start; 0 beyond the end."""
    at = starts.copy()
    out = np.zeros((steps, len(starts)), np.uint64)
    padded = np.append(words, np.uint64(0))
    for j in range(steps):
        here = np.where(at < ends, padded[np.minimum(at, len(words))], np.uint64(0))
        out[j] = here
        seed = mixed(np.array([number * 4096 + j + 1], np.uint64) * SEED)[0]
        at += (mixed(here ^ seed) & np.uint64(1)).astype(np.int64)
    return out


def sampled(outputs: np.ndarray, number: int, c: int) -> np.ndarray:
    """Keys (samples, starts) of a class from one walk."""
    rng = np.random.default_rng([number, c])
    picks = rng.integers(0, class_steps(c), (SAMPLES, STEPS_A_KEY))
    early = picks[1::2]
    early[:] = rng.integers(0, min(class_steps(c), FIRST_STEPS), early.shape)
    base = ((number * 97 + np.arange(SAMPLES)) * 131 + c + 1).astype(np.uint64)
    keys = mixed(base)[:, None] ^ np.zeros(outputs.shape[1], np.uint64)
    for k in range(STEPS_A_KEY):
        keys = mixed(keys + outputs[picks[:, k]])
    return keys


def best_ends(items: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``items`` its smallest edit distance to words from its start on, up to any place before its end, and that place.

    A distance over ``k`` comes back as ``k + 1``. An item within ``k`` edits has at least all but ``k`` of its words in its reach; rows
    with fewer are told apart by that count alone.
    """
    n = items.shape[1]
    at = starts[:, None] + np.arange(n + k)
    inside = at < ends[:, None]
    pieces = words[np.minimum(at, len(words) - 1)]
    seen = np.zeros(items.shape, bool)
    for j in range(n + k):
        seen |= (items == pieces[:, j:j + 1]) & inside[:, j:j + 1]
    live = np.flatnonzero(seen.sum(1) >= n - k)
    distance, end = np.full(len(items), k + 1), starts.copy()
    items, pieces, inside = items[live], pieces[live], inside[live]
    steps = np.arange(n + 1)
    column = np.tile(steps, (len(live), 1))
    for j in range(n + k if len(live) else 0):
        change = np.minimum(column[:, :-1] + (items != pieces[:, j:j + 1]), column[:, 1:] + 1)
        new = np.concatenate([np.full((len(live), 1), j + 1), change], 1)
        # Deletions run along the item: the smallest of value - place so far.
        column = np.minimum.accumulate(new - steps, 1) + steps
        better = inside[:, j] & (column[:, -1] < distance[live])
        distance[live[better]] = column[better, -1]
        end[live[better]] = starts[live[better]] + j + 1
    return distance, end


class Items:
    """Hash tables of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        sizes = [len(w) for _, w in items]
        self.sizes = np.array(sizes)
        self.longest = max(sizes)
        self.reach = self.longest + allowed(self.longest)
        self.least = min(n - 2 - 3 * allowed(n) for n in sizes)
        found = np.unique(np.concatenate([triples(w) for _, w in items] or [np.zeros(0, np.uint64)]))
        self.triples = found
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(found >> np.uint64(42)).astype(np.int64)] = True
        self.classes = sorted({size_class(n) for n in sizes})
        self.steps = max(class_steps(c) for c in self.classes)
        keys, owners = [], []
        words = np.concatenate([w for _, w in items])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        for number in range(WALKS):
            out = walk(words, starts, ends, number, self.steps)
            for c in self.classes:
                mine = np.flatnonzero([size_class(n) == c for n in sizes])
                k = sampled(out[:, mine], number, c)
                keys.append(k.ravel())
                owners.append(np.tile(mine, SAMPLES))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.key_bits = np.zeros(1 << 24, bool)
        self.key_bits[(keys >> np.uint64(40)).astype(np.int64)] = True

    def starts(self, words: np.ndarray) -> np.ndarray:
        """Window starts whose reach holds enough triples of items."""
        if self.least < 1:
            return np.arange(len(words))
        found = triples(words)
        hit = self.bits[(found >> np.uint64(42)).astype(np.int64)]
        if np.count_nonzero(hit) < self.least:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(self.triples, found[at]), len(self.triples) - 1)
        hit[at] = self.triples[place] == found[at]
        total = np.concatenate([[0], np.cumsum(hit)])
        at = np.arange(len(words))
        n = len(hit)
        return np.flatnonzero(total[np.minimum(at + self.reach, n)] - total[np.minimum(at, n)] >= self.least)

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (start number, item number) pairs that share a key."""
        found = []
        for number in range(WALKS):
            out = walk(words, starts, ends, number, self.steps)
            for c in self.classes:
                keys = sampled(out, number, c).ravel()
                hits = np.flatnonzero(self.key_bits[(keys >> np.uint64(40)).astype(np.int64)])
                lo, hi = np.searchsorted(self.keys, keys[hits], "left"), np.searchsorted(self.keys, keys[hits], "right")
                counts = hi - lo
                offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                items = self.owners[np.repeat(lo, counts) + offset]
                found.append(np.repeat(hits % len(starts), counts) * len(self.items) + items)
        return np.unique(np.concatenate(found))

    def verified(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(start number, item number, distance, end)`` of the pairs within an item's edits; pairs of equal item length go together."""
        start, item = np.divmod(pairs, len(self.items))
        sizes = self.sizes[item]
        order = np.argsort(sizes, kind="stable")
        lengths, firsts = np.unique(sizes[order], return_index=True)
        for n, first, last in zip(lengths.tolist(), firsts, [*firsts[1:], len(order)], strict=False):
            k, size = allowed(n), max(1, (1 << 18) // n)
            for at in range(first, last, size):
                some = order[at:min(at + size, last)]
                rows = np.stack([self.items[i][1] for i in item[some]])
                distance, end = best_ends(rows, words, starts[start[some]], ends[start[some]], k)
                for m in np.flatnonzero(distance <= k):
                    yield int(start[some[m]]), int(item[some[m]]), int(distance[m]), int(end[m])


_schema = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_words", pa.int64()),
    ("start_word", pa.int64()), ("end_word", pa.int64()),
])


def matches(texts: list[str | None], block: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(text number, item id, distance, item words, start, end)`` of the best window of each item in each text."""
    if not texts:
        return
    every, text, _, _ = word_hashes([(t or "").lower().encode() for t in texts], INSIDE)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    per_text = [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = [block.starts(w) if len(w) else np.zeros(0, np.int64) for w in per_text]
    live = [i for i, s in enumerate(chosen) if len(s)]
    if not live:
        return
    sizes = np.array([len(per_text[i]) for i in live])
    bases = np.cumsum(sizes) - sizes
    words = np.concatenate([per_text[i] for i in live])
    starts = np.concatenate([chosen[i] + b for i, b in zip(live, bases, strict=True)])
    owner = np.repeat(np.arange(len(live)), [len(chosen[i]) for i in live])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at in range(0, len(starts), 8192):
        some = starts[at:at + 8192]
        limits = (bases + sizes)[owner[at:at + 8192]]
        for s, i, distance, end in block.verified(words, some, limits, block.candidates(words, some, limits)):
            t = int(owner[at + s])
            value = (distance, int(some[s] - bases[t]), int(end - bases[t]))
            best[t, i] = min(best.get((t, i), value), value)
    for (t, i), (distance, begin, end) in sorted(best.items()):
        yield live[t], block.items[i][0], distance, len(block.items[i][1]), begin, end


def _scan(items: list[tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items)

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for row in rows_of(batches, "doc_id", "text"):
                held.append(row)
                size += len(row[1] or "")
                if len(held) >= 512 or size >= 1 << 20:
                    yield from ((held[m[0]][0], *m[1:]) for m in matches([t for _, t in held], block))
                    held, size = [], 0
            yield from ((held[m[0]][0], *m[1:]) for m in matches([t for _, t in held], block))

        yield from batched(rows(), _schema)

    return run


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Best window of each item in each document that holds it: ``items`` has item_id and text."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held: list[tuple[int, np.ndarray]] = []
    out = chosen.limit(0).mapInArrow(lambda batches: iter(()), "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long")
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if len(words):
            held.append((row["item_id"], words))
        if len(held) == ITEM_BLOCK:
            out, held = out.union(chosen.mapInArrow(_scan(held), out.schema)), []
    return out.union(chosen.mapInArrow(_scan(held), out.schema)) if held else out


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a passage of any item; a document is named by its id."""
    bad = find_leaks(docs, items).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")), "left_anti")
