"""Hard negatives of anchors, found in STR-packed R-trees of integer vectors.

Rows are dealt by ranges of label and first coordinate; each range is cut into slabs of ``TREE`` rows, which are sorted and tiled along their
widest coordinates into leaves of ``LEAF`` rows. A leaf's and a node's minimum bounding box gives, coordinate by coordinate, an interval that holds
every inner product with an anchor. An anchor visits boxes best first: a box whose interval lies outside all score windows, or strictly below the k-th
score that each window already has, is dropped, so the result is exact, ties by number included.

The anchors are a stated query set against all rows: they are dealt in blocks of ``ANCHORS``, and each pair of a block and a group of trees is one
stretch of rows in a task, anchors first, so nothing passes through the driver. A task keeps its k best for each anchor and window, Spark merges them.
In vectors that fill all 64 directions evenly, boxes overlap and few are dropped; the work then is that of all inner products.

* Rows take no part with a null number, label or vector, or a component that is null or not finite. Components are saturated as longs; a score that no
  long can hold is left out.
* A vector counts as zero where it is shorter than another; so an empty one has score 0 with all.
* Ties go to the smaller number. A repeated row stands for itself, as anchor, positive or negative, but no row with an anchor's own number is its positive.
* Only ``vec_id``, ``embedding`` and ``label`` are read, so other columns can have any name. No rows or no anchors: none come out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.llm.common import positioned, table, written

TREE, LEAF, FANOUT, ANCHORS = 2048, 128, 4, 8192
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``x``: the rows that take part, in whole numbers."""
    def finite(e):
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))

    kept = rows.where("vec_id is not null and label is not null and embedding is not null").where(F.forall("embedding", finite))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("long"))
    return kept.select(F.col("vec_id").cast("long"), label.alias("label"), x.alias("x"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, with zeros after the shorter ones."""
    at = lists.offsets.to_numpy().astype(np.int64)
    sizes, values = np.diff(at), lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows; whole numbers that doubles can't hold are multiplied as Python's."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    exact = most[0] * most[1] * max(1, a.shape[1]) < 2**52
    kind = float if exact else object
    return a.astype(kind, copy=False) @ b.astype(kind, copy=False).T


def tiled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows in leaves, and where each leaf starts: slabs along the widest coordinate, tiles along the next in each slab."""
    def sort_in(rows: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return rows
        part = x[rows].astype(float)
        return rows[np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")]

    leaves = -(-len(x) // LEAF)
    slab = LEAF * int(np.ceil(np.sqrt(leaves)))
    rows = sort_in(np.arange(len(x)))
    order, starts = [], []
    for k in range(0, len(x), slab):
        part = sort_in(rows[k:k + slab])
        starts += range(k, k + len(part), LEAF)
        order.append(part)
    return np.concatenate(order), np.array([*starts, len(x)])


class Tree:
    """Nodes in one array, leaves first, the root last; ``first`` and ``last`` bound a leaf's rows or an inner node's children."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, starts = tiled(x)
        self.ids, self.x, self.leaves = ids[order], x[order], len(starts) - 1
        low, high = [np.minimum.reduceat(self.x, starts[:-1])], [np.maximum.reduceat(self.x, starts[:-1])]
        first, last, at = [starts[:-1]], [starts[1:]], 0
        while len(low[-1]) > 1:
            n = len(low[-1])
            cuts = np.arange(0, n, FANOUT)
            low, high = [*low, np.minimum.reduceat(low[-1], cuts)], [*high, np.maximum.reduceat(high[-1], cuts)]
            first, last = [*first, at + cuts], [*last, at + np.append(cuts[1:], n)]
            at += n
        self.low, self.high, self.first, self.last = map(np.concatenate, (low, high, first, last))

    def packed(self) -> dict[str, object]:
        width = np.int32 if np.abs(self.x.astype(float)).max(initial=0) < 2**31 - 1 else np.int64
        parts = {"low": self.low, "high": self.high, "vectors": self.x}
        out = {k: v.astype(width).tobytes() for k, v in parts.items()}
        return out | {"width": np.dtype(width).itemsize, "leaves": self.leaves, "ids": self.ids.tobytes(), "first": self.first.astype(np.int32).tobytes(), "last": self.last.astype(np.int32).tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.leaves = np.frombuffer(row["ids"], np.int64), row["leaves"]
        tree.first, tree.last = np.frombuffer(row["first"], np.int32), np.frombuffer(row["last"], np.int32)
        for name, key, n in (("low", "low", len(tree.first)), ("high", "high", len(tree.first)), ("x", "vectors", len(tree.ids))):
            setattr(tree, name, np.frombuffer(row[key], f"i{row['width']}").astype(np.int64).reshape(n, -1))
        return tree


TREES = "label int, tree struct<width: int, leaves: int, ids: binary, first: binary, last: binary, low: binary, high: binary, vectors: binary>"
TREES_ARROW = pa.schema([("label", pa.int32()), ("tree", pa.struct([
    ("width", pa.int32()), ("leaves", pa.int32()), *((k, pa.binary()) for k in ("ids", "first", "last", "low", "high", "vectors"))]))])


def pack(rows: DataFrame) -> DataFrame:
    """Trees of at most ``TREE`` rows of one label, one in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, ids, vectors = None, [], []

        def tree() -> pa.RecordBatch:
            d = max(v.shape[1] for v in vectors)
            made = Tree(np.concatenate(ids), np.concatenate([_wide(v, d) for v in vectors])).packed()
            return pa.RecordBatch.from_pylist([{"label": label, "tree": made}], schema=TREES_ARROW)

        for batch in batches:
            labels, numbers = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            at = 0
            while at < batch.num_rows:
                held = sum(map(len, ids))
                if held and (labels[at] != label or held >= TREE):
                    yield tree()
                    ids, vectors, held = [], [], 0
                label = int(labels[at])
                upto = min(at + TREE - held, at + int(np.argmax(np.append(labels[at:] != label, True))))
                ids.append(numbers[at:upto])
                vectors.append(_matrix(batch.column(2).slice(at, upto - at)))
                at = upto
        if ids:
            yield tree()

    order = ["label", F.coalesce(F.try_element_at("x", F.lit(1)), F.lit(0)), "vec_id"]
    return rows.select("vec_id", "label", "x").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TREES)


class Searches:
    """The anchors of a block with their windows and what they have found so far."""

    def __init__(self, rows: list[dict], k: int, same_label: bool):
        self.k, self.same = k, same_label
        self.num, self.own = np.array([r["num"] for r in rows]), np.array([r["vec_id"] for r in rows])
        self.label = np.array([r["label"] for r in rows])
        d = max(len(r["x"]) for r in rows)
        self.x = np.array([r["x"] + [0] * (d - len(r["x"])) for r in rows], np.int64).reshape(len(rows), d)
        self.most = [r["highs"] for r in rows]
        self.floor = [list(r["lows"]) for r in rows]
        self.found: list[list[list[tuple[int, int]]]] = [[[] for _ in r["lows"]] for r in rows]

    def search(self, label: int, tree: Tree) -> None:
        chosen = np.flatnonzero((self.label == label) == self.same)
        d = max(self.x.shape[1], tree.x.shape[1])
        tree.x, tree.low, tree.high = _wide(tree.x, d), _wide(tree.low, d), _wide(tree.high, d)
        for k in range(0, len(chosen), 1024):
            some = chosen[k:k + 1024]
            x = _wide(self.x[some], d)
            up, down = np.maximum(x, 0), np.minimum(x, 0)
            upper = _dot(up, tree.high) + _dot(down, tree.low)
            lower = _dot(up, tree.low) + _dot(down, tree.high)
            exact = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(tree.x.astype(float)).max(initial=0)) * max(1, d) < 2**52
            rows, queries = (tree.x.astype(float), x.astype(float)) if exact else (tree.x.astype(object), x.astype(object))
            for i, anchor in enumerate(some):
                if self.most[anchor]:
                    self._best_first(int(anchor), tree, rows, queries[i], upper[i], lower[i])

    def _best_first(self, anchor: int, tree: Tree, rows: np.ndarray, x: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        floor, most = self.floor[anchor], self.most[anchor]

        def wanted(node: int) -> bool:
            high, low = upper[node], lower[node]
            return any(high >= f and low <= m for f, m in zip(floor, most, strict=True))

        root = len(upper) - 1
        queue = [(-upper[root], root)]
        while queue:
            _, node = heapq.heappop(queue)
            if upper[node] < min(floor):
                return  # the others lie no higher
            if not wanted(node):
                continue
            if node >= tree.leaves:
                for child in range(tree.first[node], tree.last[node]):
                    if wanted(child):
                        heapq.heappush(queue, (-upper[child], child))
                continue
            a, b = tree.first[node], tree.last[node]
            score = rows[a:b] @ x
            near = np.flatnonzero((score >= min(floor)) & (score <= max(most)))
            if len(near):
                self._take(anchor, score[near], tree.ids[a:b][near])

    def _take(self, anchor: int, score: np.ndarray, ids: np.ndarray) -> None:
        if self.same:
            other = ids != self.own[anchor]
            score, ids = score[other], ids[other]
        for w, (least, most) in enumerate(zip(self.floor[anchor], self.most[anchor], strict=True)):
            inside = np.flatnonzero((score >= least) & (score <= most))
            if not len(inside):
                continue
            best = inside[np.lexsort((ids[inside], -score[inside]))[: self.k]]
            both = sorted([*self.found[anchor][w], *((-int(score[i]), int(ids[i])) for i in best)])[: self.k]
            self.found[anchor][w] = both
            if len(both) == self.k:
                self.floor[anchor][w] = max(self.floor[anchor][w], -both[-1][0])

    def result(self) -> pa.RecordBatch:
        out = [
            (int(self.num[i]), w, max(LEAST, min(MOST, -s)), v)
            for i, windows in enumerate(self.found) for w, best in enumerate(windows) for s, v in best]
        return pa.RecordBatch.from_pylist([dict(zip(HITS.names, r, strict=True)) for r in out], schema=HITS)


HITS = pa.schema([("num", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64())])


def first_in_windows(anchors: DataFrame, trees: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``num``, ``w``, ``rank``, ``score``, ``found_id``: the first ``k`` rows in each window of each anchor.

    ``anchors``: ``num`` (gapless), ``vec_id``, ``label``, ``x``, ``lows``, ``highs``; both ends of a window belong to it.
    """
    spark = anchors.sparkSession
    most = anchors.agg(F.max("num")).first()[0]
    blocks = 0 if most is None else most // ANCHORS + 1
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, rows, searches = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["part"]) != stretch:
                    if searches:
                        yield searches.result()
                    stretch, rows, searches = (row["block"], row["part"]), [], None
                if row["tree"] is None:
                    rows.append(row)
                elif rows:
                    searches = searches or Searches(rows, k, same_label)
                    searches.search(row["label"], Tree.unpacked(row["tree"]))
        if searches:
            yield searches.result()

    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = anchors.select(F.expr(f"cast(num div {ANCHORS} as int)").alias("block"), every.alias("part"), F.lit(0).alias("kind"), "num", "vec_id", "label", "x", "lows", "highs")
    held = trees.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block"), F.expr(f"cast(pmod(xxhash64(tree.ids), {groups}) as int)").alias("part"),
        F.lit(1).alias("kind"), "label", "tree")
    rows = asked.unionByName(held, allowMissingColumns=True).repartition(groups, "block", "part").sortWithinPartitions("block", "part", "kind")
    hits = rows.mapInArrow(run, "num long, w int, score long, found_id long")
    rank = F.row_number().over(Window.partitionBy("num", "w").orderBy(F.desc("score"), "found_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: F.Column | str) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    kept = written(usable(rows), "usable")
    trees = written(pack(kept), "trees")
    anchors = written(positioned(kept.where(is_anchor), ["vec_id", "label", "x"], "anchors", "num"), "numbered-anchors")
    whole = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    positives = written(first_in_windows(whole, trees, POSITIVES, True).select("num", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("found_id").alias("positive_id")), "positives")
    # 50 p <= 100 n <= 95 p can hold only where p is not negative.
    bounds = positives.where("positive_score >= 0").selectExpr(
        "num", "place", "positive_score", "positive_id", "positive_score div 2 + positive_score % 2 as low",
        "cast(cast(positive_score as decimal(20, 0)) * 95 div 100 as long) as high")
    windows = bounds.groupBy("num").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("s"))
    asked = anchors.join(windows.selectExpr("num", "s.low as lows", "s.high as highs", "s.place as places"), "num")
    negatives = first_in_windows(asked, trees, NEGATIVES, False)
    # Windows are numbered in the order of the positives, from 0; places run from 1 without a gap, as scores fall.
    named = bounds.select("num", (F.col("place") - 1).alias("w"), "positive_id", "positive_score")
    return (
        negatives.join(named, ["num", "w"]).join(anchors.select("num", F.col("vec_id").alias("anchor_id")), "num")
        .select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x,
    row_number() OVER () AS num
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
), scored AS (
  SELECT a.num, a.vec_id AS anchor_id, r.vec_id AS found_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND (a.label <> r.label OR a.vec_id <> r.vec_id)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY num ORDER BY score DESC, found_id) AS place FROM scored WHERE same QUALIFY place <= 5
), ranked AS (
  SELECT p.anchor_id, p.found_id AS positive_id, n.found_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.num, p.place ORDER BY n.score DESC, n.found_id) AS rank
  FROM positives p JOIN scored n ON n.num = p.num AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
