"""Near copies among vectors: Euclidean p-stable hashing of normalised vectors, then exact cosines.

A table's key is the vector's place on ``K`` random lines, cut into steps of ``WIDTH``. Unit vectors with cosine 0.95 lie 0.316 apart and share a
step with chance 0.87, unrelated ones (1.41 apart) with 0.49. ``K`` grows with the logarithm of the rows, so that a key holds
few unrelated vectors at any size, and the tables are as many as leave a pair at the threshold unfound once in ``MISSED``; closer pairs are
missed far less often. Every pair of a shared key is multiplied out, so no link lies below the threshold.

Equal vectors are one vector with a count. In dense groups pairs needn't be looked at either: vectors within half the threshold's angle of one
centre are all within the whole angle of each other. Centres are the first vectors of keys; a vector joins the first centre near enough. Links inside
such a ball are counted by its size, keys that hold one ball only end there, and the other keys are cut into tiles of ``TILE`` vectors whose
pairs are multiplied in separate tasks. A pair is counted in the first table that holds it. Tasks return counts and a forest of links, never pairs.

* Vectors that are null, empty or zero or hold a null or a value that isn't finite link with nothing; so do vectors of different lengths.
* Equal rows link with each other. ``component_id`` is the smallest number reachable, ties included: all rows with it are ``kept``. Null numbers come
  last; a component of nulls only has none, and its rows are kept.
* Only ``vec_id`` and ``embedding`` are read, so other columns can have any name. No rows: none come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import table, worker_cache, written
from talentweave.llm.components import components

LEAST_COSINE, WIDTH, MISSED, TILE, SMALL, SEED = 0.95, 2.0, 2e-4, 512, 32, 20_011
#: Rounding in a product of unit vectors stays far below this.
ROUNDING = 1e-9


def same_step(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at this distance share a step of a random line."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, least: float = LEAST_COSINE, missed: float = MISSED) -> tuple[int, int]:
    """Lines a table and tables for ``n`` vectors."""
    lines = max(4, math.ceil(math.log(max(n, 2) * 8) / -math.log(same_step(math.sqrt(2)))))
    both = same_step(math.sqrt(2 - 2 * least)) ** lines
    return lines, math.ceil(math.log(missed) / math.log1p(-both))


def keys_of(unit: np.ndarray, lines: int, tables: int) -> np.ndarray:
    """A 64-bit key for each vector and table."""
    d = unit.shape[1]
    cache = worker_cache("random lines")
    held = cache.get((d, lines, tables))
    if not held:
        if len(cache) >= 4:
            cache.clear()
        rng = np.random.default_rng([SEED, d])
        held = cache[d, lines, tables] = dict(a=rng.standard_normal((d, lines * tables)), b=rng.random(lines * tables) * WIDTH, mix=rng.integers(1, 1 << 62, lines, np.int64) * 2 + 1)
    out = np.zeros((len(unit), tables), np.int64)
    for k in range(0, len(unit), 256):
        steps = np.floor((unit[k:k + 256] @ held["a"] + held["b"]) / WIDTH).astype(np.int64).reshape(-1, tables, lines)
        mixed = (steps * held["mix"]).sum(2) + d * 0x632BE59BD9B4E019 % (1 << 62)
        out[k:k + 256] = mixed ^ (mixed >> 31)
    return out


def units(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, by length."""
    at = lists.offsets.to_numpy().astype(np.int64)
    sizes, values = np.diff(at), lists.values.to_numpy(zero_copy_only=False).astype(float)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[at[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a digest of their vector (null if it takes no part); each different vector once, with ``num``, ``copies`` and ``least_id``."""
    x = F.transform("embedding", lambda e: e.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    fit = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    digest = F.when(fit, F.sha2(F.concat_ws(",", F.transform(x, lambda e: e.cast("string"))), 256))
    all_rows = written(rows.select("vec_id", "embedding", digest.alias("digest")), "digests")
    one = all_rows.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("embedding").alias("embedding"))
    vectors = written(one.withColumn("num", F.monotonically_increasing_id()), "vectors")
    return all_rows, vectors


def _keys(vectors: DataFrame, lines: int, tables: int) -> DataFrame:
    """``num``, ``t``, ``key`` of every vector in every table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num = batch.column(0).to_numpy()
            for rows, unit in units(batch.column(1)):
                keys = keys_of(unit, lines, tables)
                yield pa.RecordBatch.from_arrays(
                    [np.repeat(num[rows], tables), np.tile(np.arange(tables, dtype=np.int32), len(rows)), keys.ravel()], names=["num", "t", "key"])

    return vectors.select("num", "embedding").mapInArrow(run, "num long, t int, key long")


def _balls(members: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``num``, ``ball``: the first centre within half the angle, for vectors that have one beside themselves."""
    half = math.cos(math.acos(least) / 2) + ROUNDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for (at, x), (_, y) in zip(units(batch.column(2)), units(batch.column(3)), strict=True):
                near[at] = (x * y).sum(1) >= half
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], names=["num", "ball"])

    asked = members.select("num", "centre").where("num <> centre").distinct()
    both = (
        asked.join(vectors.select("num", "embedding"), "num")
        .join(vectors.select(F.col("num").alias("centre"), F.col("embedding").alias("centre_embedding")), "centre")
        .where("size(embedding) = size(centre_embedding)").select("num", "centre", "embedding", "centre_embedding"))
    joined = both.mapInArrow(run, "num long, ball long").groupBy("num").agg(F.min("ball").alias("ball"))
    # A centre lies in its own ball unless it joined another one.
    return written(joined, "joined")


def _links(rows: DataFrame, lines: int, tables: int, least: float) -> DataFrame:
    """``num``, ``n`` (other vectors linked, copies counted) or ``to`` (a linked vector), from pairs of tiles."""
    def forest(linked: np.ndarray) -> np.ndarray:
        """For each row the smallest row of its component."""
        label = np.arange(len(linked))
        while True:
            seen = np.where(linked, label, len(label)).min(1)
            new = np.minimum(label, seen)
            new = np.minimum(new, new[new])
            if np.array_equal(new, label):
                return label
            label = new

    def first_here(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs whose vectors share no key in an earlier table. Few are asked for, so their keys are made again."""
        out = np.ones(len(t), bool)
        for k in range(0, len(t), 4096):
            some = slice(k, k + 4096)
            same = keys_of(x[some], lines, tables) == keys_of(y[some], lines, tables)
            out[some] = same.argmax(1) >= t[some]
        return out

    def small_groups(g: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        """Pairs of rows with equal ``g``, of groups of at most ``SMALL`` rows."""
        last = np.searchsorted(g, g, "right")
        ahead = last - np.arange(len(g)) - 1
        i = np.repeat(np.arange(len(g)), ahead)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        apart = c["ball"][i] != c["ball"][j]
        i, j = i[apart], j[apart]
        close = np.concatenate([np.zeros(0, bool), *((c["unit"][i[k:k + 65536]] * c["unit"][j[k:k + 65536]]).sum(1) >= least for k in range(0, len(i), 65536))])
        i, j = i[close], j[close]
        new = first_here(c["t"][i], c["unit"][i], c["unit"][j])
        i, j = i[new], j[new]
        yield {"num": c["num"][np.concatenate([i, j])], "n": c["copies"][np.concatenate([j, i])]}
        yield {"num": c["num"][i], "to": c["num"][j]}

    def tile_pair(a: dict[str, np.ndarray], b: dict[str, np.ndarray], halves: bool) -> Iterator[dict[str, np.ndarray]]:
        close = (a["unit"] @ b["unit"].T >= least) & (a["ball"][:, None] != b["ball"])
        i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
        if not len(i):
            return
        close, t = close[np.ix_(i, j)], int(a["t"][0])
        if t:
            left, right = (keys_of(x["unit"][k], lines, tables)[:, :t] for x, k in ((a, i), (b, j)))
            p, q = np.nonzero(close)
            for k in range(0, len(p), 16384):
                some = slice(k, k + 16384)
                close[p[some], q[some]] = ~(left[p[some]] == right[q[some]]).any(1)
        num_a, num_b = a["num"][i], b["num"][j]
        yield {"num": num_a, "n": close @ b["copies"][j]}
        if halves:
            yield {"num": num_b, "n": close.T @ a["copies"][i]}
        num = np.unique(np.concatenate([num_a, num_b]))
        linked = np.zeros((len(num), len(num)), bool)
        linked[np.ix_(np.searchsorted(num, num_a), np.searchsorted(num, num_b))] = close
        to = forest(linked | linked.T)
        own = np.arange(len(num))
        yield {"num": num[to < own], "to": num[to[to < own]]}

    def complete(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        """Links of the groups of a batch, all of them whole."""
        columns = {k: batch.column(k).to_numpy() for k in ("t", "key", "tile_a", "tile_b", "side", "num", "ball", "copies")}
        new = np.any([columns[k][1:] != columns[k][:-1] for k in ("t", "key", "tile_a", "tile_b")], axis=0)
        group = np.cumsum(np.append(False, new))
        size = np.bincount(group)
        for rows, unit in units(batch.column("embedding")):
            c = {k: v[rows] for k, v in columns.items()} | {"unit": unit}
            g = group[rows]
            small = (size[g] <= SMALL) & (c["tile_a"] == c["tile_b"])
            yield from small_groups(g[small], {k: v[small] for k, v in c.items()})
            for large in np.unique(g[~small]):
                own = slice(np.searchsorted(g, large), np.searchsorted(g, large, "right"))
                whole = {k: v[own] for k, v in c.items()}
                parts = [{k: v[whole["side"] == side] for k, v in whole.items()} for side in (0, 1)]
                halves = bool(whole["tile_a"][0] != whole["tile_b"][0])
                if all(len(p["num"]) for p in parts[: 1 + halves]):
                    yield from tile_pair(parts[0], parts[halves], halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("num", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

        def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for found in complete(batch):
                n = len(found["num"])
                yield pa.RecordBatch.from_arrays([pa.array(found[k], pa.int64()) if k in found else pa.nulls(n, pa.int64()) for k in schema.names], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = [batch.column(k).to_numpy() for k in ("t", "key", "tile_a", "tile_b")]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in group], axis=0)) + 1
            starts = not held or any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(("t", "key", "tile_a", "tile_b"), group, strict=True))
            last = int(changes[-1]) if len(changes) else 0
            if last or starts:  # what is held ends before the last group of this batch
                held.append(batch.slice(0, last))
                whole = pa.concat_batches(held)
                if whole.num_rows:
                    yield from out(whole)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out(pa.concat_batches(held))

    return rows.mapInArrow(run, "num long, n long, to long")


def link(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row."""
    all_rows, vectors = _distinct(rows)
    lines, tables = plan(vectors.count(), least)

    keyed = written(_keys(vectors, lines, tables), "keyed")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("size"), F.min("num").alias("centre")).where("size > 1")
    members = written(keyed.join(shared, ["t", "key"]), "members")
    joined = _balls(members, vectors, least)
    ball = F.coalesce("ball", "num").alias("ball")
    full = written(vectors.join(joined, "num", "left").select("num", "copies", "embedding", ball), "in-balls")

    # Tiles: a ball with many members in a key has its own, the other vectors share some.
    placed = members.join(full.select("num", "ball"), "num")
    per_ball = placed.groupBy("t", "key", "ball").agg(F.count("*").alias("here"), F.first("size").alias("size"))
    mixed = per_ball.where("here < size").withColumn("own", F.col("here") > TILE)
    cuts = F.ceil(F.when(F.col("own"), F.col("here")).otherwise(F.col("size")) / TILE)
    tile = F.when(F.col("own"), F.xxhash64("ball", F.pmod(F.xxhash64("num"), "cuts"))).otherwise(F.pmod(F.xxhash64("ball"), "cuts"))
    tiled = written(placed.drop("size").join(mixed.withColumn("cuts", cuts).drop("size", "here"), ["t", "key", "ball"])
                    .select("t", "key", "num", "ball", "own", tile.alias("tile")), "tiled")
    tiles = written(tiled.groupBy("t", "key", "tile").agg(F.max(F.when(F.col("own"), F.col("ball"))).alias("whole")), "tiles")
    other = tiles.select("t", "key", F.col("tile").alias("tile_b"), F.col("whole").alias("whole_b"))
    pairs = tiles.withColumnRenamed("tile", "tile_a").join(other, ["t", "key"]).where("tile_a <= tile_b and not coalesce(whole = whole_b, false)").select("t", "key", "tile_a", "tile_b")
    sides = pairs.select("t", "key", "tile_a", "tile_b", F.col("tile_a").alias("tile"), F.lit(0).alias("side")).union(
        pairs.where("tile_a < tile_b").select("t", "key", "tile_a", "tile_b", F.col("tile_b").alias("tile"), F.lit(1).alias("side")))
    whole = tiled.select("t", "key", "tile", "num").join(sides, ["t", "key", "tile"]).join(full, "num")
    group = ["t", "key", "tile_a", "tile_b"]
    met = whole.select(*group, "side", "num", "ball", "copies", "embedding").repartition(*group).sortWithinPartitions(*group)
    found = written(_links(met, lines, tables, least), "links")

    in_balls = full.groupBy("ball").agg(F.sum("copies").alias("mass"))
    across = found.where("n is not null").groupBy("num").agg(F.sum("n").alias("across"))
    n_links = F.col("mass") - 1 + F.coalesce("across", F.lit(0))
    counted = full.join(in_balls, "ball").join(across, "num", "left").select("num", n_links.alias("n_links"))
    edges = found.where("to is not null").select(F.col("num").alias("a"), F.col("to").alias("b")).union(full.where("ball <> num").select("num", "ball"))
    named = components(edges)
    grouped = vectors.select("num", "digest", "least_id").join(named.select(F.col("vertex").alias("num"), "component"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    grouped = written(grouped, "grouped")
    least_id = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_vector = grouped.join(least_id, "component").join(counted, "num").select("digest", "component_id", "n_links")

    out = all_rows.select("vec_id", "digest").join(per_vector, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_close_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding) AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
"""
