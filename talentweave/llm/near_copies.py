"""Near copies by BagMinHash signatures.

A document is a multiset of shingles of five words; a shingle's count is its weight. Weights are cut into unit steps, and the
steps of a shingle into blocks [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each block has a Poisson process of points in time, seeded
by the shingle and the block, whose rate is its width. A wide block is only followed to its first point; there it splits into
halves, one of which has that point, and halves beyond the weight are dropped. So a count of n needs about as many steps as it
has points that matter, not n. A signature value is the earliest point of its slot; two documents share it with a probability
equal to their weighted Jaccard similarity. Points are made up to a time by which all slots are likely filled, and again to twice
that time for documents where one isn't.

Signatures are cut into 24 bands of 4 values: a pair of similarity 0.8 is missed by all of them with probability 3e-6. In each bucket
all members are held against its smallest one, exactly, by their multisets. Where a bucket then still holds several components, its
members of different components are compared in tiles of bounded size: by signature, and exactly where the signatures leave a
similarity of 0.8 possible. Only links leave a tile. Classes are the connected components of all links, so copies of copies share one.

Null texts are empty texts. Texts without words, like all texts, are copies of equal texts only; texts of one to four words are one
shingle. Rows are told apart by doc_id and text, so repeated rows share a class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table, written
from talentweave.llm.components import components
from talentweave.llm.words import mixed, shingle_hashes

BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
LIMIT = 0.8
#: Four standard deviations of a similarity estimated from ``SLOTS`` values, at the limit.
MARGIN = 4 * (LIMIT * (1 - LIMIT) / SLOTS) ** 0.5
TILE = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _points(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, until: np.ndarray, best: np.ndarray) -> None:
    """Lower ``best`` (documents by slots) to the earliest point of each slot up to a document's time ``until``."""
    low = [np.zeros(len(key), np.int64)]
    pick = [np.arange(len(key))]
    start = 1
    while True:
        more = np.flatnonzero(weight > start)
        if not len(more):
            break
        pick.append(more)
        low.append(np.full(len(more), start))
        start *= 2
    low, pick = np.concatenate(low), np.concatenate(pick)
    width = np.maximum(low, 1)
    key = mixed(key[pick] ^ (low.astype(np.uint64) * GOLDEN))
    weight, doc = weight[pick], doc[pick]
    time, count = np.zeros(len(key)), np.zeros(len(key), np.uint64)
    given = np.zeros(len(key), bool)  # the block's next point is at ``time`` already
    while len(key):
        count = count + (~given).astype(np.uint64)
        gap = -np.log(_uniform(mixed(key + count * GOLDEN))) / width
        time = np.where(given, time, time + gap)
        live = np.flatnonzero(time <= until[doc])
        key, weight, doc, low, width, time, count = (a[live] for a in (key, weight, doc, low, width, time, count))
        leaf = width == 1
        draw = mixed(key ^ ((count + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
        at = np.flatnonzero(leaf)
        np.minimum.at(best, (doc[at], (draw[at] % np.uint64(SLOTS)).astype(np.int64)), time[at])
        wide = np.flatnonzero(~leaf)
        if not len(wide):
            given = np.zeros(len(key), bool)
            continue
        half, right_has = width[wide] // 2, (draw[wide] & np.uint64(1)).astype(bool)
        right = low[wide] + half < weight[wide]
        r = wide[right]
        key = np.concatenate([key[at], mixed(key[wide] ^ np.uint64(0xA0761D6478BD642F)), mixed(key[r] ^ np.uint64(0xE7037ED1A0B428DB))])
        given = np.concatenate([np.zeros(len(at), bool), ~right_has, right_has[right]])
        low = np.concatenate([low[at], low[wide], low[r] + half[right]])
        width = np.concatenate([width[at], half, half[right]])
        weight, doc, time = (np.concatenate([a[at], a[wide], a[r]]) for a in (weight, doc, time))
        count = np.concatenate([count[at], np.zeros(len(wide) + len(r), np.uint64)])


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts by slots) and the number of shingles of each text; rows without shingles mean nothing."""
    shingle, owner = shingle_hashes(texts)
    total = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), int)
    keys, weights, docs = [], [], []
    ends = np.cumsum(total)
    for d in np.flatnonzero(total):
        values, counts = np.unique(shingle[ends[d] - total[d]:ends[d]], return_counts=True)
        keys.append(values)
        weights.append(counts)
        docs.append(np.full(len(values), d))
    best = np.full((len(texts), SLOTS), np.inf)
    if keys:
        key, weight, doc = np.concatenate(keys), np.concatenate(weights), np.concatenate(docs)
        until = SLOTS * (np.log(SLOTS) + 4) / np.maximum(total, 1)
        while len(key):
            _points(key, weight, doc, until, best)
            open_ = np.isinf(best).any(1) & (total > 0)
            keep = open_[doc]
            key, weight, doc = key[keep], weight[keep], doc[keep]
            best[open_] = np.inf
            until = until * 2
    values = (mixed(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return values, total


def band_hashes(values: np.ndarray) -> np.ndarray:
    """(texts, bands) hashes that hold the band's number."""
    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, v.shape[:2])
    for r in range(ROWS):
        h = mixed(h ^ v[:, :, r])
    return h


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 0.0


def multiset(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes([text])[0], return_counts=True)


_sketch_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("values", pa.binary())])


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held, size = [], 0
        for row in rows_of(batches, "doc_id", "text_key", "text"):
            held.append(row)
            size += len(row[2] or "")
            if len(held) >= 1024 or size >= 3 << 20:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    def done(held: list[tuple]) -> Iterator[tuple]:
        values, total = signatures([(t or "").encode() for _, _, t in held])
        for (doc_id, key, _), v, n in zip(held, values, total, strict=True):
            yield doc_id, key, v.tobytes() if n else None

    yield from batched(rows(), _sketch_schema)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, SLOTS)
            hashes = band_hashes(values).view(np.int64).ravel()
            vertex = np.repeat(batch.column("vertex").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(hashes)], names=["vertex", "band"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        last, held = None, None
        for a, text_a, b, text_b in rows_of(batches, "a", "text_a", "b", "text_b"):
            if a != last:  # pairs of one vertex follow each other
                last, held = a, multiset((text_a or "").encode())
            if overlap(held, multiset((text_b or "").encode())) >= LIMIT:
                yield a, b

    yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def texts_of(wanted: DataFrame, vertices: DataFrame, docs: DataFrame) -> DataFrame:
    """``vertex``, ``text`` of the wanted vertices, once each."""
    wanted = vertices.join(wanted.distinct(), "vertex").select("vertex", "doc_id", "text_key")
    texts = (
        _chosen(docs).withColumnRenamed("doc_id", "_d").join(wanted, "text_key").where(F.col("_d").eqNullSafe(F.col("doc_id")))
        .select("vertex", "text").dropDuplicates(["vertex"])
    )
    return written(texts, "texts")


def linked(pairs: DataFrame, vertices: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of vertices whose multisets really overlap enough.

    Texts of the vertices in pairs move to the pairs; the rows of a vertex with very many pairs spread by a salt of its partner.
    """
    texts = texts_of(pairs.select(F.col("a").alias("vertex")).union(pairs.select(F.col("b").alias("vertex"))), vertices, docs)
    salts = 16
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    heavy = pairs.groupBy("a").count().where("count > 256").select("a", F.lit(True).alias("heavy"))
    spread = spread.join(heavy, "a", "left").withColumn("salt", F.when(F.col("heavy"), F.col("salt")).otherwise(F.lit(0))).drop("heavy")
    hubs = texts.join(heavy.withColumnRenamed("a", "vertex"), "vertex", "left").select(
        F.col("vertex").alias("a"), F.col("text").alias("text_a"),
        F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    both = spread.join(texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b")), "b").join(hubs, ["a", "salt"])
    return both.select("a", "text_a", "b", "text_b").sortWithinPartitions("a").mapInArrow(_verify, "a long, b long")


def _tile(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links between different components in one tile: likely ones by signature, then exactly by their multisets."""
    i, j, band = rows[0][1], rows[0][2], rows[0][0]
    left, right = ([r for r in rows if r[3] == k] for k in (i, j))
    if not left or not right:
        return
    a, b = (np.frombuffer(b"".join(r[6] for r in part), np.uint32).reshape(-1, SLOTS) for part in (left, right))
    ha, hb = band_hashes(a).view(np.int64), band_hashes(b).view(np.int64)
    vertex, component = np.array([r[4] for r in right]), np.array([r[5] for r in right])
    sets: dict[int, tuple] = {}

    def of(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        if row[4] not in sets:
            sets[row[4]] = multiset((row[7] or "").encode())
        return sets[row[4]]

    for k, row in enumerate(left):
        at = np.flatnonzero((component != row[5]) & ((vertex > row[4]) if i == j else (vertex != row[4])))
        at = at[(b[at] == a[k]).mean(1) >= LIMIT - MARGIN] if len(at) else at
        # A pair is looked at in the first of the buckets that it shares.
        at = at[ha[k][(hb[at] == ha[k]).argmax(1)] == band] if len(at) else at
        for m in at:
            if overlap(of(row), of(right[m])) >= LIMIT:
                yield min(row[4], right[m][4]), max(row[4], right[m][4])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        for row in rows_of(batches, "band", "i", "j", "block", "vertex", "component", "values", "text"):
            if held and held[0][:3] != row[:3]:
                yield from _tile(held)
                held = []
            held.append(row)
        if held:
            yield from _tile(held)

    yield from batched(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def across(bands: DataFrame, vertices: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links within buckets that still hold several components.

    A bucket's largest component needs no comparison within itself: its blocks only meet those of the other members, so a bucket of
    one large component and few others gives little more rows than it has members.
    """
    named = bands.join(labels.withColumnRenamed("component", "_c"), "vertex", "left").withColumn("component", F.coalesce("_c", "vertex")).drop("_c")
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))
    several = sizes.groupBy("band").agg(F.sum("n").alias("all"), largest.alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    several = several.select(
        "band", F.col("largest.component").alias("main"), F.ceil((F.col("all") - F.col("largest.n")) / TILE).cast("int").alias("blocks"),
        F.ceil(F.col("largest.n") / TILE).cast("int").alias("main_blocks"))
    members = written(named.join(several, "band"), "members")
    facts = texts_of(members.select("vertex"), vertices, docs).join(vertices.select("vertex", "values"), "vertex")
    tiles = (
        members.withColumn("in_main", F.col("component") == F.col("main"))
        .withColumn("block", F.when(F.col("in_main"), F.col("blocks") + F.pmod(F.xxhash64("vertex"), F.col("main_blocks")))
                    .otherwise(F.pmod(F.xxhash64("vertex"), F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") + F.when(F.col("in_main"), 0).otherwise(F.col("main_blocks")) - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(facts, "vertex")
        .select("band", "i", "j", "block", "vertex", "component", "values", "text")
    )
    return tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "vertex").mapInArrow(_tiles, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``text_key`` and ``class_id``, the smallest doc_id of its class."""
    sketches = written(_chosen(docs).mapInArrow(_sketch, "doc_id long, text_key string, values binary"), "sketches")
    # One vertex a text: its smallest document, numbered.
    first = sketches.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("values").alias("values"))
    vertices = written(first.withColumn("vertex", F.monotonically_increasing_id()), "vertices")
    bands = vertices.where("values is not null").select("vertex", "values").mapInArrow(_bands, "vertex long, band long")
    buckets = bands.groupBy("band").agg(F.min("vertex").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(bands.join(buckets, "band"), "bands")
    pairs = shared.where("vertex <> hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()
    links = written(linked(written(pairs, "pairs"), vertices, docs), "star-links")
    labels = written(components(links), "labels")
    rest = written(across(shared.select("vertex", "band"), vertices, labels, docs), "rest")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    named = vertices.join(labels, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    classes = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    keys = named.join(classes, "component").select("text_key", "class_id")
    return sketches.select("doc_id", "text_key").join(keys, "text_key")


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))


def _free(name: str, docs: DataFrame) -> str:
    """The name with as many underscores as make it none of the columns of ``docs``."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of the document that stands for its class; documents in no class with others all stay.

    Of rows equal in doc_id and text one stays, whichever if their other columns differ. Those columns can have any name.
    """
    key, kept_id, kept_key, rows = (_free(n, docs) for n in ("key", "kept_id", "kept_key", "rows"))
    stands = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = written(stands.groupBy(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).agg(F.count("*").alias(rows)), "kept")
    keyed = docs.withColumn(key, text_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    out = keyed.join(kept.where(F.col(rows) == 1), same, "left_semi")
    repeated = kept.where(F.col(rows) > 1)
    if not repeated.isEmpty():  # only these move with their texts
        out = out.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)
