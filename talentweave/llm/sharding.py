"""Shards by balanced label propagation.

Rows are vertices; rows of one link group (equal texts, unless another key is given) are neighbours. A group is a vertex of
its own between them, so a group of n rows costs n links, not n². Every round each group looks where most of its rows lie
and asks for the rest to move there; quotas for each pair of shards, solved from the counted wishes and the free room, decide
which share of them moves. Small groups move whole, large ones row by row, so a group larger than a shard fills several.

The law is ``rows``: shard sizes differ by at most one row. The last step keeps linked rows in their shards up to the
exact quota and fills the remaining slots with rows that have no links, all by positions in one global order.

Null texts have 16 bytes and count as empty texts. Repeated rows are rows of their own, with slots of their own. An empty table
gives an empty result; extra columns are not read. Ties are decided by hashes of the group, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import positioned, table, written

SHARDS = 40
ROUNDS = 12
#: Room over an even share while rows still move; the last step is exact.
SLACK = 0.02
ROW_OVERHEAD = 16


def vertices(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"),
    )


def _share(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 that depends on the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def move_quotas(wishes: dict[tuple[int, int], int], linked: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """Share of the rows wishing to go from one shard to another that may go.

    All wishes are granted at first, so that shards which are full can exchange rows. Where a shard would then hold
    too many linked rows, those coming in are cut in proportion; that keeps rows elsewhere, so it is repeated until all fit. Rows
    without links don't count: they fill what is left at the end.
    """
    granted = {k: float(v) for k, v in wishes.items()}
    for _ in range(100):
        changed = False
        for j in range(len(linked)):
            coming = sum(v for (_, b), v in granted.items() if b == j)
            staying = linked[j] - sum(v for (a, _), v in granted.items() if a == j)
            if coming and staying + coming > capacity + 1e-6:
                part = max(0.0, capacity - staying) / coming
                granted.update({k: v * part for k, v in granted.items() if k[1] == j})
                changed = True
        if not changed:
            break
    return {k: v / wishes[k] for k, v in granted.items() if v > 0}


def propagate(linked: DataFrame, rows: int, shards: int, rounds: int) -> DataFrame:
    """Rows with links (``group``, ``row``, ``n``) get ``label``; every round is written, so lost work restarts there."""
    capacity = (1 + SLACK) * rows / shards + 2
    now = linked.withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    now = written(now, "labels")
    for r in range(rounds):
        counts = now.groupBy("group", "label").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        # A group that doesn't fit into one shard wishes for as many as it fills.
        fills = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
        tie = F.pmod(F.xxhash64("group", "label"), F.lit(1 << 30)).alias("tie")
        ranked = counts.groupBy("group").agg(  # at most one entry a shard
            F.reverse(F.array_sort(F.collect_list(F.struct("c", tie, "label")))).alias("ranked"), F.first("n").alias("n"),
        )
        targets = ranked.select("group", F.transform(F.slice("ranked", 1, fills), lambda x: x["label"]).alias("targets"))
        asked = now.join(targets, "group").withColumn(
            "wish",
            F.when(F.array_contains("targets", F.col("label")), F.col("label")).otherwise(
                F.element_at("targets", (F.pmod(F.xxhash64("row", F.lit(r)), F.size("targets")) + 1).cast("int"))),
        ).drop("targets")
        asked = written(asked, "wishes")
        flows = {(x["label"], x["wish"]): x["c"] for x in asked.groupBy("label", "wish").agg(F.count("*").alias("c")).collect()}  # shards² rows at most
        wishes = {k: v for k, v in flows.items() if k[0] != k[1]}
        settled = asked.select("group", "row", "n", F.col("wish").alias("label"))
        if not wishes or r == rounds - 1:
            return settled  # what no longer fits is moved on, group by group, by the exact step
        held = [sum(v for (a, _), v in flows.items() if a == j) for j in range(shards)]
        quotas = move_quotas(wishes, held, capacity)
        if not quotas:
            return settled
        granted = linked.sparkSession.createDataFrame([(a, b, q) for (a, b), q in quotas.items()], "label int, wish int, quota double")
        whole = F.col("n") <= F.lit(capacity / 8)
        share = F.when(whole, _share(r, "group")).otherwise(_share(r, "row"))
        now = asked.join(F.broadcast(granted), ["label", "wish"], "left").withColumn(
            "label", F.when(share < F.coalesce("quota", F.lit(0.0)), F.col("wish")).otherwise(F.col("label")),
        ).drop("wish", "quota")
        now = written(now.select("group", "row", "n", "label"), "labels")
    return now


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with ``group``) with ``shard`` and ``slot``; shard sizes differ by at most one."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vertices")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    linked = rows.select("group", "row").join(sizes, "group")
    total = rows.count()
    labels = propagate(linked, total, shards, rounds)
    placed = rows.join(labels.select("row", "label"), "row", "left").withColumn("label", F.coalesce("label", F.lit(shards)))
    placed = positioned(placed, ["label", "group", "doc_id", "row"], "placed")
    counts = dict(placed.groupBy("label").count().collect())  # one row a shard
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    starts, spills, rooms, at, spilled, room = [], [], [], 0, 0, 0
    for j in range(shards):
        starts.append(at)
        spills.append(spilled)
        rooms.append(room)
        kept = min(counts.get(j, 0), quota[j])
        at += counts.get(j, 0)
        spilled += counts.get(j, 0) - kept
        room += quota[j] - kept
    per_label = [(j, starts[j], spills[j], quota[j]) for j in range(shards)] + [(shards, at, spilled, 0)]
    plan = rows.sparkSession.createDataFrame(per_label, "label int, _start long, _spill long, _quota long")
    place = F.col("position") - F.col("_start")
    # Rows over a quota, then rows without links, take the free slots in order.
    free = F.col("_spill") + place - F.col("_quota")
    edges = F.array(*[F.lit(x).cast("long") for x in rooms])
    filled = F.array(*[F.lit(min(counts.get(j, 0), quota[j])).cast("long") for j in range(shards)])
    target = F.size(F.filter(edges, lambda x: x <= F.col("_free"))) - 1
    return (
        placed.join(F.broadcast(plan), "label").withColumn("_stays", place < F.col("_quota")).withColumn("_place", place)
        .withColumn("_free", free).withColumn("_to", target)
        .withColumn("shard", F.when(F.col("_stays"), F.col("label")).otherwise(F.col("_to")).cast("int"))
        .withColumn("slot", F.when(F.col("_stays"), F.col("_place")).otherwise(
            F.col("_free") - F.element_at(edges, F.col("shard") + 1) + F.element_at(filled, F.col("shard") + 1)))
        .drop("_start", "_spill", "_quota", "_stays", "_place", "_free", "_to", "position", "label", "row")
    )


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(vertices(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
