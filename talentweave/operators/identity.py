"""Ids, content hashes, duplicate removal, newest document, upsert."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave import constants as K

NUMBERING_ERROR = 0.001


def _bucketed(df: DataFrame, order_key: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: ranges of ``order_key`` that hold about the same number of rows."""
    cuts = df.approxQuantile(order_key, [i / buckets for i in range(1, buckets)], NUMBERING_ERROR) if buckets > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0))
    # Written out on a bigint key: a double has fewer digits, but it never swaps two keys.
    ranges = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="error")
    out = ranges.transform(df.withColumn("_key", F.col(order_key).cast("double")))
    return out.withColumn("_bucket", F.col("_range").cast("int")).drop("_key", "_range")


def number_in_group(
    df: DataFrame, group: list[str], order_key: str, out: str = "n", buckets: int | None = None
) -> DataFrame:
    """Dense 1-based ``row_number`` per group by a unique numeric ``order_key``.

    A group is cut into ranges of the key, numbered range by range, and shifted by the rows of the ranges
    before. No task ever sorts more than one range, also when one group holds most rows.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = _bucketed(df, order_key, buckets)
    keys = [*group, "_bucket"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(order_key)))
    return (
        local.join(starts, keys)
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_start", "_local")
    )


def kind_of(category: Column) -> Column:
    """A for a résumé, B for a posting; a missing category means résumé."""
    return F.when(category == "job", K.POSTING_PREFIX).otherwise(K.RESUME_PREFIX)


def assign_doc_ids(df: DataFrame, order_key: str, existing: DataFrame | None = None) -> DataFrame:
    """Add ``kind``, ``num`` and ``id``. Numbers go on after the largest ``num`` per kind in ``existing``."""
    numbered = number_in_group(df.withColumn("kind", kind_of(F.col("category"))), ["kind"], order_key, "_n")
    if existing is not None:
        last = existing.groupBy("kind").agg(F.max("num").alias("_last"))
        numbered = numbered.join(last, "kind", "left")
        num = F.col("_n") + F.coalesce(F.col("_last"), F.lit(0))
    else:
        num = F.col("_n")
    out = numbered.withColumn("num", num.cast("bigint")).drop("_n", "_last")
    return out.withColumn("id", F.concat("kind", F.col("num").cast("string")))


def content_hash(df: DataFrame, content: str = "raw_data") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(content, 256))


def dedup_content(df: DataFrame, num: str = "num", content: str = "raw_data") -> DataFrame:
    """Keep, per content, the record with the smallest number. Null contents are all kept.

    Only hashes and numbers are grouped, so copies fold together before the shuffle; the texts move once.
    """
    hashed = content_hash(df, content)
    key = F.coalesce("content_hash", F.concat(F.lit("null "), F.col(num).cast("string")))
    first = hashed.groupBy(key.alias("_key")).agg(F.min(num).alias(num))
    return hashed.join(first.select(num), num, "left_semi")


def latest_document(df: DataFrame) -> DataFrame:
    """Per kind the id with the largest number."""
    return df.groupBy("kind").agg(F.max("num").alias("num")).withColumn("id", F.concat("kind", F.col("num").cast("string")))


def upsert_documents(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Append the records whose key the base does not hold; a second run adds nothing."""
    return base.unionByName(new.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key, as an aggregate so that repeats fold map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def dedup_education(df: DataFrame) -> DataFrame:
    """First entry (by ``pos``) per document and lower-case "institution-degree"."""
    named = df.withColumn("_key", F.lower(F.concat_ws("-", "institution", "degree")))
    return first_per_key(named, ["doc_id", "_key"], "pos").drop("_key")


def dedup_mentions(df: DataFrame) -> DataFrame:
    """One of the mentions of a document with the same span and value.

    The rows come out by document in the order of their spans, so steps by document that follow neither send nor sort them again.
    """
    keys = ["start", "end", "value"]
    order = Window.partitionBy("doc_id").orderBy(*keys, *[c for c in ("kind",) if c in df.columns])
    again = F.lag(F.lit(True)).over(order)
    for key in keys:
        again = again & F.lag(key).over(order).eqNullSafe(F.col(key))
    return df.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again")).drop("_again")
