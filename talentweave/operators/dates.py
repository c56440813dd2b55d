"""Date ranges with their positions, and years of experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import dates as D
from talentweave.functions import text as T


def located(marked: DataFrame, carry: list[str] | None = None, context: int = 0) -> DataFrame:
    """Matches of a ``marked`` text as ``(doc_id, pos, start, end, match, before, after)``.

    Only lengths, matches and, when asked for, ``context`` characters on both sides leave the row of the text.
    """
    carry = carry or []
    pieces = marked.select("doc_id", *carry, F.posexplode(F.split("marked", T.OPEN)).alias("p", "piece"))
    gap = F.substring_index("piece", T.CLOSE, -1)
    narrow = pieces.select(
        "doc_id", *carry, "p",
        (F.length("piece") - F.when(F.col("p") > 0, 1).otherwise(0)).alias("_len"),
        F.when(F.col("p") > 0, F.substring_index("piece", T.CLOSE, 1)).alias("match"),
        F.length(gap).alias("_gap"),
        *([F.left(gap, F.lit(context)).alias("after"), F.right(gap, F.lit(context)).alias("_tail")] if context else []),
    )
    order = Window.partitionBy("doc_id").orderBy("p")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("start", F.coalesce(F.sum("_len").over(before), F.lit(0)).cast("int"))
    placed = placed.withColumn("_prev_gap", F.lag("_gap").over(order)).withColumn("next_gap", F.col("_gap"))
    if context:
        placed = placed.withColumn("before", F.lag("_tail").over(order))
    return placed.where("p > 0").select(
        "doc_id", *carry, (F.col("p") - 1).alias("pos"), "start",
        (F.col("start") + F.length("match")).alias("end"), "match",
        F.col("_prev_gap").alias("gap_before"), F.col("next_gap").alias("gap_after"),
        *(["before", "after"] if context else []),
    )


def extract_date_ranges(docs: DataFrame, text: str = "text", pattern: str = D.TEXT_DATE) -> DataFrame:
    """``(doc_id, pos, start, end, period)`` of every date range; offsets count characters from 0."""
    marked = docs.select("doc_id", D.mark_dates(F.col(text), pattern).alias("marked"))
    return located(marked).select("doc_id", "pos", "start", "end", F.col("match").alias("period"))


def filter_date_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Date ranges of dataset résumés that may start or end a job; narrative mentions are left out."""
    marked = docs.select("doc_id", D.unmark_narrative_dates(D.mark_dates(F.col(text), D.DATASET_DATE)).alias("marked"))
    return located(marked).select("doc_id", "pos", "start", "end", F.col("match").alias("period"))


def total_experience_years(items: DataFrame, variant: str, as_of_year: int = K.AS_OF_YEAR) -> DataFrame:
    """Span of years per document over ``(doc_id, period)`` rows; a row with a null period stands for no job.

    Variants differ where no year is found: ``text`` gives 0, ``dataset`` gives null when there are jobs.
    """
    years: Column = (
        D.profile_years(F.col("period"), as_of_year) if variant == "profile"
        else D.years_with_open_end(F.col("period"), as_of_year)
    )
    per_item = items.select(
        "doc_id", F.col("period").isNotNull().cast("int").alias("_job"), years.alias("_years")
    ).select("doc_id", "_job", F.array_min("_years").alias("_low"), F.array_max("_years").alias("_high"))
    spans = per_item.groupBy("doc_id").agg(
        F.max("_job").alias("_job"), (F.max("_high") - F.min("_low")).alias("_span")
    )
    empty = F.when(F.col("_job") == 0, 0) if variant == "dataset" else F.lit(0)
    return spans.select("doc_id", F.coalesce("_span", empty).alias("total_experience"))
