"""Frequencies, top-n reports and summary statistics of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave import constants as K

ATTRIBUTES = {"title": "title", "location": "location", "company": "company", "category": "category"}


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-empty value of one column."""
    return df.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def freq_skills(postings: DataFrame) -> DataFrame:
    return frequency(postings.select(F.explode("skills").alias("skill")), "skill")


def freq_all(postings: DataFrame) -> DataFrame:
    """Counts of titles, skills, locations, companies and categories in one pass: ``(attribute, value, n)``."""
    pair = lambda name, c: F.struct(F.lit(name).alias("attribute"), c.alias("value"))
    single = F.array(*[pair(a, F.col(c)) for a, c in ATTRIBUTES.items()])
    skills = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: pair("skill", s))
    rows = postings.select(F.explode(F.concat(single, skills)).alias("p")).where("p.value != ''")
    return rows.groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n"))


def top_n_report(counts: DataFrame, top_n: int = K.REPORT_TOP_N) -> DataFrame:
    """Most frequent values per attribute with share and number of values left out.

    Totals are an aggregate of their own; the rank keeps only ``top_n`` rows per task before the shuffle.
    """
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_values"))
    order = Window.partitionBy("attribute").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return top.join(totals, "attribute").select(
        "attribute", "rank", "value", "n", (F.col("n") / F.col("_all") * 100).alias("pct"),
        F.greatest(F.col("_values") - top_n, F.lit(0)).alias("more"),
    )


def summary_stats(postings: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row: postings, distinct values per attribute, postings with and without skills.

    Distinct values are counted from the frequency table, which is already one row per value.
    """
    counts = freq_all(postings) if counts is None else counts
    unique = counts.groupBy().agg(*[
        F.count_if(F.col("attribute") == a).alias(f"unique_{p}")
        for a, p in (("title", "job_titles"), ("skill", "skills"), ("location", "locations"), ("company", "companies"))
    ])
    with_skills = F.coalesce(F.size("skills"), F.lit(0)) > 0
    totals = postings.groupBy().agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(with_skills).alias("jobs_with_skills"),
        F.count_if(~with_skills).alias("jobs_without_skills"),
    )
    return _one_row(totals, unique)


def _one_row(*parts: DataFrame) -> DataFrame:
    """Side by side columns of one-row tables, as an aggregate over their union."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy().agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])


def report_document(postings: DataFrame, top_n: int = K.REPORT_TOP_N) -> DataFrame:
    """The report as one nested row: top values of four attributes, all categories, statistics.

    Four maps have ``top_n`` entries; the category map has one entry per category of the schema.
    """
    counts = freq_all(postings)
    order = Window.partitionBy("attribute").orderBy(F.desc("n"), "value")
    # Two filters, so that the one on the four long attributes can be pushed into the window.
    long = counts.where("attribute != 'category'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    short = counts.where("attribute = 'category'").withColumn("rank", F.row_number().over(order))
    top = long.unionByName(short)

    def as_map(attribute: str, name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("attribute") == attribute, F.struct("rank", "value", "n"))))
        return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["value"], r["n"]))).alias(name)

    maps = top.groupBy().agg(
        as_map("title", "top_job_titles"), as_map("skill", "top_skills"), as_map("location", "top_locations"),
        as_map("company", "top_companies"), as_map("category", "categories"),
    )
    stats = summary_stats(postings, counts)
    fields = ["unique_job_titles", "unique_skills", "unique_locations", "unique_companies"]
    return _one_row(stats, maps).select(
        "total_jobs", "top_job_titles", "top_skills", "top_locations", "top_companies", "categories",
        F.struct(*fields).alias("statistics"),
    )
