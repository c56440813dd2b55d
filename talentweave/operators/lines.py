"""Lines, columns and sections of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import dataset_text as DT
from talentweave.functions import free_text as FT
from talentweave.functions import text as T


def normalized(c: Column) -> Column:
    """NFC, then plain blanks and dashes. Texts that NFC cannot change are not sent to Python."""
    open_text = F.when(~F.rlike(c, F.lit(K.ALWAYS_COMPOSED_PATTERN)), c)
    return T.fix_characters(F.coalesce(T.compose_unicode(open_text), c, F.lit("")))


def normalize_chars(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, normalized(F.col(text)))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, pos, line)`` of trimmed non-empty lines without page footers."""
    lines = T.lines_of(T.drop_footers_and_translate(F.col(text)))
    rest = [c for c in docs.columns if c != text]
    return normalize_chars(docs, text).select(*rest, F.posexplode(lines).alias("pos", "line"))


def assemble_columns(boxes: DataFrame) -> DataFrame:
    """Text of the left and right column of a document from its text boxes ``(pdf_page, x0, y1, seq, text)``.

    Pages in order, boxes from top to bottom, ties in reading order. A document is one input file, so its
    boxes are bounded by the largest file the intake accepts.
    """
    side = F.when(F.col("x0") < K.COLUMN_SPLIT_X, "left").otherwise("right")
    box = F.struct("pdf_page", (-F.col("y1")).alias("down"), "seq", "text")
    return (
        boxes.where(T.strip(F.col("text")) != "")
        .groupBy("doc_id", side.alias("side"))
        .agg(F.array_sort(F.collect_list(box)).alias("boxes"))
        .select("doc_id", "side", F.array_join(F.transform("boxes", lambda b: b["text"]), "\n").alias("text"))
    )


def sections_of_dataset(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sections``: the three dataset sections of each document."""
    bounded = docs.withColumn("_bounds", DT.section_bounds(F.col(text)))
    return bounded.withColumn("sections", DT.section_list(F.col(text), F.col("_bounds"))).drop("_bounds")


def slice_sections_dataset(docs: DataFrame, text: str = "text") -> DataFrame:
    found = sections_of_dataset(docs, text)
    return found.select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.section", "s.content")


#: Sections ``(doc_id, pos, content)`` to their labels ``(doc_id, pos, section)``; sections left out or null stay without one.
LabelSections = Callable[[DataFrame], DataFrame]


def sections_of_text(docs: DataFrame, text: str = "text", label_sections: LabelSections | None = None) -> DataFrame:
    """Add ``sections``: header and headed sections of each free-form document.

    ``label_sections`` names the sections whose heading says nothing, in place of the keywords; only those leave their document.
    """
    parts = docs.withColumn("_parts", F.split(FT.mark_sections(F.col(text)), T.OPEN))
    found = parts.withColumn("sections", FT.section_list(F.col("_parts"), label_sections is None)).drop("_parts")
    if label_sections is None:
        return found
    unknown = found.select("doc_id", F.posexplode_outer("sections").alias("pos", "s")).where("s is not null and s.section is null")
    labels = label_sections(unknown.select("doc_id", "pos", F.col("s.content").alias("content"))).where("section is not null")
    per_doc = labels.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "section"))).alias("_labels"))
    named = F.transform("sections", lambda s, i: F.struct(
        s["heading"].alias("heading"), F.coalesce(s["section"], F.try_element_at("_labels", i)).alias("section"), s["content"].alias("content"),
    ))
    return found.join(per_doc, "doc_id", "left").withColumn("sections", named).drop("_labels")


def slice_sections_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section name and document; the last section of a name wins, unnamed ones are left out."""
    found = sections_of_text(docs, text)
    rows = found.select("doc_id", F.posexplode("sections").alias("pos", "s")).where("s.section is not null")
    last = rows.groupBy("doc_id", F.col("s.section").alias("section")).agg(F.max_by("s", "pos").alias("s"), F.max("pos").alias("pos"))
    return last.select("doc_id", "pos", "section", "s.heading", "s.content")


def classify_section_fallback(
    sections: DataFrame, weights: DataFrame | None = None, threshold: float = K.FALLBACK_SECTION_THRESHOLD
) -> DataFrame:
    """Label of ``(doc_id, pos, content)`` rows whose heading names no section; null when no share of the score exceeds the threshold.

    Keywords decide in the row, or ``weights`` (section, term, weight), a linear scorer over the distinct lower-case words of a
    content. Then only words that the table holds leave their row, repeats folded; of equal scores the smaller section name wins. Negative
    weights lower a section's score, and shares are those of the positive scores.
    """
    if weights is None:
        return sections.withColumn("section", FT.keyword_label(F.col("content")))
    table = weights.where("term is not null and section is not null").groupBy("section", F.lower("term").alias("term")).agg(F.sum("weight").alias("weight"))
    words = F.array_distinct(F.split(F.lower(F.coalesce("content", F.lit(""))), r"(?U)[^\w]+"))
    scores = (
        sections.select("doc_id", "pos", F.explode_outer(words).alias("term")).where("term <> ''")
        .join(table, "term").groupBy("doc_id", "pos", "section").agg(F.sum("weight").alias("score")).where("score > 0")
    )
    ranked = scores.groupBy("doc_id", "pos").agg(
        F.min(F.struct((-F.col("score")).alias("down"), "section")).alias("best"), F.sum("score").alias("total"),
    )
    label = F.when(-F.col("best.down") > threshold * F.col("total"), F.col("best.section"))
    rest = [c for c in sections.columns if c != "section"]
    return sections.select(*rest).join(ranked.select("doc_id", "pos", label.alias("section")), ["doc_id", "pos"], "left").select(*rest, "section")


def by_weights(weights: DataFrame, threshold: float = K.FALLBACK_SECTION_THRESHOLD) -> LabelSections:
    """The weight table as a hook of ``sections_of_text``, ``parse_resume_text`` and ``onboard``."""
    return lambda sections: classify_section_fallback(sections, weights, threshold).select("doc_id", "pos", "section")
