"""Extraction jobs over free-form résumés: documents in, long tables out.

Everything about one document comes from its own row, so the jobs run without a shuffle; only the lookup of
mentions near a date is a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import free_text as FT
from talentweave.functions import text as T
from talentweave.operators.dates import located
from talentweave.operators.lines import LabelSections, sections_of_text

NEAR_MENTION = 250
#: Kinds of mentions by the section whose text they are spans of.
CONTACT_KINDS, DEGREE_KINDS, SCHOOL_KINDS = ["EMAIL", "PROFILE", "PERSON"], K.DEGREE_KINDS, ["UNIVERSITY", "COLLEGE", "SCHOOL_NAME"]
SECTION_KINDS = {"Header": CONTACT_KINDS, "Education": DEGREE_KINDS + SCHOOL_KINDS, "Skills": K.SKILL_KINDS}


def section_of(docs: DataFrame, text: str, name: str) -> DataFrame:
    return sections_of_text(docs, text).select("doc_id", FT.section_content(F.col("sections"), name).alias("section"))


def _segments(sections: DataFrame) -> DataFrame:
    """One row per date of ``section``: ``(doc_id, pos, match, before, after)``."""
    parts = sections.select("doc_id", FT.marked_parts(F.col("section")).alias("parts"))
    return parts.select("doc_id", F.explode(T.segments(F.col("parts"))).alias("s")).select("doc_id", "s.*")


def extract_experience_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, pos, title, company, period, description)`` of the experience section."""
    item = FT.job_item(F.col("before"), F.col("match"), F.col("after"))
    jobs = _segments(section_of(docs, text, "Experience")).select("doc_id", "pos", item.alias("j"))
    return jobs.where(FT.is_job(F.col("j"))).select("doc_id", "pos", "j.*")


def nearest_mentions(dates: DataFrame, mentions: DataFrame, kinds: dict[str, list[str]], open_: Column, reach: int = NEAR_MENTION) -> DataFrame:
    """``dates (doc_id, pos, start, ...)`` with a column for each entry of ``kinds``: the value of the mention of those kinds that starts
    closest, within ``reach``. Only rows that are ``open_`` are looked up; null where none is near.

    The range condition becomes an equi-join on slots of ``reach`` characters: a date looks into its own slot and the two beside it, so a
    document with many mentions is spread over its slots. Dates and mentions are each made once, for all kinds together.
    """
    every = sorted({kind for some in kinds.values() for kind in some})
    wanted = mentions.where(F.col("kind").isin(every)).select(
        "doc_id", F.col("start").alias("m_start"), F.col("kind").alias("m_kind"), F.col("value").alias("m_value"),
        F.floor(F.col("start") / reach).cast("int").alias("slot"),
    )
    own = F.floor(F.col("start") / reach).cast("int")
    rest = [c for c in dates.columns if c not in ("doc_id", "pos")]
    # Outer, and in place of a filter: what makes a date open isn't worked out once more below the explode.
    around = dates.withColumn("slot", F.explode_outer(F.when(open_, F.array(own - 1, own, own + 1))))
    near = around.join(wanted, ["doc_id", "slot"], "left")
    distance = F.abs(F.col("m_start") - F.col("start"))

    def closest(some: list[str]) -> Column:
        place = F.when(F.col("m_kind").isin(some) & (distance < reach), F.struct(distance, "m_start", "m_value"))
        return F.min(place)["m_value"]

    values = [closest(some).alias(name) for name, some in kinds.items()]
    return near.groupBy("doc_id", "pos").agg(F.first(F.struct(*rest)).alias("_rest"), *values).select("doc_id", "pos", "_rest.*", *kinds)


def link_title_company_text(docs: DataFrame, mentions: DataFrame, text: str = "text") -> DataFrame:
    """Title and company per date: from the lines above it, else the nearest mention.

    ``mentions`` are spans of the experience section.
    """
    marked = section_of(docs, text, "Experience").select("doc_id", FT.mark_dates(F.col("section")).alias("marked"))
    dates = located(marked, context=300)
    item = FT.job_item(F.col("before"), F.col("match"), F.col("after"))
    items = dates.select("doc_id", "pos", "start", item.alias("j")).select("doc_id", "pos", "start", "j.title", "j.company", "j.period")
    kinds = {"near_title": K.TITLE_KINDS, "near_company": ["COMPANY_NAME", "ORGANIZATION", *K.COMPANY_KINDS]}
    joined = nearest_mentions(items, mentions, kinds, (F.col("title") == "") | (F.col("company") == ""))

    def settle(own: str, near: str) -> Column:
        return F.coalesce(T.non_empty(F.col(own)), T.clean_field(F.col(near))).alias(own)

    return joined.select("doc_id", "pos", settle("title", "near_title"), settle("company", "near_company"), "period")


def with_mentions(docs: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """Add ``_said``: the mentions of a document by place, as spans of the section that has their kind (``SECTION_KINDS``)."""
    if mentions is None:
        return docs
    wanted = mentions.where(F.col("kind").isin(sum(SECTION_KINDS.values(), [])))
    said = F.array_sort(F.collect_list(F.struct("start", "value", "kind"))).alias("_said")
    return docs.join(wanted.groupBy("doc_id").agg(said), "doc_id", "left").withColumn(
        "_said", F.coalesce("_said", F.array().cast("array<struct<start: int, value: string, kind: string>>")))


def _said(kinds: list[str], among: Column | None = None) -> Column:
    return F.filter(F.col("_said") if among is None else among, lambda m: m["kind"].isin(kinds))


def _said_first(kinds: list[str], otherwise: Column) -> Column:
    return F.coalesce(F.get(_said(kinds), F.lit(0))["value"], otherwise)


def schools_of(parts: Column, mentions: bool) -> Column:
    """Education items of the dates of a section, in order; degree and place also from mentions around the date."""
    segments = T.segments(parts)
    if not mentions:
        return F.transform(segments, lambda s: FT.education_item(s["before"], s["match"]))
    # Where the date of each segment starts.
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(segments, start, lambda acc, s: F.struct(
        (acc["end"] + F.length(s["before"]) + F.length(s["match"])).alias("end"),
        F.array_append(acc["starts"], acc["end"] + F.length(s["before"])).alias("starts"),
    ))["starts"]

    def item(s: Column, at: Column) -> Column:
        near = F.filter("_said", lambda m: m["start"].between(at - F.least(F.length(s["before"]), F.lit(300)), at + 50))
        first = lambda kinds: F.get(_said(kinds, near), F.lit(0))["value"]
        return FT.education_item(s["before"], s["match"], first(DEGREE_KINDS), first(SCHOOL_KINDS))

    return F.zip_with(segments, starts, item)


def section_mentions(docs: DataFrame, find: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Mentions that ``find`` gives for each section's ``(doc_id, text)``, of the kinds that belong to the section."""
    found = sections_of_text(docs, text)
    contents = {name: FT.section_content(F.col("sections"), name) for name in SECTION_KINDS} | {"Skills": skills_text(F.col("sections"))}
    parts = [
        find(found.select("doc_id", contents[name].alias("text"))).where(F.col("kind").isin(kinds)).select("doc_id", "start", "kind", "value")
        for name, kinds in SECTION_KINDS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def known_skills() -> Column:
    return F.filter(F.transform(_said(K.SKILL_KINDS), lambda m: F.lower(T.clean_field(m["value"]))), lambda x: x != "")


def extract_education_text(docs: DataFrame, text: str = "text", mentions: DataFrame | None = None) -> DataFrame:
    """``(doc_id, pos, period, institution, degree, details)`` of the education section."""
    if mentions is None:
        item = FT.education_item(F.col("before"), F.col("match"))
        rows = _segments(section_of(docs, text, "Education")).select("doc_id", "pos", item.alias("e"))
    else:
        parts = section_of(docs, text, "Education").select("doc_id", FT.marked_parts(F.col("section")).alias("parts"))
        rows = with_mentions(parts, mentions).select("doc_id", F.posexplode(schools_of(F.col("parts"), True)).alias("pos", "e"))
    return rows.where(F.col("e.degree").isNotNull()).select("doc_id", "pos", "e.*")


def extract_certifications(docs: DataFrame, text: str = "text", section: str = "Certifications") -> DataFrame:
    """Certificates: around each date, or one per capitalised line when the section has no date."""
    parts = section_of(docs, text, section).withColumn("parts", FT.marked_parts(F.col("section")))
    found = F.when(F.size("parts") > 1, dated_certificates(F.col("parts"))).otherwise(FT.undated_certificates(F.col("section")))
    rows = parts.select("doc_id", F.posexplode(found).alias("pos", "c"))
    return rows.select("doc_id", "pos", "c.*")


def dated_certificates(parts: Column) -> Column:
    items = F.transform(T.segments(parts), lambda s: FT.certificate_item(s["before"], s["match"]))
    return F.filter(items, lambda c: c["degree"].isNotNull())


def tokenize_skills_text(docs: DataFrame, text: str = "text", mentions: DataFrame | None = None) -> DataFrame:
    """``(doc_id, pos, skill)`` from the skills and languages sections, mentioned skills first."""
    found = sections_of_text(docs, text).select("doc_id", skills_text(F.col("sections")).alias("section"))
    known = None if mentions is None else known_skills()
    return with_mentions(found, mentions).select("doc_id", F.posexplode(FT.skills(F.col("section"), known)).alias("pos", "skill"))


def skills_text(sections: Column) -> Column:
    languages = FT.section_content(sections, "Languages")
    listed = FT.section_content(sections, "Skills")
    return F.when(languages != "", F.concat_ws("\n", listed, languages)).otherwise(listed)


def extract_contacts(docs: DataFrame, text: str = "text", mentions: DataFrame | None = None) -> DataFrame:
    """First e-mail address and LinkedIn link of a text, empty when there is none; mentions go before both."""
    email, linkedin = FT.email_of(F.col(text)), FT.linkedin_of(F.col(text))
    if mentions is not None:
        email, linkedin = _said_first(["EMAIL"], email), _said_first(["PROFILE"], linkedin)
    return with_mentions(docs, mentions).select("doc_id", email.alias("email"), linkedin.alias("linkedin"))


def _header(docs: DataFrame, text: str) -> DataFrame:
    return section_of(docs, text, "Header").withColumnRenamed("section", "header")


def extract_header_location(docs: DataFrame, text: str = "text") -> DataFrame:
    return _header(docs, text).select("doc_id", FT.header_location(F.col("header")).alias("location"))


def extract_name(docs: DataFrame, text: str = "text", mentions: DataFrame | None = None) -> DataFrame:
    """Earliest person mention (the longer one on a tie), else what the header text gives."""
    named = _header(docs, text).select("doc_id", FT.name_of(F.col("header")).alias("name"))
    if mentions is None:
        return named
    people = mentions.where((F.col("kind") == "PERSON") & ~F.lower("value").isin(K.HEADER_EXCLUDED_NAME))
    first = people.groupBy("doc_id").agg(F.min_by("value", F.struct("start", -F.size(T.words_of(F.col("value"))))).alias("person"))
    by_mention = F.when(F.col("person").isNotNull(), T.clean_field(F.col("person"))).otherwise(F.col("name"))
    return named.join(first, "doc_id", "left").select("doc_id", by_mention.alias("name"))


def first_title_mention(mentions: DataFrame, excluded: list[str], reach: int = 300) -> DataFrame:
    """Per document the first title mention that starts before ``reach`` and is of sensible length."""
    value = F.trim(F.replace("value", F.lit("##"), F.lit("")))
    good = (F.length(value) > 3) & (F.length(value) < 80) & ~T.contains_any(F.lower(value), excluded)
    titles = mentions.where(F.col("kind").isin(K.TITLE_KINDS) & (F.col("start") < reach) & good)
    return titles.groupBy("doc_id").agg(F.min_by(value, F.struct("start", "value")).alias("mention_title"))


def professional_title_text(docs: DataFrame, text: str = "text", mentions: DataFrame | None = None) -> DataFrame:
    """Title mention, else a header line with a job word, else the default."""
    found = _header(docs, text).select("doc_id", FT.title_line(F.col("header")).alias("line"))
    if mentions is not None:
        found = found.join(first_title_mention(mentions, K.HEADER_EXCLUDED_TITLE), "doc_id", "left")
        title = F.coalesce("mention_title", "line", F.lit(K.DEFAULT_TITLE))
    else:
        title = F.coalesce("line", F.lit(K.DEFAULT_TITLE))
    return found.select("doc_id", T.clean_field(title).alias("title"))


def parse_resume_text(
    docs: DataFrame, text: str = "text", mentions: DataFrame | None = None, label_sections: LabelSections | None = None
) -> DataFrame:
    """Free-form documents in the common résumé schema; empty texts give the default record.

    One projection over the row of a document: nothing is shuffled, whatever the skew of the input. With ``mentions``, and with
    ``label_sections`` for headings that name no section, one join by document comes before.
    """
    empty = F.coalesce(T.strip(F.col(text)), F.lit("")).isin("", "nan")
    sections = sections_of_text(docs, text, label_sections)
    rest = [c for c in docs.columns if c != text]
    sections, said = with_mentions(sections, mentions), [] if mentions is None else ["_said"]
    parts = sections.select(
        *rest, *said, "sections", empty.alias("_empty"),
        FT.section_content(F.col("sections"), "Header").alias("_header"),
        FT.marked_parts(FT.section_content(F.col("sections"), "Experience")).alias("_jobs"),
        FT.marked_parts(FT.section_content(F.col("sections"), "Education")).alias("_schools"),
        FT.section_content(F.col("sections"), "Certifications").alias("_certs"),
        FT.marked_parts(FT.section_content(F.col("sections"), "Certifications")).alias("_cert_parts"),
        skills_text(F.col("sections")).alias("_skills"),
    )
    jobs = F.filter(F.transform(T.segments(F.col("_jobs")), lambda s: FT.job_item(s["before"], s["match"], s["after"])), FT.is_job)
    schools = F.filter(schools_of(F.col("_schools"), bool(said)), lambda e: e["degree"].isNotNull())
    certs = F.when(F.size("_cert_parts") > 1, dated_certificates(F.col("_cert_parts"))).otherwise(FT.undated_certificates(F.col("_certs")))
    items = parts.select(
        *rest, *said, "_empty", "_header", jobs.alias("_jobs"), F.concat(schools, certs).alias("education"),
        FT.skills(F.col("_skills"), known_skills() if said else None).alias("skills"), FT.title_line(F.col("_header")).alias("_line"),
    )
    first_title = F.get("_jobs", F.lit(0))["title"]
    title = T.clean_field(F.coalesce(F.col("_line"), T.non_empty(first_title), F.lit(K.DEFAULT_TITLE)))
    titled = items.withColumn("title", title)
    experience = F.transform(
        "_jobs",
        lambda j, i: F.struct(
            F.when((i == 0) & j["title"].isin("", K.DEFAULT_JOB_TITLE), capitalized(F.col("title"))).otherwise(j["title"]).alias("title"),
            j["company"].alias("company"), j["period"].alias("period"), F.lit("").alias("location"),
            j["description"].alias("description"),
        ),
    )
    unknown = lambda c: F.when(F.col("_empty"), F.lit("Unknown")).otherwise(c)
    name, email, linkedin = (f(F.col("_header")) for f in (FT.name_of, FT.email_of, FT.linkedin_of))
    if said:
        people = F.filter(_said(["PERSON"]), lambda m: ~F.lower(m["value"]).isin(K.HEADER_EXCLUDED_NAME))
        first = F.array_min(F.transform(people, lambda m: F.struct(m["start"], -F.size(T.words_of(m["value"])), m["value"].alias("value"))))
        name = F.coalesce(T.clean_field(first["value"]), name)
        email, linkedin = _said_first(["EMAIL"], email), _said_first(["PROFILE"], linkedin)
    return titled.select(
        *rest,
        unknown(name).alias("name"),
        unknown(email).alias("email"),
        unknown(linkedin).alias("linkedin"),
        unknown(F.col("title")).alias("title"),
        F.when(F.col("_empty"), F.lit("")).otherwise(
            F.coalesce(T.non_empty(FT.header_location(F.col("_header"))), F.lit("Any"))).alias("location"),
        "skills", experience.alias("experience"), "education",
        FT.span_of_jobs(F.col("_jobs")).alias("total_experience"),
    )


def capitalized(c: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))
