"""Free-form résumés: every function maps columns of one row to columns of the same row.

``sections`` and the item functions work on values of a single document, so a whole parse needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import text as T
from talentweave.functions.dates import TEXT_DATE, mark_dates, year_span, years_with_open_end

DEGREE_PATTERN = rf"(?iU)\b{T.any_of(K.DEGREE_WORDS + K.CERTIFICATE_WORDS)}\b"
_HEADING = r"(?iU)\n\s*[-=*]*\s*(" + "|".join(K.TEXT_HEADINGS) + r")\s*[-=*]*\s*\n"
FALLBACK_KEYWORDS = {
    "Experience": ["company", "managed", "team", "project", "responsible", "worked", "developed", "led"],
    "Education": ["university", "bachelor", "master", "degree", "school", "thesis", "college", "phd"],
    "Skills": ["python", "java", "sql", "software", "tools", "programming", "excel", "skills"],
    "Contact": ["email", "phone", "address", "linkedin", "@", "http"],
    "Certifications": ["certified", "certificate", "certification", "license", "credential"],
    "Languages": ["english", "italian", "french", "german", "spanish", "fluent", "native"],
}


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _last_reversed(values: Column, n: int) -> Column:
    return F.slice(F.reverse(values), 1, n)


def _between(c: Column, low: int, high: int) -> Column:
    """Value when its length is above ``low`` and below ``high``, else null."""
    return T.let(c, lambda x: F.when((F.length(x) > low) & (F.length(x) < high), x))


def mark_sections(c: Column) -> Column:
    """Drop document titles, bracket each section heading."""
    plain = c
    for words in K.BOILERPLATE_TITLES:
        plain = F.regexp_replace(plain, rf"(?iU)\b{words}\b", "")
    return T.mark(plain, _HEADING, "$1")


def keyword_label(content: Column) -> Column:
    """Section name with the largest share of keyword hits when that share exceeds the threshold."""
    def count(low: Column) -> Column:
        return F.array(*[
            F.struct(
                sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"),
                F.lit(-i).alias("order"), F.lit(name).alias("name"),
            )
            for i, (name, words) in enumerate(FALLBACK_KEYWORDS.items())
        ])

    def decide(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["n"])
        return T.let(F.array_max(hits), lambda top: F.when(top["n"] > F.lit(K.FALLBACK_SECTION_THRESHOLD) * total, top["name"]))

    return T.let(T.let(F.lower(content), count), decide)


def section_list(parts: Column, by_keywords: bool = True) -> Column:
    """``(heading, section, content)`` per non-empty section, from ``split(marked, OPEN)`` in its own column.

    Without ``by_keywords`` a heading that names no section leaves its section null.
    """
    names = F.create_map(*[F.lit(x) for pair in K.SECTION_OF_HEADING.items() for x in pair])

    def one(x: Column, i: Column) -> Column:
        heading = F.when(i > 0, F.upper(T.strip(F.substring_index(x, T.CLOSE, 1))))
        split = F.struct(heading.alias("heading"), T.strip(F.substring_index(x, T.CLOSE, -1)).alias("content"))
        return T.let(split, lambda s: F.struct(
            s["heading"].alias("heading"),
            F.when(i == 0, F.lit("Header")).otherwise(
                F.coalesce(
                    F.try_element_at(names, F.coalesce(s["heading"], F.lit(""))),
                    keyword_label(s["content"]) if by_keywords else F.lit(None),
                )
            ).alias("section"),
            s["content"].alias("content"),
        ))

    return F.filter(F.transform(parts, one), lambda s: (s["section"] == "Header") | (s["content"] != ""))


def section_content(sections: Column, name: str) -> Column:
    """Content of the last section with this name, or empty."""
    found = F.filter(sections, lambda s: s["section"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["content"], F.lit(""))


def job_item(before: Column, period: Column, after: Column) -> Column:
    """Title, company and description around one date of the experience section."""
    pipe, bullet = "(?U)" + K.TITLE_BAR_COMPANY, "(?U)" + K.LEADING_BULLET

    def piped(window: Column, group: int) -> Column:
        return _between(T.strip(F.regexp_replace(T.strip(F.regexp_extract(window, pipe, group)), bullet, "")), 2, 100)

    def listed(rows: Column, part: int, shortest: int, unlike: str) -> Column:
        """First comma part of the last lines that has a sensible length and form."""
        values = F.transform(rows, lambda p: F.get(p, F.lit(part)))
        good = lambda v: (F.length(v) > shortest) & (F.length(v) < 100) & ~F.rlike(v, F.lit(unlike))
        return _first(F.filter(values, good))

    def build(window: Column) -> Column:
        split = F.transform(_last_reversed(T.lines_of(window), 3), lambda x: F.transform(F.split(x, ","), T.strip))
        return T.let(F.filter(split, lambda p: F.size(p) >= 2), lambda rows: F.struct(
            T.clean_field(F.coalesce(piped(window, 1), listed(rows, 0, 3, K.NOT_A_TITLE))).alias("title"),
            T.clean_field(F.coalesce(piped(window, 2), listed(rows, 1, 2, "(?U)" + K.NOT_A_COMPANY))).alias("company"),
            period.alias("period"),
            first_sentence(after).alias("description"),
        ))

    return T.let(T.strip(F.right(before, F.lit(300))), build)


def first_sentence(after: Column) -> Column:
    """Text after a date up to and including the first full stop."""
    return T.let(T.strip(after), lambda text: F.when(
        F.contains(text, F.lit(".")), T.strip(F.concat(F.substring_index(text, ".", 1), F.lit(".")))).otherwise(text))


def is_job(item: Column) -> Column:
    """A date followed by talk of education is no job."""
    return ~F.contains(F.left(F.lower(item["description"]), F.lit(100)), F.lit("education"))


def education_item(before: Column, period: Column, said_degree: Column | None = None, said_school: Column | None = None) -> Column:
    """Degree and institution from the last four lines before a date, else what mentions say; ``degree`` is null when none is found."""
    def settled(own: Column, said: Column | None) -> Column:
        return own if said is None else F.coalesce(T.non_empty(own), said, own)

    def line_facts(x: Column, i: Column) -> Column:
        low = F.lower(x)
        return F.struct(
            i.alias("i"), x.alias("line"), F.rlike(x, F.lit(DEGREE_PATTERN)).alias("is_degree"),
            T.contains_any(low, K.INSTITUTION_WORDS).alias("is_school"), low.isin(K.COMPLETION_WORDS).alias("is_status"),
            F.contains(low, F.lit(" at ")).alias("has_at"), F.contains(x, F.lit("|")).alias("has_bar"),
        )

    def halves(row: Column) -> Column:
        """Degree and institution written on one line."""
        bars, at = F.split(row["line"], r"\|"), F.split(row["line"], r"(?iU)\sat\s")
        return (
            F.when(row["is_school"] & row["has_bar"], F.array(T.strip(F.get(bars, F.lit(0))), T.strip(F.get(bars, F.lit(1)))))
            .when(row["is_school"] & row["has_at"], F.array(T.strip(F.get(at, F.lit(0))), T.strip(F.try_element_at(at, F.lit(-1)))))
            .otherwise(F.array(row["line"], F.lit(None)))
        )

    def choose(lines: Column, near: Column) -> Column:
        fallback = _first(F.filter(_last_reversed(lines, 3), lambda x: ~F.lower(x).isin(K.COMPLETION_WORDS[:2])))
        own = lambda row: F.filter(near, lambda x: x["is_school"] & (x["i"] != F.coalesce(row["i"], F.lit(-1))))
        return T.let(_first(F.filter(near, lambda x: x["is_degree"])), lambda row: T.let(
            halves(row),
            lambda pair: settle_education(
                period, settled(F.get(pair, F.lit(0)), said_degree),
                settled(F.coalesce(F.get(pair, F.lit(1)), _first(own(row))["line"]), said_school), fallback
            ),
        ))

    def build(lines: Column) -> Column:
        facts = F.filter(F.transform(_last_reversed(lines, 4), line_facts), lambda x: ~x["is_status"])
        return T.let(facts, lambda near: choose(lines, near))

    return T.let(T.lines_of(T.strip(F.right(before, F.lit(300)))), build)


def settle_education(period: Column, degree: Column, institution: Column, fallback: Column) -> Column:
    """Resolve the case where one of degree and institution contains the other."""
    def settle(p: Column) -> Column:
        inst_inside = F.contains(F.lower(p["degree"]), F.lower(p["school"]))
        degree_inside = F.contains(F.lower(p["school"]), F.lower(p["degree"]))
        final = F.when(inst_inside, F.struct(p["degree"].alias("degree"), F.lit("").alias("school"))).when(
            degree_inside, F.struct(p["school"].alias("degree"), F.lit("").alias("school"))
        ).otherwise(p)
        return T.let(final, lambda f: F.struct(
            period.alias("period"), T.clean_field(f["school"]).alias("institution"),
            T.let(F.coalesce(T.non_empty(f["degree"]), fallback), lambda d: F.when(d.isNotNull(), T.clean_field(d))).alias("degree"),
            F.lit("").alias("details"),
        ))

    return T.let(F.struct(degree.alias("degree"), institution.alias("school")), settle)


def _starts_sentence(c: Column) -> Column:
    return _first(T.words_of(c)).isin(K.SENTENCE_STARTS)


def undated_certificates(section: Column) -> Column:
    """Capitalised lines of a certificate section without dates."""
    word = lambda x: F.rtrim(_first(T.words_of(x)), F.lit(".,;"))
    named = F.filter(
        T.lines_of(section),
        lambda x: F.rlike(x, F.lit(r"^\p{Lu}")) & ~word(x).isin(K.SENTENCE_STARTS) & (F.length(x) > 5),
    )
    return F.transform(
        named,
        lambda x: F.struct(
            F.lit("Unknown").alias("period"), F.lit("").alias("institution"), T.clean_field(x).alias("degree"),
            F.lit("").alias("details"),
        ),
    )


def certificate_item(before: Column, period: Column) -> Column:
    """Certificate named on the last line before a date; ``degree`` is null when none is found."""
    phrase_rx, tail_rx = "(?iU)" + K.CERTIFICATE_PHRASE, "(?iU)" + K.CERTIFICATE_TAIL

    def by_prefix(prefix: Column) -> Column:
        return T.let(F.regexp_replace(prefix, tail_rx, ""), lambda short: F.when(
            (prefix != "") & ~_starts_sentence(prefix) & (F.length(short) > 4), short))

    def by_run(target: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(target, F.lit("(?U)" + K.CERTIFICATE_RUN), F.lit(1)), T.strip)
        good = F.filter(runs, lambda x: ~_starts_sentence(x) & (F.length(x) > 4))
        return F.array_min(F.transform(good, lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("i"), x.alias("text"))))["text"]

    def name_in(target: Column) -> Column:
        phrase = _between(T.strip(F.regexp_extract(target, phrase_rx, 1)), 3, 80)
        prefix = T.strip(F.regexp_extract(target, "(?U)" + K.CERTIFICATE_PREFIX, 1))
        return F.coalesce(phrase, T.let(prefix, by_prefix), by_run(target))

    last_line = F.try_element_at(T.lines_of(T.strip(F.right(before, F.lit(200)))), F.lit(-1))
    return T.let(T.let(last_line, name_in), lambda name: F.struct(
        period.alias("period"), F.lit("").alias("institution"),
        F.when(name.isNotNull(), T.clean_field(name)).alias("degree"), F.lit("").alias("details"),
    ))


def skill_phrases(section: Column) -> Column:
    """"Fluent in French" and the like, lower case."""
    pattern = "(?iU)" + K.FLUENCY_PATTERN
    levels = F.regexp_extract_all(section, F.lit(pattern), F.lit(1))
    languages = F.regexp_extract_all(section, F.lit(pattern), F.lit(2))
    joined = F.zip_with(levels, languages, lambda a, b: F.concat(F.lower(a), F.lit(" in "), F.lower(b)))
    return F.array_distinct(joined)


def skill_parts(section: Column) -> Column:
    """Candidate skills: noise phrases removed, separators unified, cleaned, filtered, lower case."""
    noise = r"(?iU)(?:" + "|".join(K.SKILL_NOISE) + r")\s*"
    plain = F.regexp_replace(section, noise, "")
    for dotted, joined in K.DOTTED_SKILLS.items():
        plain = F.replace(plain, F.lit(dotted), F.lit(joined))
    plain = F.regexp_replace(F.replace(plain, F.lit(" and "), F.lit(",")), "(?U)" + K.SKILL_BULLET, ",")
    parts = F.transform(F.split(plain, "(?U)" + K.SKILL_SPLIT), T.clean_field)

    def keep(p: Column) -> Column:
        def test(low: Column) -> Column:
            shouted = F.rlike(p, F.lit(r"\p{Lu}")) & ~F.rlike(p, F.lit(r"\p{Ll}"))
            short_ok = (F.length(p) >= 3) | low.isin(K.SHORT_SKILLS) | shouted
            sentence = T.contains_any(F.concat(F.lit(" "), low, F.lit(" ")), K.SENTENCE_WORDS)
            return (p != "") & short_ok & (F.size(T.words_of(p)) <= 8) & ~sentence

        return T.let(F.lower(p), test)

    return F.filter(parts, keep)


def skills(section: Column, known: Column | None = None) -> Column:
    """Distinct lower-case skills: recognised ones, fluency phrases, then the listed parts.

    A part that contains an earlier entry with "in" in it is passed over, as that entry already covers it.
    """
    first = skill_phrases(section) if known is None else F.array_distinct(F.concat(known, skill_phrases(section)))

    def add(acc: Column, p: Column) -> Column:
        covered = F.exists(acc, lambda a: F.contains(a, F.lit("in")) & F.contains(F.lower(p), a))
        final = F.lower(F.regexp_replace(p, "(?iU)" + K.SKILL_LEAD, ""))
        return T.let(final, lambda f: F.when(
            covered | (f == "") | F.array_contains(acc, f), acc).otherwise(F.array_append(acc, f)))

    return F.aggregate(skill_parts(section), first, add)


def email_of(c: Column) -> Column:
    return F.regexp_extract(c, "(?U)" + K.EMAIL_PATTERN, 0)


def linkedin_of(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)" + K.LINKEDIN_PATTERN, 0)


def header_location(header: Column) -> Column:
    """First "City, Region" line of the header."""
    def good(x: Column) -> Column:
        shape = ~F.rlike(x, F.lit(r"(?U)\d")) & F.rlike(x, F.lit("(?U)" + K.PLACE_LINE_PATTERN))
        return shape & T.let(F.lower(x), lambda low: ~T.contains_any(low, K.NOT_A_PLACE + K.NOT_A_PLACE_ORGANISATION))

    return T.clean_field(_first(F.filter(T.lines_of(header), good)))


def name_of(header: Column) -> Column:
    """The "Name:" label, else a capitalised line among the first five."""
    labelled = T.strip(F.regexp_extract(header, "(?iU)" + K.NAME_LABEL_PATTERN, 1))
    has_label = F.rlike(header, F.lit("(?iU)" + K.NAME_LABEL_PATTERN))

    def good(x: Column) -> Column:
        return (
            (F.length(x) < 50) & ~T.contains_any(F.lower(x), K.HEADER_EXCLUDED_NAME) & ~F.endswith(x, F.lit(":"))
            & ~F.contains(x, F.lit("@")) & ~F.rlike(x, F.lit(r"(?U)\d")) & F.rlike(x, F.lit("(?U)" + K.NAME_LINE_PATTERN))
        )

    line = _first(F.filter(F.slice(T.lines_of(header), 1, 5), good))
    return T.clean_field(F.when(has_label, labelled).otherwise(line))


def title_line(header: Column) -> Column:
    """Line with a job word among the first eight, else null."""
    lines = F.transform(F.slice(F.split(F.left(header, F.lit(600)), "\n"), 1, 8), T.strip)

    def good(x: Column) -> Column:
        low = F.lower(x)
        return (
            (F.length(x) > 10) & (F.length(x) < 80) & ~T.contains_any(low, K.HEADER_EXCLUDED_TITLE)
            & T.contains_any(low, K.TITLE_INDICATORS)
        )

    return _first(F.filter(lines, good))


def span_of_jobs(jobs: Column, as_of_year: int = K.AS_OF_YEAR) -> Column:
    """Largest minus smallest year over all periods; no years means 0."""
    years = F.flatten(F.transform(jobs, lambda j: years_with_open_end(j["period"], as_of_year)))
    return F.coalesce(F.greatest(year_span(years), F.lit(0)), F.lit(0))


def marked_parts(section: Column) -> Column:
    return F.split(mark_dates(section, TEXT_DATE), T.OPEN)
