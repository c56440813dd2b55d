"""Golden rows for the text extraction jobs."""

from pyspark.sql import functions as F

from talentweave.functions import dataset_text as DT
from talentweave.functions import text as T
from talentweave.functions.dates import DATASET_DATE
from talentweave.operators import dataset_text as XD
from talentweave.operators import dates as D
from talentweave.operators import free_text as XT
from talentweave.operators import identity as I
from talentweave.operators import lines as L
from talentweave.operators import mentions as N
from talentweave.operators import profile as P
from talentweave.plans import onboarding

CV = """Curriculum Vitae
Anna Verdi
Turin, Italy
anna.verdi@mail.example | https://www.linkedin.com/in/anna-verdi_7/

--- Professional Summary ---
Likes hard problems.

=== WORK EXPERIENCE ===
* Lead Engineer | Nord Systems
March 2018 - Present
Built the new platform. Ran it too.
Data Analyst, Blue Bank Ltd
01/2014 to 12/2017
Wrote reports.

ACADEMIC BACKGROUND
Master of Science at University of Turin
2012 - 2014
Diploma Galileo | High School Galileo
2009

CERTIFICATIONS
Earned the Cloud Architect certification in 2019
Scrum Master 2020

TECHNICAL SKILLS
Python, C, Node.js and SQL; I am a good listener, Qx
fluent in German

LANGUAGES
Italian, .NET
"""


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def test_sections_and_headers(texts):
    docs = texts(CV)
    found = {r["section"]: r["content"] for r in rows(L.slice_sections_text(docs), "pos")}
    assert list(found)[:3] == ["Header", "Summary", "Experience"]
    assert found["Summary"] == "Likes hard problems."
    assert XT.extract_header_location(docs).first().location == "Turin, Italy"
    assert XT.extract_name(docs).first().name == "Anna Verdi"
    contact = XT.extract_contacts(docs).first()
    assert contact.email == "anna.verdi@mail.example"
    assert contact.linkedin == "https://www.linkedin.com/in/anna-verdi_7/"


def test_unknown_heading_goes_to_the_keyword_label(texts):
    docs = texts("Name\nWORK  EXPERIENCE\nThe university gave a bachelor and a master degree\n")
    assert [r["section"] for r in rows(L.slice_sections_text(docs), "pos")] == ["Header", "Education"]


def test_experience_of_free_text(texts):
    jobs = rows(XT.extract_experience_text(texts(CV)), "pos")
    assert [(j["title"], j["company"], j["period"]) for j in jobs] == [
        ("Lead Engineer", "Nord Systems", "March 2018 - Present"),
        ("Data Analyst", "Blue Bank Ltd", "01/2014 to 12/2017"),
    ]
    assert jobs[0]["description"] == "Built the new platform."


def test_education_of_free_text(texts):
    found = rows(XT.extract_education_text(texts(CV)), "pos")
    assert [(e["degree"], e["institution"], e["period"]) for e in found] == [
        ("Master of Science", "University of Turin", "2012 - 2014"),
        ("Diploma Galileo", "High School Galileo", "2009"),
    ]


def test_education_containment_and_fallback(texts):
    docs = texts("x\nEDUCATION\nSchool diploma\nSome School diploma of arts\n2001\nLearned a lot\n2005\n")
    found = rows(XT.extract_education_text(docs), "pos")
    # The degree line holds the institution, which is then left blank.
    assert [(e["degree"], e["institution"]) for e in found] == [("Some School diploma of arts", ""), ("Learned a lot", "")]


def test_certificates(texts):
    dated = rows(XT.extract_certifications(texts(CV)), "pos")
    assert [(c["degree"], c["period"]) for c in dated] == [("Cloud Architect", "2019"), ("Scrum Master", "2020")]
    undated = rows(XT.extract_certifications(texts("x\nCERTIFICATION\nFirst Aid Badge\nI also swim\nshort\nAbc\n")), "pos")
    assert [(c["degree"], c["period"]) for c in undated] == [("First Aid Badge", "Unknown")]


def test_skills_of_free_text(texts):
    found = [r["skill"] for r in rows(XT.tokenize_skills_text(texts(CV)), "pos")]
    assert found == ["fluent in german", "python", "c", "nodejs", "sql", "dotnet"]


def test_free_text_takes_what_only_mentions_give(spark, texts):
    docs = texts("Ann Lee\nEDUCATION\nGraduated\n1999\nStudies of ships\nBocconi, Milan\n2004\nSKILLS\nbaking\n", "Bob\nSKILLS\nplating\n")
    section = XT.section_of(docs, "text", "Education").where("doc_id = 0").first().section
    rows = [
        (0, 0, "EMAIL", "ann at lee"), (0, 3, "PROFILE", "in/ann"), (0, 0, "TOOL", "Sharp Knives"),
        (0, section.index("Studies"), "DEGREE", "Studies of ships"), (0, section.index("Bocconi"), "UNIVERSITY", "Bocconi"),
    ]
    mentions = spark.createDataFrame(rows, "doc_id bigint, start int, kind string, value string")
    skills = [(r.doc_id, r.skill) for r in XT.tokenize_skills_text(docs, mentions=mentions).orderBy("doc_id", "pos").collect()]
    assert skills == [(0, "sharp knives"), (0, "baking"), (1, "plating")]
    contacts = {r.doc_id: (r.email, r.linkedin) for r in XT.extract_contacts(docs, mentions=mentions).collect()}
    assert contacts == {0: ("ann at lee", "in/ann"), 1: ("", "")}
    schools = [(r.period, r.degree, r.institution) for r in XT.extract_education_text(docs, mentions=mentions).collect()]
    assert schools[-1] == ("2004", "Studies of ships", "Bocconi")
    whole = {r.doc_id: r for r in XT.parse_resume_text(docs, mentions=mentions).collect()}
    assert (whole[0].email, whole[0].linkedin, whole[0].skills) == ("ann at lee", "in/ann", ["sharp knives", "baking"])
    assert whole[0].education[-1].institution == "Bocconi" and whole[1].skills == ["plating"]


def test_onboarding_asks_for_mentions_of_each_section(spark):
    text = "Ann Lee\nEDUCATION\nStudies of ships\nBocconi, Milan\n2004\nSKILLS\nbaking\n"
    envelopes = spark.createDataFrame([("A1", text, "new_texts", "txt", "cv")], "id string, raw_data string, source string, type string, category string")
    at = lambda word, kind: F.struct(F.locate(word, F.col("text")).alias("at"), F.lit(kind).alias("kind"), F.lit(word).alias("value"))

    def find(docs):
        found = docs.select("doc_id", F.explode(F.array(at("Ann Lee", "PERSON"), at("Bocconi", "UNIVERSITY"), at("baking", "TOOL"))).alias("m"))
        return found.where("m.at > 0").select("doc_id", (F.col("m.at") - 1).alias("start"), "m.kind", "m.value")

    plain, row = onboarding.parse(envelopes).first(), onboarding.parse(envelopes, find).first()
    assert plain.education[0].institution == "" and row.education[0].institution == "Bocconi"
    assert (row.name, row.skills) == ("Ann Lee", ["baking"])


def test_parse_free_text(texts):
    docs = texts(CV, "", "   ")
    whole = rows(XT.parse_resume_text(docs), "doc_id")
    assert whole[0]["title"] == "Lead Engineer" and whole[0]["total_experience"] == 12
    assert [e["degree"] for e in whole[0]["education"]] == ["Master of Science", "Diploma Galileo", "Cloud Architect", "Scrum Master"]
    assert whole[1]["name"] == "Unknown" and whole[1]["experience"] == [] and whole[1]["total_experience"] == 0
    assert whole[2]["title"] == "Unknown" and whole[2]["location"] == ""


def test_date_positions(texts):
    text = "è Jan 2001 – Feb 2003, 2004-05-06 to now; 03/2007 and 12345"
    found = rows(D.extract_date_ranges(texts(text)), "pos")
    assert [f["period"] for f in found] == ["Jan 2001 – Feb 2003", "2004-05-06 to now", "03/2007"]
    assert all(text[f["start"]:f["end"]] == f["period"] for f in found)


def test_narrative_dates_are_left_out(texts):
    text = "Acme  1999 - 2001 to be sure. In 2003  Then\nsince 2004  Up 1955  Old 2006 Led a team 2007 was 2008  End"
    assert [r["period"] for r in rows(D.filter_date_mentions(texts(text)), "pos")] == ["1999 - 2001", "2004", "2008"]


DATASET = (
    "HEAD CHEF       Summary    Cooks.    Experience    Big Grill  Head Chef  2010 - Current   "
    "Company Name － Rome , Italy  Ran the kitchen.  Small Bar | Line Cook  2005 - 2009   Cut onions.    "
    "Education and Training    Rome College  Diploma  2004  Master 2008 Diploma 2009    Skills    Knife work, Soups  "
    "This one is much too long to be kept"
)


def test_dataset_sections_and_skills(texts):
    docs = texts(DATASET)
    assert [r["section"] for r in rows(L.slice_sections_dataset(docs), "pos")] == ["Experience", "Education", "Skills"]
    assert [r["skill"] for r in rows(XD.tokenize_skills(docs), "pos")] == ["knife work", "soups"]


def test_dataset_title_forms(texts):
    docs = texts("CHIEF OF O'NEIL\nmore", DATASET, "nothing to see here at all and so on " * 5)
    found = [r["title"] for r in rows(XD.professional_title_dataset(docs), "doc_id")]
    assert found == ["Chief Of O'Neil", "HEAD CHEF", "Professional"]


def test_dataset_jobs_do_not_depend_on_the_way_they_are_computed(spark, texts):
    docs = texts(DATASET, "no headings", DATASET.replace("  2005", "\n2005"))
    none = spark.createDataFrame([], "doc_id bigint, start int, end int, kind string, value string")
    by_row = rows(XD.extract_experience_dataset(docs), "doc_id", "pos")
    by_join = rows(XD.extract_experience_dataset(docs, mentions=none), "doc_id", "pos")
    assert by_row == by_join
    assert [(j["title"], j["company"], j["period"]) for j in by_row[:1]] == [("Head Chef", "Big Grill", "2010 - Current")]
    assert rows(XD.parse_resume_dataset(docs), "doc_id") == rows(XD.parse_resume_dataset(docs, mentions=none), "doc_id")


def test_dataset_education_keeps_the_first_of_equal_entries(texts):
    found = rows(XD.extract_education_dataset(texts(DATASET)), "pos")
    assert [(e["degree"], e["period"]) for e in found] == [("Diploma", "2004"), ("Master", "2008")]


def test_company_behind_the_date_gives_the_title_between(spark, texts):
    docs = texts("x    Experience    2001 - 2002  , Night Guard -  Iron Works  and so on    Skills    a, b")
    at = docs.first().text.index("Iron Works")
    mentions = spark.createDataFrame([(0, at, at + 10, "ORG", "Iron Works")], "doc_id bigint, start int, end int, kind string, value string")
    linked = XD.link_title_company(XD.job_dates(docs), mentions).first()
    assert linked.company.value == "Iron Works"
    assert linked.title.value in ("Night Guard", "Night Guard -")


def test_place_and_description(spark):
    raw = [("worked in Rome , Italy. fine",), ("at Boston, MA today",), ("nothing",)]
    df = spark.createDataFrame(raw, "raw string")
    none = F.array().cast("array<string>")
    places = [r.p.raw for r in df.select(DT.job_location(F.col("raw"), none).alias("p")).collect()]
    assert places == ["Rome, Italy", "Boston, MA", "Unknown"]
    one = df.limit(1).select(DT.job_location(F.col("raw"), F.array(F.lit("Pisa"))).alias("p")).first().p
    assert (one.city, one.raw) == ("Unknown", "Pisa")
    place = F.struct(F.lit("Rome").alias("city"), F.lit("Italy").alias("state"), F.lit("Rome, Italy").alias("raw"))
    text = F.lit("- Cook Company Name － Rome , Italy " + "word  " * 80)
    cleaned = df.limit(1).select(DT.clean_description(text, F.lit("Cook"), place).alias("d")).first().d
    assert cleaned.startswith("word word") and cleaned.endswith("...") and len(cleaned) == 253


def test_profile_jobs(spark):
    lines = [
        "Nord Systems", "2 years 3 months", "Lead Engineer", "January 2020 - Present (1 year)", "Milan, Italy", "Built things",
        "Junior Engineer", "May 2018 - December 2019 (1 year 8 months)", "Fixed things", "Blue Bank", "Teller",
        "June 2010 - May 2018 (8 years)",
    ]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, pos int, line string")
    found = rows(P.profile_experience(df), "pos")
    assert [(j["title"], j["company"]) for j in found][0] == ("Lead Engineer", "Nord Systems")
    assert found[0]["location"] == "Milan, Italy"
    # The line before the title is taken as company when it is no place.
    assert (found[1]["title"], found[1]["company"]) == ("Junior Engineer", "Built things")
    assert (found[2]["title"], found[2]["company"]) == ("Teller", "Blue Bank")


def test_profile_job_inherits_the_company(spark):
    lines = [
        "Nord Systems", "Lead Engineer", "January 2020 - Present (1 year)", "Milan, Italy",
        "Junior Engineer", "May 2018 - December 2019 (1 year 8 months)",
    ]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, pos int, line string")
    found = rows(P.profile_experience(df), "pos")
    assert [(j["title"], j["company"], j["location"]) for j in found] == [
        ("Lead Engineer", "Nord Systems", "Milan, Italy"), ("Junior Engineer", "Nord Systems", ""),
    ]


def test_profile_schools(spark):
    lines = [
        "Turin University", "Master of Science, Physics · (2010 -", "2012)", "Oslo College", "(2005 - 2008)", "Bachelor degree",
        "Some Institute",
    ]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, pos int, line string")
    found = rows(P.profile_education(df), "pos")
    assert [(e["institution"], e["degree"], e["period"]) for e in found] == [
        ("Turin University", "Master of Science, Physics", "2010 - 2012"), ("Oslo College", "Bachelor degree", "2005 - 2008"),
        ("Some Institute", "", ""),
    ]


def test_profile_without_text_is_an_error(spark):
    boxes = spark.createDataFrame([("d", 0, 10.0, 5.0, 0, "  \n ")], "doc_id string, pdf_page int, x0 double, y1 double, seq int, text string")
    found = P.parse_resume_profile(boxes).first()
    assert found.error == "Could not parse PDF layout" and found.experience == []


def test_line_predicates(spark):
    df = spark.createDataFrame([("University of Trento",), ("Oslo, Norway",), ("2 yrs 3 mos",), ("10 months",)], "line string")
    got = df.select(T.is_location_line(F.col("line")).alias("p"), T.is_duration_line(F.col("line")).alias("d")).collect()
    assert [(r.p, r.d) for r in got] == [(False, False), (True, False), (False, True), (False, True)]


def test_mentions_merge_and_offsets(spark, texts):
    pieces = [(0, 0, 4, "A", "data"), (0, 5, 9, "A", "base"), (0, 9, 11, "A", "##es"), (0, 20, 25, "A", "other"), (0, 26, 30, "B", "kind")]
    df = spark.createDataFrame(pieces, "doc_id int, start int, end int, kind string, value string")
    merged = rows(N.merge_mentions(df), "start")
    assert [(m["start"], m["end"], m["kind"], m["value"]) for m in merged] == [
        (0, 11, "A", "data basees"), (20, 25, "A", "other"), (26, 30, "B", "kind"),
    ]
    text = "  red   fox \n and red fox"
    terms = spark.createDataFrame([("red fox", "T")], "term string, kind string")
    found = rows(N.extract_mentions(texts(text), terms, original_offsets=True), "start")
    assert [text[m["start"]:m["end"]] for m in found] == ["red   fox", "red fox"]


def test_mentions_of_a_long_text_match_a_plain_scan(spark, texts):
    words = [f"w{i % 37}" for i in range(1000)]
    text = " ".join(words)
    terms = spark.createDataFrame([("w3 w4", "T"), ("w36", "T")], "term string, kind string")
    found = {(m.start, m.value) for m in N.extract_mentions(texts(text), terms).collect()}
    want, at = set(), 0
    for i, w in enumerate(words):
        if w == "w36":
            want.add((at, w))
        if w == "w3" and i + 1 < len(words) and words[i + 1] == "w4":
            want.add((at, "w3 w4"))
        at += len(w) + 1
    assert found == want


def test_model_failures_become_rows(texts):
    def load():
        def model(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("no")
            return [[{"start": 0, "end": 2, "kind": "K", "value": t[:2]}] if "odd" not in t else [{"start": 0}] for t in batch]

        return model

    docs = texts("fine text", "odd text", "boom text").repartition(1)
    got = rows(N.extract_mentions_batch(docs, load, batch=1), "doc_id")
    assert [(r["value"], r["error"] is not None) for r in got] == [("fi", False), (None, True), (None, True)]


def test_dataset_date_needs_a_word_edge(spark, texts):
    found = D.extract_date_ranges(texts("x12005 2006x 2007"), pattern=DATASET_DATE).collect()
    assert [f.period for f in found] == ["2007"]


def test_normalization_is_complete(texts):
    text = "é – Å plain"
    assert L.normalize_chars(texts(text)).first().text == "é - Å plain"


def test_duplicate_mentions_and_education(spark):
    df = spark.createDataFrame([(1, 5, "MIT", "BA"), (1, 2, "mit", "ba"), (1, 9, "Yale", "BA")], "doc_id int, pos int, institution string, degree string")
    assert [(r.pos, r.institution) for r in I.dedup_education(df).orderBy("pos").collect()] == [(2, "mit"), (9, "Yale")]
