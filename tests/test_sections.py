"""Labels of sections whose heading names none."""

from talentweave.operators import lines as L
from talentweave.operators.free_text import parse_resume_text

TABLE = [("Skills", "cobol", 2.0), ("Skills", "Fortran", 1.0), ("Experience", "ran", 1.0), ("Experience", "cobol", 0.5), ("Skills", "ran", -9.0)]


def weights(spark, rows):
    return spark.createDataFrame(rows, "section string, term string, weight double")


def test_labels_by_a_weight_table(spark):
    texts = ["COBOL, fortran; cobol", "we ran it", "nothing known", "", None, "cobol ran", "tie"]
    rows = spark.createDataFrame([(i, 0, t, "x") for i, t in enumerate(texts)], "doc_id long, pos int, content string, extra string")
    found = L.classify_section_fallback(rows, weights(spark, [*TABLE, ("B", "tie", 1.0), ("A", "tie", 1.0), ("A", None, 1.0)]))
    got = {r.doc_id: (r.section, r.extra) for r in found.collect()}
    assert got == {i: (s, "x") for i, s in enumerate(["Skills", "Experience", None, None, None, "Experience", "A"])}
    other = L.classify_section_fallback(rows, weights(spark, [("Languages", "cobol", 1.0)]))
    assert {r.doc_id: r.section for r in other.collect() if r.section} == {0: "Languages", 5: "Languages"}
    assert L.classify_section_fallback(rows.limit(0), weights(spark, TABLE)).count() == 0


def test_a_hook_names_sections_of_resumes(spark, texts):
    # Two blanks: marked as a heading, but the name of no section.
    docs = texts("Jane Doe\n\nTECHNICAL  SKILLS\nCobol, Fortran\n\nEDUCATION\nBachelor of Science\n", "", None, "Jim\n")
    label = L.by_weights(weights(spark, TABLE))

    def names(rows):
        return {r.doc_id: [s.section for s in r.sections or []] for r in rows.collect()}

    plain, named = names(L.sections_of_text(docs)), names(L.sections_of_text(docs, label_sections=label))
    assert plain[0] == ["Header", None, "Education"] and named == plain | {0: ["Header", "Skills", "Education"]}
    parsed = {r.doc_id: r.skills for r in parse_resume_text(docs, label_sections=label).collect()}
    assert {"cobol", "fortran"} <= set(parsed[0]) and parsed.keys() == {0, 1, 2, 3}
    assert not parse_resume_text(docs).where("doc_id = 0").first().skills
