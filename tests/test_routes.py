"""List literals, profiles in the intake, and lookup of repeated texts."""

import ast

import pytest
from pyspark.sql import functions as F

from talentweave.operators import matching as M
from talentweave.operators.restructure import parse_list_literal
from talentweave.plans.onboarding import parse
from talentweave.schemas import ENVELOPE
from talentweave.streaming import intake as SP

LITERALS = [
    "['a', 'b']", "['sql', None, 'r']", "('x', 'y')", "('x',)", r"['it\'s', 'a\\b']", """["it's", 'say "hi"']""", "[]", "()", "{}", "{'k': ['a', 'b'], 'm': 'c', 'n': None}",
    "{'k': ('a', None)}", "['a: b', 'c, d', '[e]']", "[1, 2.5, 'x']", "['None', 'True']", "['" + "x" * 20000 + "']", "  ['a']  ",
]
BROKEN = ["['a', ", "['a' 'b'", "nothing", "", None, "['a']]", "__import__('os')", "{'k': }", "[a, b]"]


def expected(text):
    value = ast.literal_eval(text.strip())
    items = [v for x in value.values() for v in (x if isinstance(x, list | tuple) else [x])] if isinstance(value, dict) else list(value)
    return [str(x) for x in items if x is not None]


def test_list_literals(spark):
    rows = spark.createDataFrame(list(enumerate(LITERALS + BROKEN)), "i int, t string").select("i", parse_list_literal(F.col("t")).alias("x")).collect()
    got = {r.i: r.x for r in rows}
    assert [got[i] for i in range(len(LITERALS))] == [expected(t) for t in LITERALS]
    assert all(got[len(LITERALS) + i] == [] for i in range(len(BROKEN)))


def test_profiles_come_through_the_intake(spark, tmp_path):
    rows = [("A1", "JVBERi0=", "linkedin_pdf", "pdf", "cv"), ("A2", "JVBERi0=", "linkedin_pdf", "pdf", "cv"), ("A3", "x", "elsewhere", "xml", "cv"), ("A4", "JVBERi0=", "linkedin_pdf", "pdf", "cv")]
    box = "doc_id string, pdf_page int, x0 double, y1 double, seq int, text string"
    boxes = [("A1", 0, 20.0, 700.0, 0, "Contact\nann@x.org"), ("A1", 0, 220.0, 700.0, 1, "Ann Lee\nCook\nRome"), ("A1", 0, 220.0, 500.0, 2, "Experience\nInn\nCook\nMay 2001 - June 2003"),
             ("A4", 0, 20.0, 700.0, 0, " "), ("other", 0, 20.0, 700.0, 0, "Contact")]
    boxes = spark.createDataFrame(boxes, box)
    SP.fanout_sinks(lambda b: parse(b, boxes=boxes), str(tmp_path))(spark.createDataFrame(rows, ENVELOPE), 0)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert [(r.id, r.name, r.email) for r in read("info_cv")] == [("A1", "Ann Lee", "ann@x.org")]
    assert "I worked as Cook at Inn from May 2001 - June 2003" in read("text_cv")[0].text
    assert sorted((r.id, r.error) for r in read("quarantine")) == [("A2", "Could not parse PDF layout"), ("A3", "Parser failed"), ("A4", "Could not parse PDF layout")]


@pytest.mark.parametrize("copies", [1, 3])
def test_a_text_has_one_vector(spark, copies):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none")], "num long, text string")
    vectors = spark.createDataFrame([("a", [float(i)]) for i in range(copies)] + [("b", [9.0])], "text string, embedding array<float>")
    assert sorted((r.num, r.embedding[0]) for r in M.lookup_text_embedding(texts, vectors).collect()) == [(1, 0.0), (2, 9.0)]
