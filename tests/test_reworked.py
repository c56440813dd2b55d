"""Appends of matches, postings by column name, long records, search over vectors of any length."""

import numpy as np

from talentweave.operators.matching import _top_k
from talentweave.operators.restructure import parse_resume_json
from talentweave.operators.routing import parse_or_error
from talentweave.sources.readers import ingest_union, read_posting_csv
from talentweave.sources.tables import write_matches


def test_appends_of_many_and_few_queries_are_read_together(spark, tmp_path):
    path = str(tmp_path / "matches")
    write_matches(spark.range(150).selectExpr("id query_id", "id match_id"), path)
    write_matches(spark.range(3).selectExpr("id query_id", "id match_id"), path)
    assert spark.read.parquet(path).count() == 153


def test_posting_columns_go_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("job_via,job_skills,company_name,x,job_title_short,y,job_location,job_country,job_type_skills\nv,\"['sql']\",Co,1,Baker,2,Rome,IT,{}\n")
    row = read_posting_csv(spark, str(tmp_path / "p.csv")).first()
    assert (row["job_title_short"], row["company_name"], row["job_skills"]) == ("Baker", "Co", "['sql']")


def test_long_records_come_through(spark, tmp_path):
    (tmp_path / "long.txt").write_text("x" * (11 << 20))
    rows = ingest_union(spark, [{"path": str(tmp_path / "long.txt"), "source": "s", "type": "txt"}]).selectExpr("length(raw_data) n", "error").collect()
    assert [(r["n"], r["error"]) for r in rows] == [(11 << 20, None)]


def test_top_k_of_long_cancelling_vectors():
    rng = np.random.default_rng(1)
    docs = rng.standard_normal((400, 64))
    docs[:, 32:] = -docs[:, :32] + 1e-4 * rng.standard_normal((400, 32))
    docs *= 1e4
    queries = np.ones((20, 64)) * 1e3
    q, d, sim = _top_k(queries, docs, np.arange(400), 5)
    exact = queries @ docs.T
    for i in range(20):
        assert set(d[q == i]) == set(np.argsort(-exact[i], kind="stable")[:5])


def test_values_that_are_no_objects_are_errors(spark):
    texts = ["{}", '{"k": 1}', "5", "[1, 2]", '"x"', "null", "{broken", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    for out in (parse_resume_json(rows, "raw"), parse_or_error(rows, "raw", "k int")):
        assert [r["error"] is None for r in out.collect()] == [True, True] + [False] * 7
