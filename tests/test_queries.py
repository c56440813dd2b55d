"""Queries against DuckDB at the smallest scale, and the plans that scale depends on."""

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spark_entry
from check_queries import TABLES, compare
from talentweave.operators.scoring import partial_ratio
from talentweave.plans import funnel
from talentweave.plans.catalog import QUERIES, corpus, parse_intake
from talentweave.plans.oracles import ORACLES
from talentweave.plans.views import Views
from talentweave.schemas import ENVELOPE
from talentweave.streaming import intake as SP

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    funnels = {"funnel_best_cv", "funnel_best_job", "funnel_cvs_ranked", "funnel_jobs_ranked"}
    assert set(QUERIES) - set(ORACLES) == {"title_similarity", "final_score", "final_score_with_title_text", *funnels}


@pytest.mark.parametrize("name", [
    "assign_doc_ids", "dedup_content", "render_resume_text", "extract_date_ranges", "filter_date_mentions", "chunk_words",
    "slice_sections_text", "knn_cvs_for_job", "title_category", "top_n_report", "decode_envelope",
])
def test_query_equals_sql(spark, duck, name):
    got = spark_entry.queries()[name](spark, FOLDER).toPandas()
    cursor = duck.execute(ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert compare(got.astype(object), want) == "ok"


@pytest.mark.parametrize("name", ["funnel_cvs_ranked", "knn_jobs_for_cv", "skill_jaccard", "link_title_company", "summary_stats", "extract_mentions"])
def test_no_pairwise_products(spark, name):
    text = plan(QUERIES[name](Views(spark, FOLDER)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["parse_resume_text", "parse_resume_dataset", "resume_json_to_schema", "tokenize_skills_text", "extract_education_text"])
def test_parsing_does_not_shuffle(spark, name):
    exchanges = re.findall(r"Exchange (\w+)", plan(QUERIES[name](Views(spark, FOLDER))))
    # Dealing a small table out to all cores is the only exchange.
    assert set(exchanges) <= {"RoundRobinPartitioning"}


@pytest.mark.parametrize("name", ["knn_cvs_for_job", "top_n_report"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](Views(spark, FOLDER)))


def test_only_needed_columns_are_read(spark):
    text = plan(Views(spark, FOLDER).profile_skill())
    line = next(x for x in text.splitlines() if "lineitem.parquet" in x)
    assert "l_suppkey" in line and "l_tax" not in line and "l_extendedprice" not in line


@pytest.mark.parametrize("query, resume_is_query", [("job_num", False), ("cv_num", True)])
def test_funnels_rank_by_the_full_score(spark, query, resume_is_query):
    c, match = corpus(Views(spark, FOLDER)), "cv_num" if query == "job_num" else "job_num"
    pairs = funnel.score_pairs(funnel.candidates(c, resume_is_query), c, resume_is_query, with_title_text=False).toPandas()
    mine = c.cv_title.toPandas().groupby("num")["title"].agg(list).to_dict()
    theirs = c.job_title.toPandas().set_index("num")["title"].to_dict()
    best = [max([partial_ratio(t, theirs[j]) for t in mine.get(n, [])], default=0) for n, j in zip(pairs["cv_num"], pairs["job_num"], strict=True)]
    assert any(0 < b < 100 for b in best)
    pairs["score"] += 0.1 * pd.Series(best) / 100
    pairs = pairs.sort_values([query, "score", "rank"], ascending=[True, False, True])
    pairs["place"] = pairs.groupby(query).cumcount() + 1
    want = {(r[query], r["place"]): r["score"] for r in pairs.to_dict("records")}
    queries, many, one = spark_entry.queries(), *(("cvs", "cv") if query == "job_num" else ("jobs", "job"))
    ranked = queries[f"funnel_{many}_ranked_with_title_text"](spark, FOLDER).toPandas()
    assert {(q, p): s for q, p, s in zip(ranked[query], ranked["place"], ranked["score"], strict=True)} == pytest.approx(want, abs=2e-6)
    top = queries[f"funnel_best_{one}_with_title_text"](spark, FOLDER).toPandas()
    assert {q: s for q, s, m in zip(top[query], top["score"], top[match], strict=True) if m == m} == pytest.approx({q: s for (q, p), s in want.items() if p == 1}, abs=2e-6)
    if query == "job_num":
        entry = spark_entry.entry(spark).toPandas()
        assert sorted(entry["score"]) == pytest.approx(sorted(pairs["score"]), abs=2e-6)


def test_intake_keeps_envelopes_of_every_route(spark, tmp_path):
    page = "Name: Ann Lee\nEXPERIENCE\nCook | Inn Ltd\n2001 - 2003\nSKILLS\nbaking, plating\n"
    flat = "COOK       Summary    Hands-on.    Experience    Inn Ltd  Cook  2001 - 2003    Skills    baking, plating"
    posting = '{"job_title_short": "Cook", "company_name": "Inn", "job_location": "Rome", "job_country": "Italy", "job_skills": "[]", "job_type_skills": null}'
    rows = [
        ("B1", posting, "jobs_dataset", "json", "job"), ("B2", "no json", "jobs_dataset", "json", "job"), ("A1", page, "new_texts", "txt", "cv"),
        ("A2", flat, "string_dataset", "csv", "cv"), ("A3", '{"personal_info": {"name": "Ann"}}', "json_dataset", "jsonl", "cv"),
        ("A4", "no json", "json_dataset", "jsonl", "cv"), ("A5", "JVBERi0=", "linkedin_pdf", "pdf", "cv"), ("A6", "x", "elsewhere", "xml", "cv"),
        ("X7", page, "new_texts", "txt", "cv"), (None, page, "new_texts", "txt", "cv"), ("A8", None, "new_texts", "txt", "cv"),
    ]
    SP.fanout_sinks(parse_intake, str(tmp_path))(spark.createDataFrame(rows, ENVELOPE), 0)
    found = {name: [r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()] for name in ("text_cv", "schema_cv", "info_cv", "text_job", "schema_job", "quarantine")}
    assert sorted(found["text_cv"]) == sorted(found["schema_cv"]) == sorted(found["info_cv"]) == ["A1", "A2", "A3", "A8"]
    assert found["text_job"] == found["schema_job"] == ["B1"]
    assert set(found["quarantine"]) == {"A4", "A5", "A6", "B2", "X7", None}
    assert len(rows) == len(found["text_cv"]) + len(found["text_job"]) + len(found["quarantine"])
    skills = {r.id: r.skills for r in spark.read.parquet(f"{tmp_path}/schema_cv").collect()}
    assert all("baking" in skills[i] for i in ("A1", "A2"))


def test_result_does_not_depend_on_partitions(spark):
    v = Views(spark, FOLDER)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES["assign_doc_ids"](v).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
