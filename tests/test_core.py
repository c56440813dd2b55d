"""Identity, matching, scoring, restructuring, streaming and the two main flows."""

import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions.levels import experience_gap, gap_penalty, level_number
from talentweave.operators import analytics as A
from talentweave.operators import embedding as E
from talentweave.operators import identity as I
from talentweave.operators import matching as M
from talentweave.operators import render as R
from talentweave.operators import restructure as J
from talentweave.operators import routing as Q
from talentweave.operators import scoring as S
from talentweave.plans import onboarding
from talentweave.session import fresh_path
from talentweave.sources import readers as SR
from talentweave.sources import tables as ST
from talentweave.streaming import intake as SP

TYPES = "num bigint, embedding array<float>"


def vectors(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 64)).astype(np.float32)
    data[n - copies:] = data[0]
    return data, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], TYPES)


def brute_force(q, d, k):
    out = {}
    for i, x in enumerate(q):
        sims = [(-sum(float(a) * float(b) for a, b in zip(x, y)), j) for j, y in enumerate(d)]
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def ranking(df):
    out = {}
    for r in df.orderBy("query_num", "rank").collect():
        out.setdefault(r.query_num, []).append(r.match_num)
    return out


def test_knn_matches_brute_force_also_with_many_equal_vectors(spark):
    q, queries = vectors(spark, 7, 1)
    d, docs = vectors(spark, 60, 2, copies=30)
    want = brute_force(q, d, 12)
    assert ranking(M.knn(queries, docs.repartition(5), 12)) == want
    assert ranking(M.knn_blocked(queries, docs, 12, query_block=3, document_block=11)) == want
    assert ranking(M.knn(queries, docs, 100))[0] == brute_force(q, d, 100)[0]


def test_knn_switches_to_blocks_for_many_queries(spark, monkeypatch):
    q, queries = vectors(spark, 9, 3)
    d, docs = vectors(spark, 20, 4)
    want = ranking(M.knn(queries, docs, 3))
    monkeypatch.setattr(M, "MAX_SHIPPED_QUERIES", 4)
    assert ranking(M.knn(queries, docs, 3)) == want == brute_force(q, d, 3)
    assert M.knn(queries.limit(0), docs, 3).count() == 0


def test_tiles_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(5)
    q, d = rng.normal(size=(10, 8)), rng.normal(size=(30, 8))
    whole = M._top_k(q, d, np.arange(30), 4)
    monkeypatch.setattr(M, "TILE", 40)
    assert all((a == b).all() for a, b in zip(whole, M._top_k(q, d, np.arange(30), 4)))


def test_hashed_vectors(spark):
    texts = ["alpha beta alpha", "", None, "Gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.embedding for r in E.hashed_vectors(df).collect()}
    want = np.zeros(64)
    for w in "alpha beta alpha".split():
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        want[(h - (1 << 64) if h >= 1 << 63 else h) % 64] += 1
    assert np.allclose(got[0], want / np.linalg.norm(want))
    assert got[1] == [0.0] * 64 and got[2] == [0.0] * 64


def test_encoder_hook(spark):
    df = spark.createDataFrame([("A1", "abc"), ("A2", "defgh")], "id string, text string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r.id: (r.role, list(r.embedding)) for r in E.embed_texts(df, "cv", False, load).collect()}
    assert got == {"A1": ("passage", [12.0, 1.0]), "A2": ("passage", [14.0, 1.0])}


@pytest.mark.parametrize("buckets", [1, 7])
def test_numbers_are_dense_when_one_group_has_most_rows(spark, buckets):
    rows = [("hot" if i % 10 else "cold", i * 3) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(6)
    got = I.number_in_group(df, ["g"], "k", buckets=buckets).collect()
    for g in ("hot", "cold"):
        mine = sorted((r.k, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_ids_go_on_after_the_existing_ones(spark):
    df = spark.createDataFrame([(1, "job"), (2, "cv"), (3, None), (4, "job")], "k bigint, category string")
    old = spark.createDataFrame([("A", 7), ("A", 3)], "kind string, num bigint")
    got = [r.id for r in I.assign_doc_ids(df, "k", old).orderBy("k").collect()]
    assert got == ["B1", "A8", "A9", "B2"]


def test_dedup_keeps_nulls_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "num bigint, raw_data string")
    once = I.dedup_content(df)
    assert sorted(r.num for r in once.collect()) == [1, 2, 4, 5]
    assert sorted(r.num for r in I.dedup_content(once.drop("content_hash")).collect()) == [1, 2, 4, 5]


RESUME = {
    "personal_info": {"name": "UNKNOWN", "email": "a@b.example", "location": {"city": "Oslo", "country": "Norway"}},
    "experience": [
        {"title": "Dev", "company": "Not Provided", "dates": {"start": "2015-02", "end": "Present", "duration": "long"},
         "responsibilities": ["code", "Unknown", "test"], "technical_environment": {"lang": ["Go", "unknown"], "db": ["PG"]}},
        {"title": "unknown", "company": "Acme", "dates": {"start": "c. 2010"}},
        {"title": "Clerk"},
    ],
    "education": [
        {"institution": {"name": "UiO"}, "degree": {"level": "MSc", "field": "unknown"},
         "dates": {"start": "2008", "expected_graduation": "2008-06", "end": "2010"},
         "achievements": {"zeta": "prize", "alpha": ["first", "Unknown", 2], "gone": "not provided"}},
        {},
    ],
    "skills": {
        "technical": {"languages": ["Go", "SQL"], "tools": [{"name": "Git"}, {"name": "unknown"}, {"level": "x"}]},
        "spoken": [{"language": "Norwegian", "level": "native"}, "English", "Unknown"],
    },
}


def test_resume_json_shapes(spark):
    lines = [json.dumps(RESUME), json.dumps({}), "{broken", json.dumps({"experience": [{"title": "X"}]})]
    df = spark.createDataFrame([(f"A{i}", x) for i, x in enumerate(lines)], "id string, raw_data string")
    got = {r.id: r.asDict(recursive=True) for r in J.resume_json_to_schema(df).collect()}
    one = got["A0"]
    assert (one["name"], one["linkedin"], one["location"], one["title"]) == ("", "", "Oslo, Norway", "Dev")
    assert [(j["title"], j["company"], j["period"], j["description"]) for j in one["experience"]] == [
        ("Dev", "", "2015 2026 (long)", "code, test"), ("", "Acme", "c. 2", ""), ("Clerk", "", "", ""),
    ]
    assert one["total_experience"] == 11
    assert one["education"][0] == {"period": "2008 - 2010", "institution": "UiO", "degree": "MSc", "details": "prize, first, 2"}
    assert one["education"][1] == {"period": "", "institution": "", "degree": "", "details": ""}
    assert sorted(one["skills"]) == sorted(["Go", "PG", "SQL", "Git", "Norwegian", "native", "English"])
    assert got["A1"]["experience"] == [] and got["A1"]["total_experience"] == 0 and got["A1"]["error"] is None
    assert got["A2"]["error"] and got["A3"]["total_experience"] is None


def test_list_literals_are_parsed_not_evaluated(spark):
    cases = {
        "['a', 'b']": ["a", "b"], "{'k': ['x', 'y'], 'm': 'z'}": ["x", "y", "z"], "[]": [], "": [], None: [],
        "__import__('os')": [], "{'k': 'v'}": ["v"], " ['pad'] ": ["pad"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.v for r in df.select("c", J.parse_list_literal(F.col("c")).alias("v")).collect()}
    assert got == cases


def test_posting_schema_and_text(spark):
    raw = [("Cook", None, "Rome", None, "['a', 'b']", "{'t': ['b', 'c']}"), (None, "Acme", None, "Italy", None, None)]
    df = spark.createDataFrame(raw, "job_title_short string, company_name string, job_location string, job_country string, job_skills string, job_type_skills string")
    got = R.render_posting_text(J.schematize_posting(df)).orderBy(F.desc("title")).collect()
    assert (got[0].location, got[0].skills) == ("Rome", ["a", "b", "c"])
    assert got[0].text == " in Rome is looking for a Cook whose experienced in a b c"
    assert got[1].text == "Acme in Italy is looking for a "


def test_resume_text_leaves_out_placeholders(spark):
    ddl = "title string, total_experience int, skills array<string>, experience array<struct<title: string, company: string, period: string, location: string, description: string>>, education array<struct<period: string, institution: string, degree: string, details: string>>"
    rows = [
        ("Cook", 0, [], [("Cook", "Company", "2001", "City , State", "made  soup"), ("", "X", "", "", "")], [("2000", "Institution Not Found", "BA", ""), ("", "", "Degree Not Found", "")]),
        ("", None, ["a", "b"], [], []),
    ]
    got = [r.text for r in R.render_resume_text(spark.createDataFrame(rows, ddl)).collect()]
    assert got[0] == "I am a Cook with 0 years of experience (internship level). I worked as Cook from 2001, made soup. I completed my BA around 2000."
    assert got[1] == "I am a My skills include: a, b."


def test_gap_and_penalty(spark):
    df = spark.createDataFrame([("Mid-Level job", "senior level"), ("senior level", "junior level"), ("none", "mid-level")], "job string, cv string")
    gap = experience_gap(level_number(F.col("job")), level_number(F.col("cv")))
    got = df.select(gap.alias("g"), gap_penalty(gap, False).alias("p"), (gap * gap_penalty(gap, False)).alias("x")).collect()
    assert got[0].g == pytest.approx(0.05 / 3) and got[1].g == pytest.approx(-0.1) and got[2].g is None
    # Both directions cost 0.0025 per level.
    assert got[0].x == pytest.approx(0.0025) and got[1].x == pytest.approx(0.005)


def test_partial_ratio():
    assert S.partial_ratio("cook", "head cook at sea") == 100
    assert S.partial_ratio("", "x") == 0 and S.partial_ratio("abc", "abc") == 100
    assert 0 < S.partial_ratio("line cook", "head cook") < 100
    assert S.partial_ratio("abcd", "xxabxx") == S.partial_ratio("xxabxx", "abcd")


def test_scores_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 10, 0.5, 1), (2, 10, 0.4, 2), (3, 10, 0.3, 3)], "cv_num bigint, job_num bigint, sim double, rank int")
    cv_skill = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "num bigint, skill string")
    job_skill = spark.createDataFrame([(10, "a"), (10, "c")], "num bigint, skill string")
    got = {r.cv_num: r.jaccard for r in S.skill_jaccard(pairs, cv_skill, job_skill).collect()}
    assert got == {1: 0.3333, 2: 0.0, 3: 0.0}  # four decimals
    cv_title = spark.createDataFrame([(1, "cook"), (1, "chef"), (2, "chef"), (2, "kitchen hand")], "num bigint, title string")
    job_title = spark.createDataFrame([(10, "cook")], "num bigint, title string")
    labels = spark.createDataFrame([("chef", "cook\nhead cook"), ("food trade", "chef\ncook"), ("cook", None)], "preferredLabel string, altLabels string")
    synonyms = S.occupation_synonyms(labels)
    cat = {r.cv_num: r.category for r in S.title_category(pairs, cv_title, job_title, synonyms).collect()}
    assert cat == {1: 1, 2: 2, 3: 0}
    sim = {r.cv_num: r.title_sim for r in S.title_similarity(pairs, cv_title, job_title).collect()}
    assert sim[1] == 1.0 and 0 < sim[2] < 1 and sim[3] == 0.0
    best = S.funnel_best(pairs.withColumn("score", F.lit(1.0)), spark.createDataFrame([(10,), (11,)], "job_num bigint"), "job_num", "cv_num")
    assert {r.job_num: (r.cv_num, r.score) for r in best.collect()} == {10: (1, 1.0), 11: (None, 0.0)}


def test_jaccard_is_symmetric(spark):
    rows = [(["a", "b"], ["b"]), (None, []), ([], ["x"]), (["p"], ["p"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(S.jaccard_of_arrays(F.col("a"), F.col("b")).alias("x"), S.jaccard_of_arrays(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in got] == [0.5, 0.0, 0.0, 1.0] and all(r.x == r.y for r in got)


def test_report(spark):
    rows = [("cook", "job", "x", "Rome", ["a", "b", ""]), ("cook", "job", "", "Rome", None), ("chef", "job", "y", "", ["a"])]
    df = spark.createDataFrame(rows, "title string, category string, company string, location string, skills array<string>")
    report = A.report_document(df, 1).first()
    assert report.top_job_titles == {"cook": 2} and report.top_skills == {"a": 2} and report.categories == {"job": 3}
    assert report.statistics.unique_companies == 2 and report.total_jobs == 3
    stats = A.summary_stats(df).first()
    assert (stats.jobs_with_skills, stats.jobs_without_skills) == (2, 1)
    top = A.top_n_report(A.freq_all(df), 1).where("attribute = 'title'").first()
    assert (top.value, top.n, top.more) == ("cook", 2, 1) and top.pct == pytest.approx(200 / 3)


def test_routes(spark):
    rows = [("s", "pdf", "job"), ("new_texts", "pdf", "cv"), ("linkedin_pdf", "x", None), ("string_dataset", "csv", "cv"),
            ("json_dataset", "jsonl", "cv"), ("json_dataset", "txt", "cv"), ("odd", "csv", "cv")]
    df = spark.createDataFrame(rows, "source string, type string, category string")
    assert [r.route for r in Q.route_parser(df).collect()] == ["posting", "text", "profile", "dataset", "json", "text", "none"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n')
    rows = SR.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert [(r.a, r._corrupt_record) for r in rows] == [(1, None), (None, '{"a": oops}')]
    (tmp_path / "one.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "many.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "t.txt").write_text("line\nline two\n")
    (tmp_path / "c.csv").write_text('id,Resume_str\n1,"say ""hi"",\nthere"\n2,\n')
    d = lambda name, type_, **more: {"path": str(tmp_path / name), "source": "s", "type": type_, **more}
    got = SR.ingest_union(spark, [
        d("one.json", "json"), d("many.json", "json", category="job"), d("t.txt", "txt"), d("c.csv", "csv"), d("missing.txt", "txt"), d("t.txt", "doc"),
    ]).collect()
    records = [(json.loads(r.raw_data), r.category) for r in got if r.type == "json"]
    assert sorted(records, key=str) == [({"a": 1}, "job"), ({"a": 2}, "job"), ({"a": {"b": 1}}, "cv")]
    assert sorted(r.raw_data for r in got if r.type != "json") == ["", "line\nline two\n", 'say "hi",\nthere']


def test_partition_read_of_a_missing_table(spark, tmp_path):
    assert ST.read_table_partitions(spark, str(tmp_path / "none"), "A", "id string").count() == 0


def test_stream_equals_batch_after_restart_and_resend(spark, tmp_path):
    rows = [("A1", "x"), ("A2", "x"), ("A3", "y"), ("A4", None), ("A5", None)]
    envelopes = spark.createDataFrame(rows, "id string, raw_data string").withColumns(
        {"source": F.lit("s"), "type": F.lit("txt"), "category": F.lit("cv")})
    folder, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    checkpoint = fresh_path(spark, "cp")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for _ in range(2):
            ST.producer_to_topic(envelopes).coalesce(1).write.mode("append").parquet(folder)
            SP.start(SP.intake(spark, folder), keep, checkpoint, available_now=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [r.raw_data for r in spark.read.parquet(out).collect()]
    assert sorted(map(str, got)) == ["None", "None", "x", "y"]


def test_onboarding_and_matching(spark, tmp_path):
    (tmp_path / "cv.jsonl").write_text("\n".join(json.dumps(r) for r in [RESUME, {"experience": [{"title": "Cook"}]}]) + "\n")
    (tmp_path / "cv.txt").write_text("Anna Verdi\nEXPERIENCE\nCook | Big Grill\n2001 - 2003\n")
    posts = [{"job_title_short": "Cook", "company_name": "Bar", "job_skills": "['soup']"}, {"job_title_short": "Dev", "company_name": "Lab"}]
    (tmp_path / "jobs.json").write_text(json.dumps(posts))
    (tmp_path / "bad.jsonl").write_text("not json\n")
    files = [
        {"path": str(tmp_path / "cv.jsonl"), "source": "json_dataset", "type": "jsonl"},
        {"path": str(tmp_path / "cv.txt"), "source": "new_texts", "type": "txt"},
        {"path": str(tmp_path / "jobs.json"), "source": "jobs", "type": "json", "category": "job"},
        {"path": str(tmp_path / "bad.jsonl"), "source": "json_dataset", "type": "jsonl"},
    ]
    folder = str(tmp_path / "tables")
    onboarding.onboard(spark, files, folder)
    onboarding.onboard(spark, files[:2], folder)
    texts = {r.id: r.text for r in spark.read.parquet(f"{folder}/text").collect()}
    assert sorted(texts) == ["A1", "A2", "A3", "B1", "B2"]
    assert texts["B1"] == "Bar is looking for a Cook whose experienced in soup"
    assert [r.id for r in spark.read.parquet(f"{folder}/quarantine").collect()] == ["A4"]
    hits = onboarding.match(spark, folder, K.POSTING_PREFIX, k=2).orderBy("rank").collect()
    assert [h.rank for h in hits] == [1, 2] and {h.query_id for h in hits} == {"B2"} and "email" in hits[0].asDict()
    hits = onboarding.match(spark, folder, K.RESUME_PREFIX, spark.createDataFrame([("A2",)], "id string"), k=5).collect()
    assert sorted(h.id for h in hits) == ["B1", "B2"]
