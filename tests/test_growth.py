"""Steps whose work has to grow no faster than their input."""

import random
import re
import shutil
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import dataset_text as DT
from talentweave.operators import dataset_text as XD
from talentweave.operators import free_text as XT
from talentweave.operators import identity as I
from talentweave.operators import matching as M
from talentweave.operators import mentions as N
from talentweave.plans import catalog, onboarding
from talentweave.plans.views import Views
from talentweave.schemas import ENVELOPE
from talentweave.streaming import intake as SP

FREE = "Name: Ann Lee\nWORK EXPERIENCE\nCook | Big Inn\n2001 - 2003\nBaker | Old Mill\n2004 - 2006\nSKILLS\nbread, soup"
RUN_ON = "COOK       Summary    Hands-on.    Experience    Big Inn  Cook  2001 - 2003    Skills    bread, soup"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contents_parse_each_document_once(spark, texts, tmp_path):
    for parse, text, n in ((XT.parse_resume_text, FREE, 4), (XD.parse_resume_dataset, RUN_ON, 3)):
        path = str(tmp_path / parse.__name__)
        texts(text, None, "nothing").write.parquet(path)
        rows = catalog._contents(parse(spark.read.parquet(path)))
        assert plan_of(rows).count("Relation [") == 1
        found = [tuple(r) for r in rows.where("doc_id = 0").orderBy("part", "pos").collect()]
        assert len(found) == n and [r[1:4] for r in found if r[1] == "skill"] == [("skill", 0, "bread"), ("skill", 1, "soup")]
        assert rows.schema["pos"].dataType.simpleString() == "int"


def test_merged_mentions_make_their_list_once(spark):
    said = "array<struct<start: int, end: int, kind: string, value: string>>"
    rows = spark.createDataFrame([([(0, 3, "ORG", "Big"), (4, 7, "ORG", "Inn"), (20, 24, "X", "Cook")],)], f"said {said}")
    merged = rows.select(DT.merged_mentions(F.filter("said", lambda m: m["kind"] != "none")).alias("m"))
    assert plan_of(merged).count("none") == 1
    assert [tuple(m) for m in merged.first()["m"]] == [(0, 7, "ORG", "Big Inn"), (20, 24, "X", "Cook")]


def test_views_share_one_pass_over_the_lines(spark, tmp_path, monkeypatch):
    folder, joins, lines = str(shutil.copytree("/root/testdata/sf0.001", tmp_path / "data")), [], Views.sel_lines
    monkeypatch.setattr(Views, "sel_lines", lambda self: joins.append(1) or lines(self))
    v = Views(spark, folder)
    for name in ("profile_skill", "posting_skill", "profile_title", "posting", "resume_page"):
        assert v.written(name).count() == getattr(v, name)().count() if name != "resume_page" else v.written(name).count() > 0
        if name == "profile_skill":
            joins.clear()
    assert len(joins) == 3  # the three plain views above that have lines


def test_page_files_are_made_by_several_tasks(spark):
    path = catalog._landed_pages(Views(spark, "/root/testdata/sf0.001"))
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("task"))
    assert files.distinct().count() > 1 and files.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_small_blocks_do_not_send_each_vector_once_per_block(spark):
    vectors = spark.range(240).select(F.col("id").alias("num"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    many, one = M.knn_blocked(vectors, vectors, 3, 2, 2), M.knn_blocked(vectors, vectors, 3)
    # A vector is sent once per block of the other side: a bounded number of times until blocks are full.
    assert [M._block_count(n, 200, M.QUERY_BLOCK, 12) for n in (0, 250, 16_000, 320_000)] == [1, 2, 12, 20]
    assert [M._block_count(n, 300, M.DOCUMENT_BLOCK, M.MIN_DOCUMENT_BLOCKS) for n in (250, 16_000, 1_000_000)] == [1, 4, 8]
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_topics_read_what_was_parsed_once(spark):
    # One scan for each of the five topics, instead of one of every input for each.
    assert plan_of(catalog._processed_messages(Views(spark, "/root/testdata/sf0.001"))).count("Relation [") == 5


def test_batches_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    rows = [(f"A{i}", "text", "elsewhere", "xml", "cv") for i in range(400)]
    batch, seen = spark.createDataFrame(rows, ENVELOPE).coalesce(1), []

    def parse(held):
        seen.extend(r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect())
        return onboarding.parse(held)

    SP.fanout_sinks(parse, str(tmp_path))(batch, 0)
    assert len(seen) >= 4 and max(seen) <= 110 and sum(seen) == 400
    assert spark.read.parquet(f"{tmp_path}/quarantine").count() == 400


def test_words_of_a_text_are_made_once(spark, texts, tmp_path):
    long = " ".join(f"w{i}" for i in range(431))
    texts(long, "", None, " a  bc ").write.parquet(str(tmp_path / "texts"))
    windows = N.token_windows(spark.read.parquet(str(tmp_path / "texts")).repartition(3), N.spaced_words(F.col("text")))
    assert plan_of(windows).count("split(") == 1
    for row in N.token_starts(windows).collect():
        text = long if row.doc_id == 0 else "a bc"
        assert len(row.starts) == len(row.tokens) + 1 and row.starts[-1] == row.offset + sum(map(len, row.tokens))
        assert all(text[at:].startswith(word.strip()) for at, word in zip(row.starts, row.tokens))
    assert windows.count() == 4


def test_repeated_mentions_go_in_one_shuffle(spark):
    spans = [(d, s, None if s is None else s + 2) for d in (1, 2, None) for s in (0, 3, None)]
    said = [("A", "x"), ("B", "x"), ("A", "y"), ("A", None)]
    rows = spark.createDataFrame([(*span, *m) for span in spans for m in said * 2], "doc_id int, start int, end int, kind string, value string")
    found = I.dedup_mentions(rows)
    assert set(map(tuple, found.collect())) == {(*span, *m) for span in spans for m in said if m[0] != "B"} and found.count() == 27
    merged = N.merge_mentions(found).groupBy("doc_id").count()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_title_and_company_around_a_bar_are_found_in_one_pass():
    plain, r = re.compile(r"([^\n\|]+)\s*\|\s*([^\n]+)"), random.Random(3)
    fast = re.compile(K.TITLE_BAR_COMPANY)
    for _ in range(20_000):
        window = "".join(r.choices("ab |\n\t", (3, 2, 3, 2, 2, 1), k=r.randint(0, 14)))
        assert [m and m.groups() for m in (fast.search(window),)] == [m and m.groups() for m in (plain.search(window),)]
    begin = time.perf_counter()
    assert not fast.search("x " * 20_000)  # the plain form needs minutes
    assert time.perf_counter() - begin < 5


def test_dates_and_mentions_are_made_once_for_titles_and_companies(spark, texts, tmp_path):
    path = str(tmp_path / "texts")
    texts("Ann\nEXPERIENCE\nbig inn cook\n2001 - 2003\nBaker | Old Mill\n2004 - 2006\nno one near\n2007", "nothing").write.parquet(path)
    docs = spark.read.parquet(path)
    said = [(0, 0, 7, "COMPANY_NAME", "big inn"), (0, 8, 12, "JOB_TITLE", "cook"), (0, 90, 95, "CITY", "Oslo"), (0, 9000, 9004, "JOB_TITLE", "chef")]
    found = XT.link_title_company_text(docs, spark.createDataFrame(said, "doc_id bigint, start int, end int, kind string, value string"))
    assert plan_of(found).count("Relation [") == 1
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [
        (0, 0, "cook", "big inn", "2001 - 2003"), (0, 1, "Baker", "Old Mill", "2004 - 2006"), (0, 2, "cook", "big inn", "2007")]


def test_search_of_a_block_holds_little_beside_its_vectors():
    rng = np.random.default_rng(2)
    docs, queries = rng.standard_normal((60_000, 64)).astype(np.float32), rng.standard_normal((300, 64)).astype(np.float32)
    docs[500:1500] = docs[0]  # many ties
    column = pa.array(list(docs[:1000]), pa.list_(pa.float32()))
    assert M._matrix(column).dtype == np.float32 and (M._matrix(column) == docs[:1000]).all()
    tracemalloc.start()
    q, d, sim = M._top_k(queries, docs, np.arange(60_000), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    wide = M._top_k(queries.astype(np.float64), docs.astype(np.float64), np.arange(60_000), 50)
    assert all((a == b).all() for a, b in zip((q, d, sim), wide))
