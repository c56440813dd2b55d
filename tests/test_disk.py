"""What queries leave on disk while they run."""

import random
import shutil
import time
from pathlib import Path

from pyspark.sql import functions as F

from talentweave.operators import scoring as S
from talentweave.plans.catalog import parse_intake
from talentweave.plans.views import Views
from talentweave.schemas import ENVELOPE
from talentweave.session import CLEANUP_KEY, landed_once, settled, shared_folder
from talentweave.sources import tables as ST
from talentweave.streaming import intake as SP


def shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def left_by(spark, run):
    """Shuffle files that a step leaves, with some time for their removal."""
    before = shuffle_files(spark)
    run()
    for _ in range(40):
        if not (more := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return more


def test_written_tables_leave_no_shuffles(spark, tmp_path):
    v = Views(spark, str(shutil.copytree("/root/testdata/sf0.001", tmp_path / "data")))
    assert not left_by(spark, lambda: v.written("posting_record"))
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert not left_by(spark, lambda: landed_once(spark, v.sf_dir, "sevens", lambda p: rows.write.parquet(p)))
    kept = []
    assert not left_by(spark, lambda: kept.append(settled(rows, "sevens")))
    assert kept[0].count() == 7 and kept[0].dtypes == rows.dtypes
    assert spark.conf.get(CLEANUP_KEY) == "false"


def test_products_of_pairs_and_titles_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(1, 10)], "cv_num long, job_num long")
    titles = spark.createDataFrame([(1, "cook"), (10, "chef")], "num long, title string")
    groups = spark.createDataFrame([("g", "cook"), ("g", "chef")], "group_id string, term string")
    for found in (S.title_similarity(pairs, titles, titles), S.title_category(pairs, titles, titles, groups)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(cv_title" not in plan and "hashpartitioning(job_title" not in plan


def test_title_scores_are_those_of_all_pairs_of_titles(spark):
    r, words = random.Random(4), ["cook", "chef", "head cook", "baker", "gt", "t", "g", ""]
    titles = {side: [(n, r.choice(words)) for n in range(6) for _ in range(r.randint(0, 4))] for side in ("cv", "job")}
    groups = [(r.choice("abt"), r.choice(words)) for _ in range(14)] + [(None, "cook"), ("a", None)]
    pairs = [(c, j, c * j / 10) for c in range(7) for j in range(7)] + [(1, 1, 0.5)]
    rows = spark.createDataFrame(pairs, "cv_num long, job_num long, sim double")
    cv, job = (spark.createDataFrame(titles[s] + [(0, None)], "num long, title string") for s in ("cv", "job"))
    found = S.title_similarity(S.title_category(rows, cv, job, spark.createDataFrame(groups, "group_id string, term string")), cv, job)
    want = []
    for c, j, sim in pairs:
        both = [(x, y) for n, x in titles["cv"] if n == c for m, y in titles["job"] if m == j]
        shared = sum(g == h and g is not None for x, y in both for g, s in groups if s == x for h, t in groups if t == y)
        want.append((c, j, sim, 1 if any(x == y for x, y in both) else shared, max([S.partial_ratio(x, y) for x, y in both], default=0) / 100))
    assert found.columns == ["cv_num", "job_num", "sim", "category", "title_sim"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


BOX = "doc_id string, pdf_page int, x0 double, y1 double, seq int, text string"


def test_batches_leave_nothing_but_their_tables(spark, tmp_path):
    rows = [(f"A{i}", "text", *(("elsewhere", "xml") if i % 2 else ("linkedin_pdf", "pdf")), "cv") for i in range(40)]
    boxes = spark.createDataFrame([(f"A{i}", 0, 220.0, 500.0, 1, "Ann Lee\nCook\nRome") for i in range(60)], BOX)
    batch = spark.createDataFrame(rows, ENVELOPE)
    folder = Path(shared_folder(spark).removeprefix("file:"), spark.sparkContext.applicationId)
    persisted = spark.sparkContext._jsc.sc().getPersistentRDDs
    before, kept = set(folder.glob("*")), persisted().size()
    assert not left_by(spark, lambda: SP.fanout_sinks(lambda b: parse_intake(b, boxes), str(tmp_path / "out"))(batch, 0))
    assert set(folder.glob("*")) == before and persisted().size() == kept
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() + spark.read.parquet(str(tmp_path / "out/text_cv")).count() == 40


def test_batches_of_bounded_bytes_read_every_file_once(spark, tmp_path):
    landed, rows = str(tmp_path / "landed"), [(f"A{i}", f"text {i}", "elsewhere", "xml", "cv") for i in range(60)]
    ST.producer_to_topic(spark.createDataFrame(rows, ENVELOPE).repartition(6)).write.parquet(landed)
    size, sizes = max(p.stat().st_size for p in Path(landed).glob("*.parquet")), []
    stream = ST.decode_envelope(SP.stream_source(spark, landed, max_bytes=2 * size))
    SP.start(stream, lambda batch, n: sizes.append(batch.count()), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert len(sizes) >= 3 and sum(sizes) == 60


def test_batches_without_profiles_read_no_boxes(spark, tmp_path):
    spark.createDataFrame([("A1", 0, 20.0, 700.0, 0, "Contact")], BOX).write.parquet(str(tmp_path / "boxes"))
    boxes = spark.read.parquet(str(tmp_path / "boxes"))
    for source, type_, reads in (("elsewhere", "xml", 0), ("linkedin_pdf", "pdf", 1)):
        found = parse_intake(spark.createDataFrame([("A1", "x", source, type_, "cv")], ENVELOPE), boxes)
        assert min(1, found._jdf.queryExecution().optimizedPlan().toString().count("pdf_page")) == reads
        assert [r.id for r in found.collect()] == ["A1"]
