"""Folders of many small files: listed and read in tasks, with the rows of Spark's own sources."""

import base64
import gzip
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talentweave.plans import catalog
from talentweave.plans.views import Views
from talentweave.sources import files
from talentweave.sources import readers as SR

ODD = {
    "a b.txt": b"x y\n", "p%20q.txt": b"pct", "é中.txt": "é中".encode(), "empty.txt": b"", "bad.txt": b"\xff\xfea\xc3", "z.gz": gzip.compress(b"zip"),
    "_h.txt": b"h", ".h.txt": b"h", "bom.txt": b"\xef\xbb\xbfhi", "a#b?c+d&e=f;g[1].txt": b"odd", "sub/in.txt": b"sub", "_sub/in.txt": b"hidden"}
KEYED = {"k=1/a.txt": b"1", "k=2/b.txt": b"2\n\n", "k=2/deep/c.txt": b"3", "k=3/a.txt.gz": gzip.compress(b"4")}


def put(folder, contents):
    for name, content in contents.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(folder)


def rows(df):
    return sorted((r.path, bytes(r.data)) for r in df.select("path", F.col("raw_data").cast("binary").alias("data")).collect())


def test_the_driver_lists_no_file(spark, tmp_path):
    path = put(tmp_path / "many", {f"k={i % 3}/{i}.txt": b"%d" % i for i in range(90)})
    for read in (SR.read_text_files, SR.read_binary_base64):
        found = read(spark, path)
        assert len(found.inputFiles()) < 30 and found.count() == 90
    union = SR.ingest_union(spark, [{"path": path, "source": "s", "type": "txt"}, {"path": path, "source": "s", "type": "pdf"}])
    assert len(union.inputFiles()) < 30
    assert sorted(r.raw_data for r in union.where("type = 'txt'").collect()) == sorted(str(i) for i in range(90))


def test_a_page_is_one_file_and_no_folder(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    made = list(Path(catalog._landed_pages(v).removeprefix("file:")).rglob("*"))
    pages = v.base("pages").collect()
    assert sum(p.is_dir() for p in made) <= spark.sparkContext.defaultParallelism
    assert sorted(p.read_bytes() for p in made if p.is_file()) == sorted((r.html + "\n").encode() for r in pages)


def test_files_are_those_of_sparks_sources(spark, tmp_path):
    flat, keyed = put(tmp_path / "flat", ODD), put(tmp_path / "keyed", KEYED)
    for path in (flat, keyed, f"{flat}/*.txt", f"{flat}/a b.txt", f"{keyed}/k=*"):
        text = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw_data"), F.col("_metadata.file_path").alias("path"))
        assert rows(SR.read_text_files(spark, path)) == rows(text)
        data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("raw_data"))
        assert rows(SR.read_binary_base64(spark, path)) == [(p, base64.b64encode(d)) for p, d in rows(data)]
    for read in (SR.read_text_files, SR.read_binary_base64):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read(spark, str(tmp_path / "none"))
        assert read(spark, put(tmp_path / "blank", {"empty.txt": b""})).count() == 0


def test_a_store_of_spark_only_is_read_by_spark(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "flat", ODD)
    here = [rows(read(spark, path)) for read in (SR.read_text_files, SR.read_binary_base64)]
    monkeypatch.setattr(files, "opened_by_tasks", lambda path: False)
    assert [rows(read(spark, path)) for read in (SR.read_text_files, SR.read_binary_base64)] == here
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    files.write_text_files(pages, str(tmp_path / "made"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "made"), wholetext=True).collect()) == ["a\n", "b\n"]


def test_keys_may_repeat_and_texts_be_missing(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (3, "")], "key long, value string")
    files.write_text_files(pages, str(tmp_path / "made"))
    assert sorted(r.raw_data for r in SR.read_text_files(spark, str(tmp_path / "made")).collect()) == ["\n", "\n", "a\n", "b\n", "c\n"]
