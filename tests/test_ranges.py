"""Large CSV and JSON files by byte ranges, against readers of whole files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from talentweave.sources import readers as R
from talentweave.sources.ranges import file_records

PIECES = ['"', "\n", ",", "\\", "[", "]", "{", "}", "a", "é", " ", "\\\\", '\\"', "x y", "\r\n", ""]


def odd_text(rng, n=12):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_csv_records_in_ranges(spark, tmp_path, step):
    rng, want = random.Random(step), []
    for name in ("a", "b"):
        rows = [[str(i), odd_text(rng).replace("\r\n", "\n"), "z" * rng.randrange(40)] for i in range(60)]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows([["n", "the text", "z"], *rows, ])
        (tmp_path / f"{name}.csv").write_text(out.getvalue() + ("\n\n" if name == "a" else ""), newline="")
        want += [r[1] for r in rows]
    found = [r.raw_data for r in R.read_csv_column(spark, str(tmp_path), "the text", step).collect()]
    assert sorted(found) == sorted(want)
    old = spark.read.options(**R.CSV_OPTIONS).csv(str(tmp_path)).select(F.coalesce("the text", F.lit("")))
    assert sorted(found) == sorted(r[0] for r in old.collect())


@pytest.mark.parametrize("step", [5, 64, 1 << 20])
def test_json_items_in_ranges(spark, tmp_path, step):
    rng = random.Random(step)
    items = [{"n": i, "t": odd_text(rng), "deep": [[odd_text(rng)], {"k": {"l": odd_text(rng)}}]} for i in range(80)]
    (tmp_path / "list.json").write_text(" \n" + json.dumps(items[:40], indent=1, ensure_ascii=False) + "\n ")
    (tmp_path / "dense.json").write_text(json.dumps(items[40:79], separators=(",", ":")))
    (tmp_path / "one.json").write_text(json.dumps(items[79]))
    (tmp_path / "none.json").write_text("[ ]")
    rows = R.read_json_doc(spark, str(tmp_path), "n int, t string", step).collect()
    assert sorted((r.n, r.t) for r in rows) == [(x["n"], x["t"]) for x in items]
    texts = [r.record for r in file_records(spark, str(tmp_path), "json", step).collect()]
    assert sorted((json.loads(t) for t in texts), key=lambda x: x["n"]) == items


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    path.write_text(json.dumps([{"n": i, "t": "x" * 50} for i in range(2000)]))
    rows = file_records(spark, str(path), "json", 4096)
    assert rows.select(F.spark_partition_id()).distinct().count() >= 3
    assert rows.select("at").distinct().count() > 20 and rows.count() == 2000
    numbered = rows.withColumn("n", F.monotonically_increasing_id()).collect()
    assert [json.loads(r.record)["n"] for r in sorted(numbered, key=lambda r: r.n)] == list(range(2000))


def test_envelopes_of_odd_json_files(spark, tmp_path):
    for name, text in {"a": '[1, "x, ]", null, {"b": [1, 2]}]', "b": "", "blank": " \n", "c": "no json", "d": '{"a": "[1, 2]"}', "e": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = R._json_envelope(spark, str(tmp_path), "").collect()
    want = ["1", "x, ]", None, '{"b":[1,2]}', " \n", "no json", '{"a": "[1, 2]"}']
    whole = spark.read.text(str(tmp_path), wholetext=True)
    assert {r.value for r in whole.collect()} >= {" \n", "no json"} and whole.where("value = ''").count() == 0  # Spark lists no file of no bytes
    assert sorted(str(r.raw_data).strip() for r in found) == sorted(str(x).strip() for x in want)
