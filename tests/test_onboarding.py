"""Onboarding that breaks off anywhere: ids, contents and quarantine stay unique, and nothing is lost."""

import json

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from talentweave.plans import onboarding
from talentweave.sources import ledger
from talentweave.sources import tables as ST


def described(path, names, source="json_dataset", suffix="jsonl", broken=0):
    file = path / f"{'-'.join(names)}.{suffix}"
    lines = [json.dumps({"personal_info": {"name": n}, "experience": [{"title": f"Cook {n}", "company": "Bar"}]}) for n in names]
    file.write_text("\n".join(lines + [f"broken {i}" for i in range(broken)]) + "\n")
    return {"path": str(file), "source": source, "type": suffix}


class Broken(RuntimeError):
    pass


def break_at(monkeypatch, nth, after):
    """Let the nth write into the tables' folder fail, before or after it is done."""
    count = iter(range(10_000))
    for name in ("parquet", "json"):
        def write(self, path, *args, _real=getattr(DataFrameWriter, name), **named):
            if "/tables/" not in path:
                return _real(self, path, *args, **named)
            hit = next(count) == nth
            if hit and not after:
                raise Broken
            _real(self, path, *args, **named)
            if hit:
                raise Broken

        monkeypatch.setattr(DataFrameWriter, name, write)


def state(spark, folder):
    envelopes = ledger.read(spark, folder, "envelopes").collect()
    texts = ledger.read(spark, folder, "text").collect()
    quarantine = ledger.read(spark, folder, "quarantine").collect()
    return (
        sorted(e.id for e in envelopes), sorted(e.raw_data for e in envelopes), sorted(t.id for t in texts), sorted(q.id for q in quarantine),
        sorted((e.id, e.kind, e.role) for e in ledger.read(spark, folder, "embeddings").select("id", "kind", "role").collect()))


def quick_parse(envelopes, find_mentions=None):
    """Stands in for the parsers, whose plans take most of the time of a run on a few rows."""
    empty = "cast(array() as array<struct<title: string>>)"
    return envelopes.selectExpr(
        "id", "source", "kind", "case when startswith(raw_data, 'broken') then 'not valid JSON' end as error", "raw_data as text", "raw_data as name", "'' as email",
        "'' as linkedin", "'' as title", "'' as company", "'' as location", "cast(array() as array<string>) as skills", f"{empty} as experience", f"{empty} as education",
        "0 as total_experience")


def quick_vectors(rows, name, is_query):
    return rows.selectExpr("id", "text", "array(1f) as embedding")


# Twelve writes: the data and the commit of six tables.
@pytest.mark.parametrize("nth", [0, 1, 2, 3, 6, 11])
def test_a_broken_run_is_completed_with_the_same_or_other_input(spark, tmp_path, monkeypatch, nth):
    monkeypatch.setattr(onboarding, "parse", quick_parse)
    monkeypatch.setattr(onboarding.E, "embed_texts", quick_vectors)
    folder = str(tmp_path / "tables")
    first = described(tmp_path, ["ann", "bob"], broken=1)
    other = described(tmp_path, ["bob", "cid"], broken=2)
    with monkeypatch.context() as patched:
        break_at(patched, nth, after=nth % 3 == 0)
        with pytest.raises(Broken):
            onboarding.onboard(spark, [first], folder)
    again = [first] if nth % 2 else [other]
    onboarding.onboard(spark, again, folder)
    onboarding.onboard(spark, [other, first], folder)
    ids, contents, texts, quarantine, vectors = state(spark, folder)
    assert len(ids) == len(set(ids)) == 5 and ids == [f"A{i}" for i in range(1, 6)]
    assert len(set(contents)) == 5
    assert len(quarantine) == len(set(quarantine)) == 2 and sorted(texts + quarantine) == ids
    assert vectors == sorted((i, "cv", r) for i in texts for r in ("passage", "query"))


def test_repeated_input_makes_no_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(onboarding, "parse", quick_parse)
    folder = str(tmp_path / "tables")
    first = described(tmp_path, ["ann", "bob"], broken=1)
    onboarding.onboard(spark, [first], folder)
    before = ledger.live(spark, folder)
    onboarding.onboard(spark, [first, {"path": str(tmp_path / "none"), "source": "x", "type": "jsonl"}], folder)
    assert ledger.live(spark, folder) == before


def test_removed_folders_are_not_read(spark, tmp_path):
    folder = str(tmp_path)
    for run in (1, 2, 3):
        spark.range(run).write.parquet(f"{folder}/t/run={run}")
    assert ledger.read(spark, folder, "t") is None
    ledger.commit(spark, folder, 1, {"t": "t/run=1"})
    assert ledger.read(spark, folder, "t").count() == 1
    ledger.commit(spark, folder, 3, {"t": "t/run=3"}, [("t", "t/run=1")])
    assert ledger.read(spark, folder, "t").count() == 3


def test_merged_folders_replace_the_others_in_one_step(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    monkeypatch.setattr(onboarding, "parse", quick_parse)
    for names in (["ann", "bob"], ["cid"], ["dan", "eve"]):
        onboarding.onboard(spark, [described(tmp_path, names, broken=1)], folder)
    before = state(spark, folder)
    held = ledger.read(spark, folder, "text")
    with monkeypatch.context() as patched:
        break_at(patched, 1, after=False)  # the folder is written, the commit is not
        with pytest.raises(Broken):
            ledger.compact(spark, folder, "text", "kind")
    assert state(spark, folder) == before
    ledger.compact(spark, folder, "text", "kind")
    ledger.compact(spark, folder, "envelopes", "kind")
    assert [(t, len([1 for _, n, _ in ledger.live(spark, folder) if n == t])) for t in ("text", "envelopes", "schema")] == [("text", 1), ("envelopes", 1), ("schema", 3)]
    assert state(spark, folder) == before and held.count() == len(before[2])
    files = [f for f in ledger.read(spark, folder, "text").inputFiles()]
    assert len(files) == 1
    # Onboarding goes on behind merged folders: nothing is written twice, numbers go on.
    onboarding.onboard(spark, [described(tmp_path, ["ann", "fay"], broken=1)], folder)
    after = state(spark, folder)
    assert len(after[0]) == len(set(after[0])) == len(before[0]) + 1 and len(set(after[1])) == len(after[1])


def test_merging_needs_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'A', 'B') as kind").repartition(20).write.partitionBy("kind").parquet(path)
    with ledger.packed_scans(spark, 64 << 20):
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() == 1
    merged = ST.compact_tables(spark, path, str(tmp_path / "few"))
    assert merged.count() == 1000 and len(merged.inputFiles()) == 2
    with ledger.packed_scans(spark, 20_000):
        assert 1 < spark.read.parquet(path).rdd.getNumPartitions() < 40
