"""The two main flows: take described files into the tables, and match new documents against them.

Tables below one folder: ``envelopes``, ``schema``, ``text``, ``info``, ``quarantine`` and ``embeddings``, a subfolder a run.

The numbered envelopes of a run are committed first, which reserves their ids and contents. The other tables follow, each committed by itself. A
run that broke off is completed from its envelopes when the next one starts, whatever that one's input is: what wasn't committed is written again in
place, what was is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.operators import embedding as E
from talentweave.operators import identity as I
from talentweave.operators import matching as M
from talentweave.operators import render as R
from talentweave.operators import restructure as J
from talentweave.operators import routing as Q
from talentweave.operators.dataset_text import parse_resume_dataset
from talentweave.operators.free_text import parse_resume_text, section_mentions
from talentweave.operators.lines import LabelSections
from talentweave.operators.profile import parse_resume_profile
from talentweave.schemas import POSTING_CSV
from talentweave.session import fresh_path
from talentweave.sources import ledger
from talentweave.sources.readers import ingest_union


FindMentions = Callable[[DataFrame], DataFrame]


def _parse_postings(df: DataFrame) -> DataFrame:
    rows = Q.parse_or_error(df, "raw_data", POSTING_CSV).select("id", "source", "error", "record.*")
    return J.schematize_posting(rows)


def _parse_json(df: DataFrame) -> DataFrame:
    return J.resume_json_to_schema(df.select("id", "source", "raw_data"))


def _parse_free_text(df: DataFrame, find_mentions: FindMentions | None = None, label_sections: LabelSections | None = None) -> DataFrame:
    docs = df.select(F.col("id").alias("doc_id"), "source", F.col("raw_data").alias("text"))
    mentions = None if find_mentions is None else section_mentions(docs, find_mentions)
    return parse_resume_text(docs, mentions=mentions, label_sections=label_sections).withColumnRenamed("doc_id", "id")


def _parse_dataset(df: DataFrame) -> DataFrame:
    return parse_resume_dataset(df.select(F.col("id").alias("doc_id"), "source", F.col("raw_data").alias("text"))).withColumnRenamed("doc_id", "id")


def _parse_profile(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Profiles from their text boxes ``(doc_id, pdf_page, x0, y1, seq, text)``, ``doc_id`` being the id of the envelope."""
    own = df.select(F.col("id").alias("doc_id"), "source")
    parsed = parse_resume_profile(boxes.join(own.select("doc_id"), "doc_id", "left_semi"))
    # An envelope without boxes is one whose layout could not be read.
    missing = F.when(F.col("experience").isNull(), F.lit("Could not parse PDF layout"))
    return own.join(parsed, "doc_id", "left").withColumn("error", F.coalesce("error", missing)).withColumnRenamed("doc_id", "id")


PARSERS = {"posting": _parse_postings, "json": _parse_json, "text": _parse_free_text, "dataset": _parse_dataset}


def parse(
    envelopes: DataFrame, find_mentions: FindMentions | None = None, boxes: DataFrame | None = None,
    label_sections: LabelSections | None = None,
) -> DataFrame:
    """Envelopes of all routes in one table with feature text; failed records have an ``error``.

    ``boxes`` are the text boxes of profile exports; without them that route has no parser. Each parser is planned once; kind and error
    decide in the row what its text is.
    """
    parsers = PARSERS | {"text": lambda df: _parse_free_text(df, find_mentions, label_sections)}
    if boxes is not None:
        parsers |= {"profile": lambda df: _parse_profile(df, boxes)}
    rows = Q.parse_by_route(envelopes, parsers).withColumn("kind", F.left("id", F.lit(1)))
    no_kind = F.when(~F.coalesce(F.col("kind"), F.lit("")).isin("A", "B"), F.lit("No kind in the id"))
    text = F.when(F.col("kind") == "B", R.posting_text()).when(F.col("kind") == "A", R.resume_text())
    return rows.withColumns({"error": F.coalesce("error", no_kind), "text": text})


def _keep(df: DataFrame, folder: str, run: int, table: str, *partition: str) -> None:
    """Write a run's part of a table and commit it. What an attempt before left in the place is replaced."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{folder}/{table}/run={run}")
    ledger.commit(df.sparkSession, folder, run, {table: f"{table}/run={run}"})


def _outputs(parsed: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """The tables made from parsed envelopes, with their partition columns."""
    done, failed = Q.split_errors(parsed)
    common = ["title", "company", "location", "skills", "experience", "education", "total_experience"]
    vectors = [
        E.embed_texts(done.where(F.col("kind") == kind), name, is_query)
        .drop("kind", "role").withColumns({"kind": F.lit(name), "role": F.lit("query" if is_query else "passage")})
        for kind, name in (("A", "cv"), ("B", "job")) for is_query in (True, False)
    ]
    embedded = vectors[0]
    for more in vectors[1:]:
        embedded = embedded.unionByName(more)
    return {
        "quarantine": (failed.select("id", "source", "error"), []),
        "schema": (done.select("id", "source", "kind", *common), ["kind"]),
        "text": (Q.project_text(done).withColumn("kind", F.left("id", F.lit(1))), ["kind"]),
        "info": (Q.project_personal_info(done.where("kind = 'A'")), []),
        "embeddings": (embedded, ["kind", "role"]),
    }


TABLES = ["quarantine", "schema", "text", "info", "embeddings"]


def complete(
    spark: SparkSession, folder: str, find_mentions: FindMentions | None = None, boxes: DataFrame | None = None,
    label_sections: LabelSections | None = None,
) -> list[int]:
    """Write what the runs with committed envelopes still lack; gives the numbers of the runs that lacked something."""
    more = {name: x for name, x in [("boxes", boxes), ("label_sections", label_sections)] if x is not None}
    there = ledger.written(spark, folder)
    lacking = {run: [t for t in TABLES if (run, t) not in there] for run, name in sorted(there) if name == "envelopes"}
    for run, tables in lacking.items():
        if not tables:
            continue
        parsed_path = fresh_path(spark, "parsed")
        parse(spark.read.parquet(f"{folder}/envelopes/run={run}"), find_mentions, **more).write.parquet(parsed_path)
        outputs = _outputs(spark.read.parquet(parsed_path))
        for table in tables:
            df, partition = outputs[table]
            _keep(df, folder, run, table, *partition)
    return [run for run, tables in lacking.items() if tables]


def onboard(
    spark: SparkSession, descriptors: list[dict], folder: str, find_mentions: FindMentions | None = None, boxes: DataFrame | None = None,
    label_sections: LabelSections | None = None,
) -> None:
    """Read, number, de-duplicate against what is there, parse and append; a repeated file adds nothing.

    ``find_mentions`` gives mentions ``(doc_id, start, kind, value)`` of the sections ``(doc_id, text)`` of free-form résumés;
    ``boxes`` the text boxes of profile exports by id; ``label_sections`` names sections of free-form résumés whose heading says nothing.
    """
    complete(spark, folder, find_mentions, boxes, label_sections)
    landed = fresh_path(spark, "landed")
    # Written first: the position of a record is part of the files and must not change between the steps.
    ingest_union(spark, descriptors).withColumn("position", F.monotonically_increasing_id()).write.parquet(landed)
    seen = ledger.read(spark, folder, "envelopes")
    fresh = I.dedup_content(spark.read.parquet(landed), "position")
    if seen is not None:
        known = seen.select("content_hash").where("content_hash is not null")
        fresh = fresh.join(known, "content_hash", "left_anti")
    deduplicated = fresh_path(spark, "fresh")
    fresh.write.parquet(deduplicated)
    fresh = spark.read.parquet(deduplicated)
    if fresh.isEmpty():
        return
    run = ledger.next_run(spark, folder)
    numbered = I.assign_doc_ids(fresh, "position", None if seen is None else seen.select("kind", "num"))
    _keep(numbered.drop("position", "error"), folder, run, "envelopes", "kind")
    complete(spark, folder, find_mentions, boxes, label_sections)


def match(
    spark: SparkSession, folder: str, query_kind: str, ids: DataFrame | None = None, k: int = K.DEFAULT_K
) -> DataFrame:
    """Matches of the given documents (the newest one by default) in the other kind.

    ``(query_id, id, match_text, score, rank)``; with a posting as query also the contact data of the résumés.
    """
    vectors = ledger.read(spark, folder, "embeddings").withColumn("num", M.id_number(F.col("id")))
    own, other = ("cv", "job") if query_kind == K.RESUME_PREFIX else ("job", "cv")
    other_kind = K.POSTING_PREFIX if query_kind == K.RESUME_PREFIX else K.RESUME_PREFIX
    if ids is None:
        envelopes = ledger.read(spark, folder, "envelopes").where(F.col("kind") == query_kind)
        ids = I.latest_document(envelopes.select("kind", "num")).select("id")
    asked = vectors.where((F.col("kind") == own) & (F.col("role") == "query")).join(ids.select("id"), "id", "left_semi")
    stored = vectors.where((F.col("kind") == other) & (F.col("role") == "passage"))
    hits = M.knn(asked, stored, k).select(
        M.id_from_number(query_kind, F.col("query_num")).alias("query_id"),
        M.id_from_number(other_kind, F.col("match_num")).alias("id"), F.col("sim").alias("score"), "rank",
    )
    texts = ledger.read(spark, folder, "text").where(F.col("kind") == other_kind).select("id", F.col("text").alias("match_text"))
    found = hits.join(texts, "id", "left")
    if query_kind == K.POSTING_PREFIX:
        found = M.attach_personal_info(found, ledger.read(spark, folder, "info").drop("source", "run"))
    return found
