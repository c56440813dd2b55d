"""One query per operator over the base tables; the keys are the names of the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.functions import dataset_text as DT

from talentweave.functions import text as T
from talentweave.functions.levels import experience_level, gap_penalty
from talentweave.operators import analytics as A
from talentweave.operators import dataset_text as XD
from talentweave.operators import dates as D
from talentweave.operators import embedding as E
from talentweave.operators import free_text as XT
from talentweave.operators import identity as I
from talentweave.operators import lines as L
from talentweave.operators import matching as M
from talentweave.operators import mentions as N
from talentweave.operators import profile as P
from talentweave.operators import render as R
from talentweave.operators import restructure as J
from talentweave.operators import routing as Q
from talentweave.operators import scoring as S
from talentweave.plans import funnel
from talentweave.plans.views import Views
from talentweave.schemas import TEXT_DATA
from talentweave.session import PACKED, fresh_path, landed_once, written_once
from talentweave.sources import readers as SR
from talentweave.sources import tables as ST
from talentweave.sources.files import write_text_files
from talentweave.streaming import intake as SP

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def digest(c: Column | str) -> Column:
    return F.md5(F.col(c) if isinstance(c, str) else c).alias("digest")


# --- inputs derived from the base tables


def documents(v: Views) -> DataFrame:
    return v.texts("documents")


def envelopes(v: Views) -> DataFrame:
    """Documents as envelopes, with all kinds of source, type and category."""
    n = F.col("doc_id") % 9
    category = F.when(n % 3 == 0, "job").otherwise("cv")
    source = (
        F.when(n == 1, "new_texts").when(n == 2, "linkedin_pdf").when(n == 4, "string_dataset")
        .when(n == 5, "json_dataset").when(n == 0, "jobs_dataset").otherwise("other")
    )
    type_ = F.when(n == 7, "txt").when(n == 8, "pdf").when(n == 4, "csv").otherwise("jsonl")
    return documents(v).select(
        F.concat(I.kind_of(category), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("raw_data"),
        source.alias("source"), type_.alias("type"), category.alias("category"), "doc_id",
    )


def posting_rows(v: Views) -> DataFrame:
    """Raw posting rows; skills are the text of a list or of a dict."""
    quoted = F.transform("skills", lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    listed = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    place = F.split("location", ", ")
    return v.written("posting_record").select(
        "num", "id", F.col("title").alias("job_title_short"), F.col("company").alias("company_name"),
        F.get(place, F.lit(0)).alias("job_location"),
        F.when(F.get(place, F.lit(1)) != "ASIA", F.get(place, F.lit(1))).alias("job_country"),
        listed.alias("job_skills"),
        F.when(F.size("skills") > 1, F.concat(F.lit("{'parts': "), listed, F.lit(", 'extra': ['teamwork']}"))).alias("job_type_skills"),
    )


def resume_pages(v: Views) -> DataFrame:
    return v.written_texts("resume_page")


def page_records(v: Views) -> DataFrame:
    """Résumé pages in the common schema."""
    return resume_pages(v).select(
        F.concat(F.lit("A"), "doc_id").alias("id"), "doc_id", F.lit("json_dataset").alias("source"),
        F.element_at("jobs", 1)["title"].alias("title"), "location", "skills",
        F.transform("jobs", lambda j: F.struct(
            j["title"].alias("title"), j["company"].alias("company"), j["period"].alias("period"),
            F.lit("Unknown").alias("location"), F.lit("").alias("description"),
        )).alias("experience"),
        F.array(F.struct(
            F.col("edu_year").cast("string").alias("period"), F.lit("Institution Not Found").alias("institution"),
            F.lit("Bachelor").alias("degree"), F.lit("").alias("details"),
        )).alias("education"),
        F.size("jobs").alias("total_experience"),
    )


def resume_text(v: Views) -> DataFrame:
    return v.written_texts("resume_text")


def dataset_text(v: Views) -> DataFrame:
    return v.written_texts("dataset_text")


def profile_lines(v: Views, side: str) -> DataFrame:
    return P.column_lines(v.written_texts("profile_box")).where(F.col("side") == side).select("doc_id", "pos", "line")


def dataset_terms(v: Views) -> DataFrame:
    part = v.base("part").select(F.initcap("p_name").alias("term"), F.lit("TITLE").alias("kind"))
    firm = v.base("supplier").select(F.col("s_name").alias("term"), F.lit("COMPANY").alias("kind"))
    school = v.base("region").select(F.concat(F.lit("University of "), F.initcap("r_name")).alias("term"), F.lit("SCHOOL").alias("kind"))
    return part.unionByName(firm).unionByName(school).distinct()


def corpus(v: Views) -> funnel.Corpus:
    """Tables of both sides, as they stand once the intake has run."""
    level = experience_level(F.col("total_experience"))
    return funnel.Corpus(
        cv_vec=v.profile_vec(), job_vec=v.posting_vec(), cv_skill=v.written("profile_skill"), job_skill=v.written("posting_skill"),
        cv_title=v.written("profile_title"), job_title=v.written("posting").select("num", "title"),
        cv_text=v.written("profile").select("num", F.concat(F.lit("with experience ("), level, F.lit(")")).alias("text")),
        job_text=v.written("posting").select("num", F.concat_ws(" ", "title", "level_phrase").alias("text")),
        synonyms=v.written("occupation"),
    )


def candidate_pairs(v: Views) -> DataFrame:
    """Top-50 résumés per posting, written once for the queries that score them."""
    return written_once(v.spark, v.sf_dir, "candidates", lambda: funnel.candidates(corpus(v), False))


# --- sources


def _landed_jsonl(v: Views) -> str:
    rows = documents(v).select("doc_id", "text", "lang")
    return landed_once(v.spark, v.sf_dir, "documents-jsonl", lambda p: rows.write.json(p))


@query
def read_jsonl(v: Views) -> DataFrame:
    rows = SR.read_jsonl(v.spark, _landed_jsonl(v), "doc_id bigint, text string, lang string")
    return rows.where(F.col(SR.CORRUPT).isNull()).select("doc_id", "lang", F.length("text").alias("n"), digest("text"))


def _landed_json_docs(v: Views) -> str:
    """Files with one list of up to 100 objects each."""
    lists = (
        documents(v).groupBy(F.expr("doc_id div 100").alias("file"))
        .agg(F.to_json(F.collect_list(F.struct("doc_id", "source", "n_chars"))).alias("value")).select("value")
    )
    return landed_once(v.spark, v.sf_dir, "documents-json", lambda p: lists.write.option("maxRecordsPerFile", 1).text(p))


@query
def read_json_doc(v: Views) -> DataFrame:
    rows = SR.read_json_doc(v.spark, _landed_json_docs(v), "doc_id bigint, source string, n_chars bigint")
    return rows.select("doc_id", "source", "n_chars")


def _landed_csv(v: Views) -> str:
    rows = documents(v).select("doc_id", F.col("text").alias(K.DEFAULT_CSV_COLUMN))
    options = {"header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return landed_once(v.spark, v.sf_dir, "documents-csv", lambda p: rows.write.options(**options).csv(p))


@query
def read_csv_column(v: Views) -> DataFrame:
    rows = SR.read_csv_column(v.spark, _landed_csv(v))
    return rows.select(digest("raw_data"), F.length("raw_data").alias("n"))


@query
def read_posting_csv(v: Views) -> DataFrame:
    rows = posting_rows(v).drop("num", "id")
    path = landed_once(v.spark, v.sf_dir, "postings-csv", lambda p: rows.write.options(header="true", escape='"').csv(p))
    return SR.read_posting_csv(v.spark, path)


def _landed_pages(v: Views) -> str:
    """One text file per page, made by all cores, however few row groups the table has."""
    rows = v.texts("pages").select(F.col("page_id").alias("key"), F.col("html").alias("value"))
    return landed_once(v.spark, v.sf_dir, "pages-txt", lambda p: write_text_files(rows, p))


@query
def read_text_files(v: Views) -> DataFrame:
    rows = SR.read_text_files(v.spark, _landed_pages(v))
    return rows.select(digest("raw_data"), F.length("raw_data").alias("n"))


@query
def read_binary_base64(v: Views) -> DataFrame:
    rows = SR.read_binary_base64(v.spark, _landed_pages(v))
    return rows.select(digest("raw_data"), F.length("raw_data").alias("n"))


@query
def ingest_union(v: Views) -> DataFrame:
    rows = SR.ingest_union(v.spark, [
        {"path": _landed_jsonl(v), "source": "json_dataset", "type": "jsonl"},
        {"path": _landed_json_docs(v), "source": "jobs_dataset", "type": "json", "category": "job"},
        {"path": _landed_csv(v), "source": "string_dataset", "type": "csv", "col": K.DEFAULT_CSV_COLUMN},
        {"path": _landed_pages(v), "source": "new_texts", "type": "txt"},
        {"path": _landed_jsonl(v) + "-missing", "source": "gone", "type": "jsonl"},
        {"path": _landed_jsonl(v), "source": "odd", "type": "docx"},
    ])
    key = F.when(F.col("type").isin("json", "jsonl"), F.get_json_object("raw_data", "$.doc_id")).otherwise(F.md5("raw_data"))
    return rows.select("source", "type", "category", key.alias("record"))


def _landed_messages(v: Views) -> str:
    rows = ST.producer_to_topic(envelopes(v))
    return landed_once(v.spark, v.sf_dir, "messages", lambda p: rows.write.parquet(p))


def _run_to_table(v: Views, stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there, then read the table the stream wrote."""
    out, checkpoint = fresh_path(v.spark, name), fresh_path(v.spark, f"{name}-checkpoint")
    run = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


@query
def stream_source(v: Views) -> DataFrame:
    rows = _run_to_table(v, SP.stream_source(v.spark, _landed_messages(v)), "stream-source")
    return rows.select("topic", "key", digest(F.get_json_object("value", "$.raw_data")))


@query
def decode_envelope(v: Views) -> DataFrame:
    rows = ST.decode_envelope(ST.producer_to_topic(envelopes(v)).select(F.col("value").cast("binary").alias("value")))
    return rows.select("id", "source", "type", "category", digest("raw_data"))


def _landed_texts(v: Views) -> str:
    rows = Q.project_text(envelopes(v).withColumnRenamed("raw_data", "text"))
    return landed_once(v.spark, v.sf_dir, "texts", lambda p: ST.append_partitioned(rows, p))


@query
def read_table_partitions(v: Views) -> DataFrame:
    rows = ST.read_table_partitions(v.spark, _landed_texts(v), "A", TEXT_DATA)
    return rows.select("id", "source", digest("text"), "text_length")


# --- identity


@query
def assign_doc_ids(v: Views) -> DataFrame:
    rows = envelopes(v).select("doc_id", "category")
    existing = v.spark.range(1).select(F.lit("A").alias("kind"), F.lit(7303).cast("bigint").alias("num"))
    return I.assign_doc_ids(rows, "doc_id", existing).select("doc_id", "kind", "num", "id")


@query
def content_hash(v: Views) -> DataFrame:
    return I.content_hash(documents(v), "text").select("doc_id", "content_hash")


@query
def dedup_content(v: Views) -> DataFrame:
    return I.dedup_content(documents(v), "doc_id", "text").select("doc_id", "content_hash")


@query
def dedup_content_stream(v: Views) -> DataFrame:
    with _rocksdb(v.spark):
        rows = SP.dedup_content_stream(ST.decode_envelope(SP.stream_source(v.spark, _landed_messages(v))))
        return _run_to_table(v, rows.select("content_hash"), "dedup")


class _rocksdb:
    """Disk-backed streaming state while the block runs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY)
        SP.use_rocksdb(self.spark)

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.before)


@query
def latest_document(v: Views) -> DataFrame:
    cv = v.profile().select(F.lit("A").alias("kind"), "num")
    job = v.posting().select(F.lit("B").alias("kind"), "num")
    return I.latest_document(cv.unionByName(job)).select("kind", "num", "id")


@query
def upsert_documents(v: Views) -> DataFrame:
    rows = documents(v).select(F.col("doc_id").cast("string").alias("id"), "lang", digest("text"))
    base = rows.where("lang = 'en'").withColumn("origin", F.lit("base"))
    once = I.upsert_documents(base, rows.withColumn("origin", F.lit("new")))
    again = I.upsert_documents(once, rows.withColumn("origin", F.lit("again")))
    return again.select("id", "digest", "origin")


@query
def distinct_in_order(v: Views) -> DataFrame:
    words = I.distinct_in_order(F.split("text", " "))
    return documents(v).select("doc_id", F.size(words).alias("n"), digest(F.array_join(words, " ")))


@query
def dedup_education(v: Views) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    rows = v.sel_lines().select(
        F.col("num").alias("doc_id"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        name.alias("institution"), F.split("p_name", " ")[0].alias("degree"),
    )
    return I.dedup_education(rows).select("doc_id", "pos", "institution", "degree")


def _word_mentions(v: Views) -> DataFrame:
    """Every word of every window as a mention; words in two windows occur twice."""
    windows = N.token_windows(documents(v), N.spaced_words(F.col("text")))
    return _windows_to_mentions(windows)


def _windows_to_mentions(windows: DataFrame) -> DataFrame:
    pairs = F.zip_with("starts", "tokens", lambda at, token: F.struct(at.alias("start"), F.rtrim(token).alias("value")))
    rows = N.token_starts(windows).select("doc_id", F.explode(pairs).alias("m")).select("doc_id", "m.*").where("value is not null")
    kind = F.when(F.length("value") > 4, "LONG").otherwise("SHORT")
    return rows.select("doc_id", "start", (F.col("start") + F.length("value")).alias("end"), kind.alias("kind"), "value")


@query
def dedup_mentions(v: Views) -> DataFrame:
    rows = I.dedup_mentions(_word_mentions(v))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


# --- projections, filters, routing


@query
def blank_placeholders(v: Views) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "error", "Unknown").when(F.col("event_type") == "view", "NOT provided")
        .when(F.col("event_type") == "signup", None).otherwise(F.col("event_type"))
    )
    return Q.blank_placeholders(v.base("events").select("event_id", kind.alias("kind")), ["kind"])


@query
def join_nonempty(v: Views) -> DataFrame:
    rows = v.base("customer").join(v.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("n_name"))
    country = F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment"))
    return rows.select("c_custkey", T.join_present(", ", city, country).alias("location"))


@query
def route_parser(v: Views) -> DataFrame:
    return Q.route_parser(envelopes(v)).select("id", "route")


def _json_and_text(v: Views) -> DataFrame:
    events = v.base("events").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("raw"))
    texts = documents(v).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("raw"))
    return events.unionByName(texts)


@query
def split_errors(v: Views) -> DataFrame:
    good, bad = Q.split_errors(Q.parse_or_error(_json_and_text(v), "raw", "k int"))
    return good.select("id", F.lit("good").alias("side"), "record.k").unionByName(
        bad.select("id", F.lit("bad").alias("side"), F.lit(None).cast("int").alias("k"))
    )


@query
def split_kind(v: Views) -> DataFrame:
    rows = ST.with_kind(envelopes(v))
    cvs, jobs = Q.split_kind(rows)
    return cvs.select("id", F.lit("cv").alias("side")).unionByName(jobs.select("id", F.lit("job").alias("side")))


@query
def project_schema_cv(v: Views) -> DataFrame:
    return Q.project_schema_cv(page_records(v))


@query
def project_schema_job(v: Views) -> DataFrame:
    rows = v.written("posting_record").withColumn("key", F.col("id")).withColumn("id", F.when(F.col("num") % 2 == 0, F.col("id")))
    return Q.project_schema_job(rows.withColumn("source", F.lit("jobs_dataset")))


@query
def project_text(v: Views) -> DataFrame:
    rows = Q.project_text(envelopes(v).withColumnRenamed("raw_data", "text"))
    return rows.select("id", "source", digest("text"), "text_length")


@query
def project_personal_info(v: Views) -> DataFrame:
    rows = v.profile().withColumns({"source": F.lit("json_dataset"), "linkedin": F.lit("")})
    return Q.project_personal_info(rows)


# --- nested JSON


def resume_json_rows(v: Views) -> DataFrame:
    return v.written_texts("resume_json")


@query
def resume_json_personal(v: Views) -> DataFrame:
    rows = J.resume_json_personal(J.parse_resume_json(resume_json_rows(v)))
    return rows.select("doc_id", "name", "linkedin", "email", "location")


@query
def resume_json_experience(v: Views) -> DataFrame:
    rows = J.resume_json_experience(J.parse_resume_json(resume_json_rows(v)))
    items = rows.select("doc_id", F.col("title").alias("headline"), "total_experience", F.posexplode("experience").alias("pos", "j"))
    return items.select("doc_id", "headline", "total_experience", "pos", "j.title", "j.company", "j.period", "j.description")


@query
def resume_json_education(v: Views) -> DataFrame:
    rows = J.resume_json_education(J.parse_resume_json(resume_json_rows(v)))
    return rows.select("doc_id", F.explode("education").alias("e")).select("doc_id", "e.*")


@query
def resume_json_skills(v: Views) -> DataFrame:
    rows = J.resume_json_skills(J.parse_resume_json(resume_json_rows(v)))
    return rows.select("doc_id", F.explode("skills").alias("skill"))


@query
def resume_json_to_schema(v: Views) -> DataFrame:
    rows = J.resume_json_to_schema(resume_json_rows(v))
    return rows.where("error is null").select(
        "doc_id", "title", "location", F.size("experience").alias("n_jobs"), F.size("skills").alias("n_skills"),
        F.size("education").alias("n_schools"), "total_experience",
    )


@query
def schematize_posting(v: Views) -> DataFrame:
    rows = J.schematize_posting(posting_rows(v))
    return rows.select("num", "title", "category", "company", "location", F.array_join(F.array_sort("skills"), ",").alias("skills"))


@query
def parse_list_literal(v: Views) -> DataFrame:
    rows = posting_rows(v)
    one = rows.select("num", F.lit("list").alias("form"), F.explode(J.parse_list_literal(F.col("job_skills"))).alias("skill"))
    two = rows.select("num", F.lit("dict").alias("form"), F.explode(J.parse_list_literal(F.col("job_type_skills"))).alias("skill"))
    return one.unionByName(two)


@query
def merge_skill_sets(v: Views) -> DataFrame:
    grouped = v.sel_lines().groupBy("o_orderkey").agg(
        F.collect_set(F.when(F.col("l_quantity") >= 25, F.col("p_brand"))).alias("big"),
        F.collect_set(F.when(F.col("l_quantity") < 30, F.col("p_brand"))).alias("small"),
    )
    merged = J.merge_skill_sets(F.col("big"), F.create_map(F.lit("small"), F.col("small"), F.lit("none"), F.array(F.lit(None).cast("string"))))
    return grouped.select("o_orderkey", F.size(merged).alias("n"), F.array_join(F.array_sort(merged), ",").alias("skills"))


@query
def explode_skills(v: Views) -> DataFrame:
    rows = v.written("posting_record").withColumn("skills", F.array_append("skills", F.lit("")))
    return J.explode_skills(rows).select("num", "skill")


# --- rendering


@query
def render_posting_text(v: Views) -> DataFrame:
    return R.render_posting_text(v.written("posting_record")).select("num", "text")


def _levels(v: Views) -> DataFrame:
    return v.profile().select("num", "total_experience", experience_level(F.col("total_experience")).alias("level"))


QUERIES["experience_level"] = _levels


@query
def render_resume_text(v: Views) -> DataFrame:
    return R.render_resume_text(page_records(v)).select("id", "text")


@query
def squeeze_whitespace(v: Views) -> DataFrame:
    return documents(v).select("doc_id", digest(T.squeeze(F.col("text"))))


@query
def role_prefix(v: Views) -> DataFrame:
    rows = documents(v).select("doc_id", "text")
    asked = R.role_prefix(rows, True).select("doc_id", F.lit("query").alias("role"), digest("text"))
    stored = R.role_prefix(rows, False).select("doc_id", F.lit("passage").alias("role"), digest("text"))
    return asked.unionByName(stored)


# --- text extraction


@query
def normalize_chars(v: Views) -> DataFrame:
    rows = documents(v).select("doc_id", F.concat(F.lit("e\u0301 \u2013 \u2014\u00a0"), "text").alias("text"))
    return L.normalize_chars(rows).select("doc_id", digest("text"))


@query
def clean_lines(v: Views) -> DataFrame:
    rows = documents(v).select("doc_id", F.concat_ws("\n", F.lit(" Lingua inglese, Tedesco \n\npage 2 of 10\n"), "text").alias("text"))
    return L.clean_lines(rows).select("doc_id", "pos", digest("line"))


@query
def assemble_columns(v: Views) -> DataFrame:
    return L.assemble_columns(v.written_texts("profile_box")).select("doc_id", "side", digest("text"))


@query
def slice_sections_dataset(v: Views) -> DataFrame:
    return L.slice_sections_dataset(dataset_text(v)).select("doc_id", "section", digest("content"))


@query
def slice_sections_text(v: Views) -> DataFrame:
    return L.slice_sections_text(resume_text(v)).select("doc_id", "section", "heading", digest("content"))


@query
def classify_section_fallback(v: Views) -> DataFrame:
    rows = documents(v).select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("content"))
    return L.classify_section_fallback(rows).select("doc_id", "section")


@query
def profile_left_column(v: Views) -> DataFrame:
    rows = P.profile_left_column(profile_lines(v, "left"))
    return rows.select("doc_id", "email", "linkedin", F.array_join("skills", ",").alias("skills"))


@query
def profile_right_column(v: Views) -> DataFrame:
    right = P.profile_right_column(profile_lines(v, "right"))
    return right.select(
        "doc_id", "name", "title", "location", "summary", F.size("experience").cast("long").alias("n_experience"),
        F.size("education").cast("long").alias("n_education"),
    )


@query
def extract_date_ranges(v: Views) -> DataFrame:
    docs = resume_text(v)
    found = D.extract_date_ranges(docs).join(docs, "doc_id")
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("doc_id", "pos", "period", (cut == F.col("period")).alias("in_place"))


@query
def filter_date_mentions(v: Views) -> DataFrame:
    story = F.concat("text", F.lit(".  Since 1999 and in 2001  Rome, 1985 was fine, 1950  Old, 2003 Managed it, 2004  End"))
    return D.filter_date_mentions(dataset_text(v).withColumn("text", story)).select("doc_id", "pos", "period")


@query
def total_experience_years(v: Views) -> DataFrame:
    items = resume_pages(v).select("doc_id", F.explode("jobs").alias("j")).select("doc_id", F.col("j.pos").alias("pos"), F.col("j.y").alias("y"))
    closed = items.select("doc_id", F.concat_ws(" - ", F.col("y").cast("string"), (F.col("y") + 1).cast("string")).alias("period"))
    current = items.select("doc_id", F.concat(F.lit("January "), F.col("y").cast("string"), F.lit(" - Present")).alias("period"))
    single = items.select("doc_id", F.concat(F.lit("May "), F.col("y").cast("string")).alias("period"))
    bare = items.select("doc_id", F.lit("some time").alias("period"))
    parts = [
        ("text", closed), ("text_bare", bare), ("dataset", current), ("dataset_bare", bare), ("profile", single), ("profile_closed", closed)
    ]
    out = None
    for name, rows in parts:
        one = D.total_experience_years(rows, name.split("_")[0]).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("doc_id", "variant", "total_experience")


@query
def professional_title(v: Views) -> DataFrame:
    free = XT.professional_title_text(resume_text(v)).withColumn("variant", F.lit("text"))
    run_on = XD.professional_title_dataset(dataset_text(v)).withColumn("variant", F.lit("dataset"))
    return free.unionByName(run_on).select("doc_id", "variant", "title")


@query
def link_title_company(v: Views) -> DataFrame:
    docs = dataset_text(v)
    mentions = N.extract_mentions(docs, dataset_terms(v), longest=4, original_offsets=True)
    linked = XD.link_title_company(XD.job_dates(docs), mentions)
    return linked.select("doc_id", "pos", F.col("title.value").alias("title"), F.col("company.value").alias("company"), F.col("match").alias("period"))


def _bare_text(v: Views) -> DataFrame:
    """Résumés whose jobs have no separator: only mentions tell titles and companies."""
    job = lambda j: F.concat_ws("\n", j["title"], j["company"], j["period"], F.lit("Worked on many things there together with a large and kind team."))
    text = F.concat(F.lit("Name\nWORK EXPERIENCE\n"), F.array_join(F.transform("jobs", job), "\n"))
    return resume_pages(v).select("doc_id", text.alias("text"))


@query
def link_title_company_text(v: Views) -> DataFrame:
    docs = _bare_text(v)
    terms = v.base("part").select(F.col("p_name").alias("term"), F.lit("JOB_TITLE").alias("kind")).distinct().unionByName(
        v.base("supplier").select(F.col("s_name").alias("term"), F.lit("COMPANY_NAME").alias("kind")))
    sections = XT.section_of(docs, "text", "Experience")
    mentions = N.extract_mentions(sections, terms, "section", original_offsets=True)
    return XT.link_title_company_text(docs, mentions).select("doc_id", "pos", "title", "company", "period")


@query
def experience_descriptions(v: Views) -> DataFrame:
    return XT.extract_experience_text(resume_text(v)).select("doc_id", "pos", "title", "company", "period", "description")


@query
def clean_description(v: Views) -> DataFrame:
    unknown = F.struct(F.lit("Unknown").alias("city"), F.lit("Unknown").alias("state"), F.lit("Unknown").alias("raw"))
    raw = F.concat(F.lit(" - Company Name － City , State "), "text")
    return documents(v).select("doc_id", DT.clean_description(raw, F.substring_index("text", " ", 1), unknown).alias("description"))


def _right_section(v: Views, name: str) -> DataFrame:
    return P.section_lines(P.profile_right_column(profile_lines(v, "right")), name)


@query
def profile_experience(v: Views) -> DataFrame:
    return P.profile_experience(_right_section(v, "experience"))


def _assorted_lines(v: Views) -> DataFrame:
    lines = v.sel_lines().select(F.explode(F.array(
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" years 3 months")),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" yards")),
        F.col("s_name"), F.concat_ws(", ", "p_name", "p_brand"), F.concat(F.lit("School of "), "p_name", F.lit(", Milan")),
        F.concat("p_name", F.lit(" near Trento")),
    )).alias("line"))
    return lines


@query
def is_location_line(v: Views) -> DataFrame:
    rows = _assorted_lines(v).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("line", "n", T.is_location_line(F.col("line")).alias("is_place"))


@query
def is_duration_line(v: Views) -> DataFrame:
    rows = _assorted_lines(v).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("line", "n", T.is_duration_line(F.col("line")).alias("is_span"))


@query
def extract_education(v: Views) -> DataFrame:
    docs = dataset_text(v)
    mentions = N.extract_mentions(docs, dataset_terms(v), longest=4, original_offsets=True)
    return XD.extract_education_dataset(docs, mentions=mentions).select("doc_id", "period", "institution", "degree")


@query
def extract_education_text(v: Views) -> DataFrame:
    return XT.extract_education_text(resume_text(v)).select("doc_id", "pos", "period", "institution", "degree")


@query
def profile_education(v: Views) -> DataFrame:
    return P.profile_education(_right_section(v, "education")).select("doc_id", "pos", "institution", "degree", "period")


@query
def extract_certifications(v: Views) -> DataFrame:
    line = lambda j: F.concat(F.lit("Earned the "), j["title"], F.lit(" certificate in "), j["y"].cast("string"))
    text = F.concat(F.lit("Name\n** Certifications **\n"), F.array_join(F.transform("jobs", line), "\n"))
    return XT.extract_certifications(resume_pages(v).select("doc_id", text.alias("text"))).select("doc_id", "pos", "period", "degree")


@query
def tokenize_skills(v: Views) -> DataFrame:
    return XD.tokenize_skills(dataset_text(v)).select("doc_id", "pos", "skill")


@query
def tokenize_skills_text(v: Views) -> DataFrame:
    return XT.tokenize_skills_text(resume_text(v)).select("doc_id", "pos", "skill")


@query
def clean_field(v: Views) -> DataFrame:
    messy = F.concat(F.lit(" - | * "), F.replace("text", F.lit(" the "), F.lit(" - the | ")), F.lit(" ;: "))
    return documents(v).select("doc_id", digest(T.clean_field(messy)))


@query
def extract_contacts(v: Views) -> DataFrame:
    linked = F.concat("text", F.lit(" https://www.LinkedIn.com/in/user_"), F.col("doc_id").cast("string"), F.lit("/ end"))
    return XT.extract_contacts(documents(v).select("doc_id", linked.alias("text")))


@query
def extract_header_location(v: Views) -> DataFrame:
    return XT.extract_header_location(resume_text(v))


@query
def extract_name(v: Views) -> DataFrame:
    return XT.extract_name(resume_text(v))


@query
def extract_job_location(v: Views) -> DataFrame:
    place = F.split(Views.letters(F.initcap("location")), ", ")
    raw = F.concat(F.lit("built "), F.get(place, F.lit(0)), F.lit(" , "), F.get(place, F.lit(1)), F.lit(". and more"))
    rows = v.profile().select(F.col("num").alias("doc_id"), F.lit(0).alias("pos"), F.lit(0).alias("at"), raw.alias("raw"))
    return XD.extract_job_location(rows).select("doc_id", "city", "state", "raw_location")


@query
def chunk_words(v: Views) -> DataFrame:
    return N.chunk_words(documents(v)).select("doc_id", "chunk", "offset", "n_words", digest("text"))


def _benchmark_terms(v: Views) -> DataFrame:
    """All words and all pairs of neighbouring words."""
    words = v.base("benchmark").select(T.words_of(F.col("text")).alias("words"))
    pairs = F.transform(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat(F.get("words", i), F.lit(" "), w))
    return words.select(F.explode(F.concat("words", pairs)).alias("term")).distinct().withColumn("kind", F.lit("TERM"))


@query
def extract_mentions(v: Views) -> DataFrame:
    return N.extract_mentions(documents(v), _benchmark_terms(v)).select("doc_id", "start", "end", "kind", "value")


def address_model():
    """A stand-in for a model: finds e-mail addresses."""
    pattern = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+")

    def predict(texts: list[str]) -> list[list[dict]]:
        return [
            [{"start": m.start(), "end": m.end(), "kind": "EMAIL", "value": m.group(0)} for m in pattern.finditer(t)]
            for t in texts
        ]

    return predict


@query
def extract_mentions_batch(v: Views) -> DataFrame:
    found = N.extract_mentions_batch(documents(v), address_model).where("error is null")
    return found.select("doc_id", "value").distinct()


@query
def merge_mentions(v: Views) -> DataFrame:
    merged = N.merge_mentions(I.dedup_mentions(_word_mentions(v)))
    return merged.groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.length("value")).alias("chars")
    )


def _summary(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "name", "email", "title", "location", F.size("experience").alias("n_jobs"), F.size("education").alias("n_schools"),
        F.size("skills").alias("n_skills"), "total_experience",
    )


@query
def parse_resume_text(v: Views) -> DataFrame:
    return _summary(XT.parse_resume_text(resume_text(v)))


@query
def parse_resume_dataset(v: Views) -> DataFrame:
    return _summary(XD.parse_resume_dataset(dataset_text(v)))


@query
def parse_resume_profile(v: Views) -> DataFrame:
    return _summary(P.parse_resume_profile(v.written_texts("profile_box")))


def _contents(df: DataFrame) -> DataFrame:
    """The nested parts of parsed résumés, one item in a row; a résumé is parsed once and its parts are laid end to end."""
    def items(part: str, source: str, *fields: str) -> Column:
        def item(x: Column, i: Column) -> Column:
            values = [x[f] for f in fields] if fields else [x, F.lit(""), F.lit("")]
            return F.struct(F.lit(part).alias("part"), i.cast("int").alias("pos"), *[c.alias(n) for c, n in zip(values, ("what", "where_", "when_"), strict=True)])

        return F.transform(F.coalesce(source, F.array().cast(df.schema[source].dataType)), item)

    jobs, schools = items("job", "experience", "title", "company", "period"), items("school", "education", "degree", "institution", "period")
    # Outer, as Spark would put a test of the array below a plain explode and write the parser out once more for it.
    rows = df.select("doc_id", F.explode_outer(F.concat(jobs, schools, items("skill", "skills"))).alias("x"))
    return rows.where("x is not null").select("doc_id", "x.*")


@query
def parse_resume_text_contents(v: Views) -> DataFrame:
    return _contents(XT.parse_resume_text(resume_text(v)))


@query
def parse_resume_dataset_contents(v: Views) -> DataFrame:
    return _contents(XD.parse_resume_dataset(dataset_text(v)))


@query
def parse_resume_profile_contents(v: Views) -> DataFrame:
    return _contents(P.parse_resume_profile(v.written_texts("profile_box")))


# --- embedding and matching


@query
def embed_texts(v: Views) -> DataFrame:
    rows = documents(v).select(F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("id"), "text")
    vectors = E.embed_texts(rows, "cv", True)
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return vectors.select("id", "kind", "role", digest("text"), F.size("embedding").alias("dim"), F.round(norm, 3).alias("norm"))


def _named(hits: DataFrame) -> DataFrame:
    cols = [c for c in hits.columns if c != "sim"]
    return hits.select(*cols, F.round("sim", 6).alias("sim"))


@query
def knn_jobs_for_cv(v: Views) -> DataFrame:
    return _named(M.knn_jobs_for_cv(v.profile_vec(), v.posting_vec()))


@query
def knn_cvs_for_job(v: Views) -> DataFrame:
    return _named(M.knn_cvs_for_job(v.posting_vec(), v.profile_vec()))


@query
def knn_blocked(v: Views) -> DataFrame:
    return _named(M.knn_blocked(v.profile_vec(), v.posting_vec(), query_block=200, document_block=300))


@query
def lookup_text_embedding(v: Views) -> DataFrame:
    vectors = v.base("embeddings").select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    asked = vectors.select(F.substr("text", F.lit(8)).cast("long").alias("num"), "text")
    found = M.lookup_text_embedding(asked, vectors)
    return found.select("num", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dim"))


@query
def id_number_map(v: Views) -> DataFrame:
    rows = v.profile().select("id").unionByName(v.posting().select("id"))
    num = M.id_number(F.col("id"))
    return rows.select("id", num.alias("num"), M.id_from_number("B", num).alias("as_posting"))


@query
def rank_matches(v: Views) -> DataFrame:
    hits = M.knn(v.posting_vec(), v.profile_vec(), 20).drop("rank")
    return _named(M.rank_matches(hits))


@query
def attach_personal_info(v: Views) -> DataFrame:
    hits = M.knn_cvs_for_job(v.posting_vec(), v.profile_vec()).withColumn("id", M.id_from_number("A", F.col("cv_num")))
    return M.attach_personal_info(hits, v.profile().select("id", "name", "email")).select("job_num", "id", "rank", "name", "email")


@query
def top_matches(v: Views) -> DataFrame:
    hits = M.knn(v.posting_vec(), v.profile_vec())
    return _named(M.top_matches(hits).select("query_num", "match_num", "sim"))


# --- scoring


@query
def skill_jaccard(v: Views) -> DataFrame:
    return S.skill_jaccard(candidate_pairs(v), v.written("profile_skill"), v.written("posting_skill")).select("job_num", "cv_num", "jaccard")


@query
def skill_join_lookup(v: Views) -> DataFrame:
    lists = lambda df: df.groupBy("num").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    rows = S.skill_join_lookup(candidate_pairs(v), lists(v.written("profile_skill")), lists(v.written("posting_skill")))
    return rows.select(
        "job_num", "cv_num", F.array_join("cv_skills", ",").alias("cv_skills"), F.array_join("job_skills", ",").alias("job_skills"),
        S.jaccard_of_arrays(F.col("cv_skills"), F.col("job_skills")).alias("jaccard"),
    )


@query
def occupation_synonyms(v: Views) -> DataFrame:
    words = F.split("p_name", " ")
    alternatives = F.when(F.col("p_size") > 5, F.array_join(words, "\n"))
    rows = v.base("part").select(F.col("p_name").alias("preferredLabel"), alternatives.alias("altLabels"))
    return S.occupation_synonyms(rows).distinct()


@query
def title_category(v: Views) -> DataFrame:
    c = corpus(v)
    return S.title_category(candidate_pairs(v), c.cv_title, c.job_title, c.synonyms).select("job_num", "cv_num", "category")


@query
def title_similarity(v: Views) -> DataFrame:
    c = corpus(v)
    return S.title_similarity(candidate_pairs(v), c.cv_title, c.job_title).select("job_num", "cv_num", "title_sim")


@query
def experience_gap(v: Views) -> DataFrame:
    c = corpus(v)
    return S.with_experience_gap(candidate_pairs(v), c.cv_text, c.job_text).select("job_num", "cv_num", "gap")


@query
def dynamic_penalty(v: Views) -> DataFrame:
    c = corpus(v)
    rows = S.with_experience_gap(candidate_pairs(v), c.cv_text, c.job_text)
    return rows.select(
        "job_num", "cv_num", gap_penalty(F.col("gap"), False).alias("posting_query"), gap_penalty(F.col("gap"), True).alias("resume_query")
    )


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _final_score(with_title_text: bool) -> Callable[[Views], DataFrame]:
    return lambda v: _scored(
        funnel.score_pairs(candidate_pairs(v), corpus(v), False, with_title_text=with_title_text).select("job_num", "cv_num", "score"))


def _funnel_query(run: Callable[..., DataFrame], with_title_text: bool, columns: tuple[str, ...]) -> Callable[[Views], DataFrame]:
    return lambda v: _scored(run(corpus(v), with_title_text=with_title_text).select(*columns, "score"))


QUERIES["final_score"] = QUERIES["final_score_with_title_text"] = _final_score(True)
QUERIES["final_score_without_title_text"] = _final_score(False)
FUNNELS = {
    "funnel_best_cv": (funnel.funnel_best_cv, ("job_num", "cv_num")), "funnel_best_job": (funnel.funnel_best_job, ("cv_num", "job_num")),
    "funnel_cvs_ranked": (funnel.funnel_cvs_ranked, ("job_num", "cv_num", "place")),
    "funnel_jobs_ranked": (funnel.funnel_jobs_ranked, ("cv_num", "job_num", "place")),
}
#: The score has a term that SQL can't express; the same queries without it have SQL.
for _name, (_run, _columns) in FUNNELS.items():
    QUERIES[_name] = _funnel_query(_run, True, _columns)
    QUERIES[f"{_name}_without_title_text"] = _funnel_query(_run, False, _columns)

#: The names the full funnels had before.
FULL_SCORE: dict[str, Callable[[Views], DataFrame]] = {f"{name}_with_title_text": QUERIES[name] for name in FUNNELS}


# --- analytics


def _frequency_query(name: str, column: str) -> None:
    def run(v: Views) -> DataFrame:
        return A.frequency(v.written("posting"), column)

    QUERIES[name] = run


for _name, _column in (("freq_titles", "title"), ("freq_locations", "location"), ("freq_companies", "company"), ("freq_categories", "category")):
    _frequency_query(_name, _column)


@query
def freq_skills(v: Views) -> DataFrame:
    return A.freq_skills(v.written("posting_record"))


@query
def freq_all(v: Views) -> DataFrame:
    return A.freq_all(v.written("posting_record"))


@query
def top_n_report(v: Views) -> DataFrame:
    return A.top_n_report(A.freq_all(v.written("posting_record"))).withColumn("pct", F.round("pct", 6))


@query
def summary_stats(v: Views) -> DataFrame:
    rows = v.written("posting_record").withColumn("skills", F.when(F.col("level_phrase").isNotNull(), F.col("skills")))
    return A.summary_stats(rows)


@query
def report_document(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "report")
    ST.write_report(A.report_document(v.written("posting_record")), path)
    stats = "unique_job_titles bigint, unique_skills bigint, unique_locations bigint, unique_companies bigint"
    maps = ["top_job_titles", "top_skills", "top_locations", "top_companies", "categories"]
    ddl = "total_jobs bigint, " + ", ".join(f"{m} map<string, bigint>" for m in maps) + f", statistics struct<{stats.replace(' bigint', ': bigint')}>"
    report = v.spark.read.schema(ddl).json(path)
    entries = [
        report.select(F.lit(m).alias("part"), F.explode(m).alias("value", "n")) for m in maps
    ] + [
        report.select(F.lit("statistics").alias("part"), F.lit(s).alias("value"), F.col(f"statistics.{s}").alias("n"))
        for s in ("unique_job_titles", "unique_skills", "unique_locations", "unique_companies")
    ] + [report.select(F.lit("total").alias("part"), F.lit("total_jobs").alias("value"), F.col("total_jobs").alias("n"))]
    out = entries[0]
    for e in entries[1:]:
        out = out.unionByName(e)
    return out


# --- sinks and streams


@query
def to_key_value(v: Views) -> DataFrame:
    rows = R.render_posting_text(v.written("posting_record")).withColumn("source", F.lit("jobs_dataset"))
    return ST.to_key_value(rows, F.col("text"), "text")


def _intake_records(v: Views) -> DataFrame:
    """Envelopes of three kinds: raw postings, JSON résumés, and texts that are no JSON."""
    raw = F.struct("job_title_short", "company_name", "job_location", "job_country", "job_skills", "job_type_skills")
    postings = posting_rows(v).select("id", F.to_json(raw).alias("raw_data"), F.lit("jobs_dataset").alias("source"), F.lit("json").alias("type"), F.lit("job").alias("category"))
    resumes = resume_json_rows(v).select(F.concat(F.lit("A"), "doc_id").alias("id"), "raw_data", F.lit("json_dataset").alias("source"), F.lit("jsonl").alias("type"), F.lit("cv").alias("category"))
    texts = documents(v).select(F.concat(F.lit("Ax"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("raw_data"), F.lit("json_dataset").alias("source"), F.lit("jsonl").alias("type"), F.lit("cv").alias("category"))
    return postings.unionByName(resumes).unionByName(texts)


def _landed_intake(v: Views) -> str:
    rows = ST.producer_to_topic(_intake_records(v))
    return landed_once(v.spark, v.sf_dir, "intake", lambda p: rows.write.parquet(p))


def parse_intake(batch: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Envelopes of every route in their schemas with feature text; failures and unknown routes keep id and error."""
    from talentweave.plans.onboarding import parse

    if boxes is not None and Q.route_parser(batch).where(F.col("route") == "profile").isEmpty():
        boxes = boxes.limit(0)  # a batch without profiles needs no pass over all boxes
    return parse(batch, boxes=boxes)


def _routed_records(v: Views) -> DataFrame:
    """Envelopes of all routes: those of ``_intake_records``, free texts, dataset texts, profiles, and texts of no known source."""
    def envelope(rows: DataFrame, letter: str, text: Column, source: str, type_: str) -> DataFrame:
        tags = [F.lit(x).alias(n) for x, n in ((source, "source"), (type_, "type"), ("cv", "category"))]
        return rows.select(F.concat(F.lit(f"A{letter}"), F.col("doc_id").cast("string")).alias("id"), text.alias("raw_data"), *tags)

    parts = [
        envelope(resume_text(v), "t", F.col("text"), "new_texts", "txt"), envelope(dataset_text(v), "d", F.col("text"), "string_dataset", "csv"),
        envelope(resume_text(v), "p", F.lit("JVBERi0="), "linkedin_pdf", "pdf"), envelope(documents(v), "n", F.col("text"), "elsewhere", "xml"),
    ]
    out = _intake_records(v)
    for part in parts:
        out = out.unionByName(part)
    return out


@query
def fanout_sinks(v: Views) -> DataFrame:
    landed = landed_once(v.spark, v.sf_dir, "routes", lambda p: ST.producer_to_topic(_routed_records(v)).write.option("compression", PACKED).parquet(p))
    boxes = v.written_texts("profile_box").withColumn("doc_id", F.concat(F.lit("Ap"), "doc_id"))
    folder, checkpoint = fresh_path(v.spark, "fanout"), fresh_path(v.spark, "fanout-checkpoint")
    rows = ST.decode_envelope(SP.stream_source(v.spark, landed, max_bytes=SP.BATCH_BYTES))
    SP.start(rows, SP.fanout_sinks(lambda batch: parse_intake(batch, boxes), folder), checkpoint, available_now=True).awaitTermination()
    shown = {
        "schema_cv": F.json_array_length("experience").cast("string"), "text_cv": F.when(F.length("text") > 20, "said"), "info_cv": F.col("name"),
        "schema_job": F.col("title"), "text_job": F.when(F.length("text") > 20, "said"), "quarantine": F.lit(None).cast("string")}
    out = None
    for name, value in shown.items():
        one = v.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("table"), "id", value.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def producer_to_topic(v: Views) -> DataFrame:
    path = landed_once(v.spark, v.sf_dir, "topics", lambda p: ST.write_topics(ST.producer_to_topic(envelopes(v)), p))
    rows = v.spark.read.parquet(path)
    return rows.select("topic", "key", digest(F.get_json_object("value", "$.raw_data")))


@query
def stream_trigger_checkpoint(v: Views) -> DataFrame:
    """Two runs with one checkpoint, all messages sent again before the second: each content comes out once."""
    folder = fresh_path(v.spark, "sent")
    out, checkpoint = fresh_path(v.spark, "kept"), fresh_path(v.spark, "kept-checkpoint")
    messages = v.spark.read.parquet(_landed_messages(v))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("content_hash").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _rocksdb(v.spark):
        for _ in range(2):
            messages.write.mode("append").parquet(folder)
            rows = SP.dedup_content_stream(ST.decode_envelope(SP.stream_source(v.spark, folder)))
            SP.start(rows, keep, checkpoint, available_now=True).awaitTermination()
    return v.spark.read.parquet(out).select("content_hash")


def _processed_messages(v: Views) -> DataFrame:
    """Messages on the five result topics. What was parsed is written first, as every topic reads it."""
    path = fresh_path(v.spark, "parsed")
    parse_intake(_intake_records(v)).write.parquet(path)
    parsed = v.spark.read.parquet(path)
    good, _ = Q.split_errors(parsed)
    cvs, jobs = Q.split_kind(good)

    def on(topic: str, df: DataFrame, payload: Column, name: str) -> DataFrame:
        return ST.to_key_value(df, payload, name).select(F.lit(topic).alias("topic"), "key", "value")

    cv_schema = F.struct(*[F.to_json(c).alias(c) for c in ("education", "experience", "skills")])
    parts = [
        on("processed_schema_cv", cvs, cv_schema, "schema"),
        on("processed_text_cv", cvs, F.col("text"), "text"),
        on("processed_personal_info_cv", cvs, F.struct("name", "email", "linkedin"), "info"),
        on("processed_schema_job", jobs, F.struct("title", "company", "skills"), "schema"),
        on("processed_text_job", jobs, F.col("text"), "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def topics_to_tables(v: Views) -> DataFrame:
    source = landed_once(v.spark, v.sf_dir, "processed", lambda p: _processed_messages(v).write.parquet(p))
    folder, checkpoints = fresh_path(v.spark, "tables"), fresh_path(v.spark, "tables-checkpoints")
    for run in SP.topics_to_tables(v.spark, source, folder, checkpoints, SP.DECODERS, available_now=True):
        run.awaitTermination()
    shown = {"text_cv": "source", "text_job": "text", "info_cv": "email", "schema_cv": "source", "schema_job": "title"}
    out = None
    for name, column in shown.items():
        one = v.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("table"), "id", F.col(column).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def append_partitioned(v: Views) -> DataFrame:
    rows = v.spark.read.parquet(_landed_texts(v))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("text_length").cast("bigint").alias("chars"))


@query
def compact_tables(v: Views) -> DataFrame:
    rows = ST.compact_tables(v.spark, _landed_texts(v), fresh_path(v.spark, "compacted"))
    return rows.select("id", "kind", digest("text"), "text_length")


@query
def write_matches(v: Views) -> DataFrame:
    hits = M.knn(v.posting_vec(), v.profile_vec()).select(
        M.id_from_number("B", F.col("query_num")).alias("query_id"), M.id_from_number("A", F.col("match_num")).alias("id"), "rank"
    )
    path = fresh_path(v.spark, "matches")
    ST.write_matches(hits, path)
    return v.spark.read.parquet(path).select("query_id", "id", "rank")
