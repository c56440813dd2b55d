"""Résumés, postings and vectors derived from the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators.identity import number_in_group
from talentweave.session import spread_small, written_once

JOBS_PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def written(self, name: str) -> DataFrame:
        """The named view from a table written to the shared folder on first use.

        Views of the lines are made from two tables that are written first: all lines with their names, and the first line of each order.
        """
        return written_once(self.spark, self.sf_dir, name, getattr(_OverWritten(self.spark, self.sf_dir), name))

    def texts(self, name: str) -> DataFrame:
        """A base table of long texts; its rows are dealt out when the table has few row groups."""
        return spread_small(self.base(name))

    def written_texts(self, name: str) -> DataFrame:
        return spread_small(self.written(name))

    def places(self) -> DataFrame:
        place = F.concat_ws(", ", "n_name", "r_name")
        return (
            self.base("nation")
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "r_name", place.alias("location"))
        )

    def sel_lines(self) -> DataFrame:
        # Orders last: the lines then lie by order, as the first line of each needs them.
        return (
            self.base("lineitem")
            .join(self.base("part"), F.col("p_partkey") == F.col("l_partkey"))
            .join(self.base("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
            .join(self.base("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("num"), "o_orderkey", "l_linenumber", "l_quantity", "p_name", "p_brand",
                "s_name", F.year("o_orderdate").alias("y"),
            )
        )

    def profile(self) -> DataFrame:
        span = self.base("orders").groupBy(F.col("o_custkey").alias("num")).agg(
            (F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))).alias("total_experience")
        )
        key = F.col("num").cast("string")
        return (
            self.base("customer")
            .join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("num", F.col("c_custkey"))
            .join(span, "num")
            .select(
                "num",
                F.concat(F.lit("A"), key).alias("id"),
                F.translate("c_name", "#0123456789", " abcdefghij").alias("name"),
                F.concat(F.lit("user"), key, F.lit("@example.com")).alias("email"),
                "location", "r_name", "total_experience",
            )
        )

    def profile_skill(self) -> DataFrame:
        return self.sel_lines().select("num", F.col("p_brand").alias("skill")).distinct()

    def profile_title(self) -> DataFrame:
        return self.sel_lines().select("num", F.col("p_name").alias("title")).distinct()

    def first_line(self) -> DataFrame:
        order = F.struct("l_linenumber", "p_name", "p_brand", "s_name", "l_quantity")
        row = F.struct("num", "l_linenumber", "l_quantity", "p_name", "p_brand", "s_name", "y")
        first = self.sel_lines().groupBy("o_orderkey").agg(F.min_by(row, order).alias("row"))
        return first.select("o_orderkey", "row.*")

    def profile_job(self) -> DataFrame:
        key = (F.lit(9999) - F.col("y")).cast("bigint") * 1_000_000_000_000 + F.col("o_orderkey")
        numbered = number_in_group(self.first_line().withColumn("_order", key), ["num"], "_order", "pos")
        return numbered.select(
            "num", "o_orderkey", "pos", F.col("p_name").alias("title"), F.col("s_name").alias("company"),
            F.concat_ws(" - ", F.col("y").cast("string"), (F.col("y") + 1).cast("string")).alias("period"), "y",
        )

    def posting(self) -> DataFrame:
        grade = F.substring("o_orderpriority", 1, 1)
        phrase = (
            F.when(grade == "1", "senior level").when(grade == "2", "mid-level")
            .when(grade == "3", "junior level").when(grade == "4", "internship level")
        )
        return (
            self.first_line().select("o_orderkey", "p_name", "s_name")
            .join(self.base("orders"), "o_orderkey")
            .join(self.base("customer"), F.col("c_custkey") == F.col("o_custkey"))
            .join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("num"),
                F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("id"),
                F.lit("job").alias("category"), F.col("p_name").alias("title"), F.col("s_name").alias("company"),
                "location", phrase.alias("level_phrase"),
            )
        )

    def posting_skill(self) -> DataFrame:
        return self.sel_lines().select(F.col("o_orderkey").alias("num"), F.col("p_brand").alias("skill")).distinct()

    def posting_record(self) -> DataFrame:
        """Postings with their skills as a list; a posting lists at most the distinct brands."""
        skills = self.posting_skill().groupBy("num").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
        return self.posting().join(skills, "num", "left")

    def occupation(self) -> DataFrame:
        name = F.split("p_name", " ")
        return (
            self.base("part")
            .select(F.explode(F.array(F.get(name, 0), F.coalesce(F.get(name, 1), F.lit("")))).alias("group_id"),
                    F.col("p_name").alias("term"))
            .distinct()
        )

    def profile_vec(self) -> DataFrame:
        return self.base("embeddings").where("vec_id % 2 = 0").select(
            F.expr("vec_id div 2").alias("num"), "embedding"
        )

    def posting_vec(self) -> DataFrame:
        return self.base("embeddings").where("vec_id % 2 = 1").select(
            F.expr("(vec_id - 1) div 2").alias("num"), "embedding"
        )

    # --- documents rendered from the structured tables, to be read back by the extraction jobs

    def _job_pages(self) -> DataFrame:
        """Experience of one résumé page: at most JOBS_PER_PAGE items, however many a résumé has."""
        item = F.struct("pos", "title", "company", "period", "y")
        return (
            self.profile_job()
            .withColumn("page", F.expr(f"(pos - 1) div {JOBS_PER_PAGE}").cast("int"))
            .groupBy("num", "page")
            .agg(F.array_sort(F.collect_list(item)).alias("jobs"))
        )

    def _skill_pages(self) -> DataFrame:
        """Skills of a résumé; the list holds at most the distinct brands."""
        return self.profile_skill().groupBy("num").agg(F.array_sort(F.collect_set("skill")).alias("skills"))

    def resume_page(self) -> DataFrame:
        """Structured résumé pages: the source of every rendered document.

        The first page carries skills and education, later pages only carry on the experience.
        """
        pages = self._job_pages()
        return (
            pages.join(self._skill_pages(), "num", "left")
            .join(self.profile(), "num")
            .select(
                F.concat_ws("-", F.col("num").cast("string"), F.col("page").cast("string")).alias("doc_id"),
                "num", "page", "name", "email", "location", "r_name", "jobs",
                F.when(F.col("page") == 0, F.coalesce("skills", F.array().cast("array<string>")))
                .otherwise(F.array().cast("array<string>")).alias("skills"),
                F.element_at("jobs", -1)["y"].alias("edu_year"),
            )
        )

    def _pages(self) -> DataFrame:
        return self.written_texts("resume_page")

    @staticmethod
    def letters(c: Column | str) -> Column:
        """Places and names without digits or underscores."""
        return F.translate(c, "_0123456789", " abcdefghij")

    def resume_text(self) -> DataFrame:
        """Free-form résumés: headings on their own lines, "title | company" above the period."""
        job = lambda j: F.concat(j["title"], F.lit(" | "), j["company"], F.lit("\n"), j["period"])
        school = F.concat(F.lit("Bachelor of Science | University of "), self.letters(F.col("r_name")))
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("Name: "), F.col("name")),
            self.letters(F.initcap("location")),
            F.concat(F.lit("Email: "), F.col("email")),
            F.lit("--- WORK EXPERIENCE ---"),
            F.array_join(F.transform("jobs", job), "\n"),
            F.lit("=== EDUCATION ==="),
            school,
            F.col("edu_year").cast("string"),
            F.lit("SKILLS"),
            F.array_join("skills", ", "),
        )
        return self._pages().select("doc_id", "num", "page", F.concat(text, F.lit("\n")).alias("text"))

    def dataset_text(self) -> DataFrame:
        """Dataset résumés: one line, fields set off by runs of blanks."""
        job = lambda j: F.concat(j["company"], F.lit("  "), F.initcap(j["title"]), F.lit("  "), j["period"])
        text = F.concat(
            F.upper(F.element_at("jobs", 1)["title"]), F.lit("       Summary    Hands-on with "),
            F.lit("tools and teams.    Experience    "),
            F.array_join(F.transform("jobs", job), "   "),
            F.lit("    Education    University of "), self.letters(F.initcap("r_name")),
            F.lit("  Bachelor  "), F.col("edu_year").cast("string"),
            F.lit("    Skills    "), F.array_join("skills", ", "),
        )
        return self._pages().select("doc_id", "num", "page", text.alias("text"))

    def profile_box(self) -> DataFrame:
        """Text boxes of two-column profiles, in no particular order."""
        box = lambda page, x, y, seq, text: F.struct(
            F.lit(page).cast("int").alias("pdf_page"), F.lit(x).cast("double").alias("x0"),
            F.lit(y).cast("double").alias("y1"), seq.cast("int").alias("seq"), text.alias("text"),
        )
        left = F.concat_ws(
            "\n", F.lit("Contact"), F.col("email"), F.lit("www.linkedin.com/in/"),
            F.concat(F.lit("user-"), F.col("num").cast("string"), F.lit(" (LinkedIn)")),
        )
        skills = F.concat(F.lit("Top Skills\n"), F.array_join("skills", "\n"))
        head = F.concat_ws("\n", "name", F.initcap(F.element_at("jobs", 1)["title"]), self.letters(F.initcap("location")))
        span = lambda j: F.concat(
            F.lit("January "), j["y"].cast("string"), F.lit(" - March "), (j["y"] + 1).cast("string"),
            F.lit(" (1 year 3 months)"),
        )
        job_text = lambda j: F.concat_ws("\n", j["company"], j["title"], span(j), F.lit("Italy\u00a0– Trento"))
        jobs = F.transform(
            "jobs",
            lambda j, i: F.struct(
                F.lit(1).alias("pdf_page"), F.lit(220.0).alias("x0"), (F.lit(700.0) - i).alias("y1"),
                (i + 10).cast("int").alias("seq"), job_text(j).alias("text"),
            ),
        )
        school = F.concat(
            F.lit("Education\nUniversity of "), self.letters(F.initcap("r_name")),
            F.lit("\nBachelor of Science · ("), F.col("edu_year").cast("string"), F.lit(")"),
        )
        boxes = F.concat(
            F.array(
                box(0, 20, 700, F.lit(0), left), box(0, 20, 500, F.lit(1), skills),
                box(0, 220, 700, F.lit(2), head), box(0, 220, 600, F.lit(3), F.lit("Experience")),
                box(2, 220, 300, F.lit(4), school), box(2, 220, 10, F.lit(5), F.lit("Page 3 of 3")),
            ),
            jobs,
        )
        return self._pages().select("doc_id", "num", "page", F.explode(boxes).alias("b")).select(
            "doc_id", "num", "page", "b.*"
        )

    def resume_json(self) -> DataFrame:
        """Nested résumé records as JSON text."""
        job = lambda j: F.struct(
            j["title"].alias("title"),
            F.when(j["pos"] % 5 == 0, F.lit("Unknown")).otherwise(j["company"]).alias("company"),
            F.struct(
                F.concat(j["y"].cast("string"), F.lit("-01")).alias("start"),
                F.when(j["pos"] == 1, F.lit("Present")).otherwise(
                    F.concat((j["y"] + 1).cast("string"), F.lit("-06"))).alias("end"),
                F.lit("Not Provided").alias("duration"),
            ).alias("dates"),
            F.array(F.concat(F.lit("made "), j["title"]), F.lit("UNKNOWN")).alias("responsibilities"),
            F.create_map(F.lit("parts"), F.array(j["title"])).alias("technical_environment"),
        )
        record = F.struct(
            F.struct(
                "name", F.lit("unknown").alias("linkedin"), "email",
                F.struct(F.split("location", ", ")[0].alias("city"), F.split("location", ", ")[1].alias("country"))
                .alias("location"),
            ).alias("personal_info"),
            F.transform("jobs", job).alias("experience"),
            F.array(F.struct(
                F.struct(F.concat(F.lit("University of "), F.col("r_name")).alias("name")).alias("institution"),
                F.struct(F.lit("Bachelor").alias("level"), F.lit("Science").alias("field")).alias("degree"),
                F.struct(
                    F.col("edu_year").cast("string").alias("start"),
                    F.lit("Unknown").alias("expected_graduation"),
                    F.col("edu_year").cast("string").alias("end"),
                ).alias("dates"),
                F.struct(F.lit("with honours").alias("grade"), F.array(F.lit("a"), F.lit("unknown"), F.lit("b"))
                         .alias("awards")).alias("achievements"),
            )).alias("education"),
            F.struct(
                F.struct(F.col("skills").alias("brands"),
                         F.array(F.struct(F.lit("welding").alias("name"))).alias("named")).alias("technical"),
                F.array(F.lit("teamwork"), F.lit("Unknown")).alias("soft"),
                F.array(F.struct(F.lit("Italian").alias("language"), F.lit("native").alias("level"))).alias("languages"),
            ).alias("skills"),
        )
        return self._pages().select("doc_id", "num", "page", F.to_json(record).alias("raw_data"))


class _OverWritten(Views):
    """The views as ``written`` makes them: every one that needs the lines, or the first of each order, reads the same table."""

    def sel_lines(self) -> DataFrame:
        return written_once(self.spark, self.sf_dir, "sel_lines", super().sel_lines)

    def first_line(self) -> DataFrame:
        return written_once(self.spark, self.sf_dir, "first_line", super().first_line)
