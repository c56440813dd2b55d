"""Second-stage scores over candidate pairs ``(cv_num, job_num, sim, rank)``."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from talentweave import constants as K
from talentweave.functions.levels import experience_gap, gap_penalty, level_number

PAIR = ["cv_num", "job_num"]


def jaccard_of_arrays(a: Column, b: Column) -> Column:
    """Overlap of two skill lists; null counts as empty, two empty lists give 0. Four decimals."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.bround(F.size(F.array_intersect(a, b)) / union, 4))


def skill_jaccard(pairs: DataFrame, cv_skill: DataFrame, job_skill: DataFrame) -> DataFrame:
    """Add ``jaccard``, with four decimals, from the skill tables ``(num, skill)`` without repeats.

    Common skills are counted by a join on posting and skill together, so no skill list is gathered and a
    posting or skill with most of the rows does not end up in one task.
    """
    cv = cv_skill.select(F.col("num").alias("cv_num"), "skill")
    job = job_skill.select(F.col("num").alias("job_num"), "skill")
    keys = pairs.select(*PAIR).distinct()
    common = keys.join(cv, "cv_num").join(job, ["job_num", "skill"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_common"))
    cv_size = cv.groupBy("cv_num").agg(F.count(F.lit(1)).alias("_cv_size"))
    job_size = job.groupBy("job_num").agg(F.count(F.lit(1)).alias("_job_size"))
    joined = pairs.join(common, PAIR, "left").join(cv_size, "cv_num", "left").join(job_size, "job_num", "left")
    both = F.coalesce("_common", F.lit(0))
    union = F.coalesce("_cv_size", F.lit(0)) + F.coalesce("_job_size", F.lit(0)) - both
    value = F.when(union == 0, 0.0).otherwise(F.bround(both / union, 4))
    return joined.withColumn("jaccard", value).drop("_common", "_cv_size", "_job_size")


def skill_join_lookup(pairs: DataFrame, cv_skills: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Skill lists of both sides next to each pair, by two equi-joins; lists come as ``(num, skills)``."""
    cv = cv_skills.select(F.col("num").alias("cv_num"), F.col("skills").alias("cv_skills"))
    job = job_skills.select(F.col("num").alias("job_num"), F.col("skills").alias("job_skills"))
    return pairs.join(cv, "cv_num", "left").join(job, "job_num", "left")


def occupation_synonyms(occupations: DataFrame) -> DataFrame:
    """``(group_id, term)`` from ``(preferredLabel, altLabels)``: the label and its newline-separated variants."""
    alternatives = F.split(F.coalesce("altLabels", F.lit("")), "\n")
    named = F.when(F.col("altLabels").isNull(), F.array(F.col("preferredLabel"))).otherwise(
        F.concat(alternatives, F.array("preferredLabel"))
    )
    return occupations.select(F.col("preferredLabel").alias("group_id"), F.explode(F.array_distinct(named)).alias("term"))


def _lists(pairs: DataFrame, cv: DataFrame, job: DataFrame, name: str) -> DataFrame:
    """Add ``_cv_<name>`` and ``_job_<name>``, the values of both sides, empty without any; ``cv`` and ``job`` are ``(num, name)``.

    The values of a résumé stay one list, so pairs times values are never shuffled, and the join of a résumé with most of the pairs can be split.
    """
    none = F.array().cast("array<string>")
    for side, values in (("job", job), ("cv", cv)):  # the longer lists last
        asked = pairs.select(F.col(f"{side}_num").alias("num")).distinct()
        listed = values.join(asked, "num", "left_semi").groupBy(F.col("num").alias(f"{side}_num")).agg(F.collect_list(name).alias("_list"))
        pairs = pairs.join(listed, f"{side}_num", "left").withColumn(f"_{side}_{name}", F.coalesce("_list", none)).drop("_list")
    return pairs


def title_category(pairs: DataFrame, cv_title: DataFrame, job_title: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Add ``category``: 1 when a résumé title equals the posting title, else the synonym groups shared with it, summed over all titles."""
    term = synonyms.select(F.col("term").alias("title"), "group_id")

    def values(titles: DataFrame, side: str) -> DataFrame:
        # Titles and groups in one list for each document: first letters tell them apart.
        asked = pairs.select(F.col(f"{side}_num").alias("num")).distinct()
        own = titles.select("num", "title").join(asked, "num", "left_semi")
        groups = own.join(term, "title").select("num", F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("mark"))
        return own.select("num", F.concat(F.lit("t"), "title").alias("mark")).unionByName(groups)

    marked = _lists(pairs, values(cv_title, "cv"), values(job_title, "job"), "mark")
    # Marks of the posting that the résumé has, each as often as it stands on either side.
    common = F.flatten(F.transform("_job_mark", lambda x: F.filter("_cv_mark", lambda y: x == y)))
    found = marked.withColumn("_common", common).drop("_cv_mark", "_job_mark")
    exact = F.exists("_common", lambda x: F.startswith(x, F.lit("t")))
    value = F.when(exact, F.lit(1)).otherwise(F.size("_common"))
    return found.withColumn("category", value.cast("bigint")).drop("_common").select(*pairs.columns, "category")


def partial_ratio(a: str, b: str) -> int:
    """Best match of the shorter text inside the longer one, 0-100.

    Every matching block proposes one window of the longer text; the best window decides.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for block in SequenceMatcher(None, short, long).get_matching_blocks():
        at = max(block.b - block.a, 0)
        score = SequenceMatcher(None, short, long[at : at + len(short)]).ratio()
        if score > 0.995:
            return 100
        best = max(best, score)
    return int(round(100 * best))


SEEN_TITLES = 1 << 17


@F.pandas_udf(IntegerType())
def best_ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Best partial ratio between two lists of texts, 0 if one is empty. Equal pairs of texts are compared once while the task remembers them."""
    seen: dict[tuple[str, str], int] = {}

    def ratio(a: str, b: str) -> int:
        if (a, b) not in seen:
            if len(seen) >= SEEN_TITLES:
                seen.clear()
            seen[a, b] = partial_ratio(a, b)
        return seen[a, b]

    for left, right in batches:
        yield pd.Series([max((ratio(x, y) for x in xs for y in ys), default=0) for xs, ys in zip(left, right)], dtype="int32")


def title_similarity(pairs: DataFrame, cv_title: DataFrame, job_title: DataFrame) -> DataFrame:
    """Add ``title_sim``: best partial ratio over the résumé titles, 0 without titles."""
    found = _lists(pairs, cv_title.select("num", "title"), job_title.select("num", "title"), "title")
    scored = found.withColumn("title_sim", best_ratios("_cv_title", "_job_title") / 100)
    return scored.select(*pairs.columns, "title_sim")


def with_experience_gap(pairs: DataFrame, cv_text: DataFrame, job_text: DataFrame) -> DataFrame:
    """Add ``gap`` from the level phrases in the texts ``(num, text)``; the phrase is looked up once per text."""
    cv = cv_text.select(F.col("num").alias("cv_num"), level_number(F.col("text")).alias("_cv_level"))
    job = job_text.select(F.col("num").alias("job_num"), level_number(F.col("text")).alias("_job_level"))
    joined = pairs.join(cv, "cv_num", "left").join(job, "job_num", "left")
    return joined.withColumn("gap", experience_gap(F.col("_job_level"), F.col("_cv_level"))).drop("_cv_level", "_job_level")


def final_score(pairs: DataFrame, resume_is_query: bool = False) -> DataFrame:
    """Add ``score`` from sim, jaccard, category, title_sim (0 when not present) and gap."""
    title_sim = F.col("title_sim") if "title_sim" in pairs.columns else F.lit(0.0)
    gap = F.coalesce("gap", F.lit(0.0))
    score = (
        F.lit(K.COSINE_WEIGHT) * F.col("sim") + F.lit(K.JACCARD_WEIGHT) * F.col("jaccard")
        + F.lit(K.TITLE_GROUP_WEIGHT) * F.col("category") + F.lit(K.TITLE_TEXT_WEIGHT) * title_sim
        - gap_penalty(gap, resume_is_query) * gap
    )
    return pairs.withColumn("score", score)


def funnel_ranked(scored: DataFrame, query: str) -> DataFrame:
    """All candidates of each query by score; the earlier similarity rank wins a tie."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order))


def funnel_best(scored: DataFrame, queries: DataFrame, query: str, match: str) -> DataFrame:
    """Best candidate of each query; a query without candidates gets no match and score 0."""
    best = scored.groupBy(query).agg(
        F.max_by(F.struct(F.col(match), F.col("score")), F.struct("score", -F.col("rank"))).alias("_best")
    )
    return queries.select(query).join(best, query, "left").select(
        query, F.col(f"_best.{match}").alias(match), F.coalesce(F.col("_best.score"), F.lit(0.0)).alias("score")
    )
