"""Match queries: candidates by similarity, then the weighted score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave import constants as K
from talentweave.operators import matching as M
from talentweave.operators import scoring as S
from talentweave.session import settled


@dataclass
class Corpus:
    """Tables of both sides: vectors ``(num, embedding)``, skills, titles and level texts as ``(num, ...)``."""

    cv_vec: DataFrame
    job_vec: DataFrame
    cv_skill: DataFrame
    job_skill: DataFrame
    cv_title: DataFrame
    job_title: DataFrame
    cv_text: DataFrame
    job_text: DataFrame
    synonyms: DataFrame


def candidates(c: Corpus, resume_is_query: bool, k: int = K.FUNNEL_K) -> DataFrame:
    """Top-k pairs; vectors without a record on the other tables are left out before the search."""
    cv = c.cv_vec.join(c.cv_text.select("num"), "num", "left_semi")
    job = c.job_vec.join(c.job_text.select("num"), "num", "left_semi")
    found = M.knn_jobs_for_cv(cv, job, k) if resume_is_query else M.knn_cvs_for_job(job, cv, k)
    return settled(found, "candidate")


def score_pairs(pairs: DataFrame, c: Corpus, resume_is_query: bool, with_title_text: bool = True) -> DataFrame:
    """Cheap joins first. The pairs are a small table beside those they are joined with, so they are written after the steps that shuffle most."""
    scored = settled(S.skill_jaccard(pairs, c.cv_skill, c.job_skill), "jaccard")
    scored = settled(S.title_category(scored, c.cv_title, c.job_title, c.synonyms), "category")
    scored = S.with_experience_gap(scored, c.cv_text, c.job_text)
    if with_title_text:
        scored = S.title_similarity(scored, c.cv_title, c.job_title)
    return S.final_score(scored, resume_is_query)


def funnel_cvs_ranked(c: Corpus, k: int = K.FUNNEL_K, with_title_text: bool = True) -> DataFrame:
    return S.funnel_ranked(score_pairs(candidates(c, False, k), c, False, with_title_text), "job_num")


def funnel_jobs_ranked(c: Corpus, k: int = K.FUNNEL_K, with_title_text: bool = True) -> DataFrame:
    return S.funnel_ranked(score_pairs(candidates(c, True, k), c, True, with_title_text), "cv_num")


def funnel_best_cv(c: Corpus, k: int = K.FUNNEL_K, with_title_text: bool = True) -> DataFrame:
    scored = score_pairs(candidates(c, False, k), c, False, with_title_text)
    queries = c.job_text.select(F.col("num").alias("job_num"))
    return S.funnel_best(scored, queries, "job_num", "cv_num")


def funnel_best_job(c: Corpus, k: int = K.FUNNEL_K, with_title_text: bool = True) -> DataFrame:
    scored = score_pairs(candidates(c, True, k), c, True, with_title_text)
    queries = c.cv_text.select(F.col("num").alias("cv_num"))
    return S.funnel_best(scored, queries, "cv_num", "job_num")
