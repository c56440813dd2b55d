"""Experience levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave import constants as K


def experience_level(years: Column) -> Column:
    return (
        F.when(years.isNull(), None)
        .when(years == 0, "internship level")
        .when(years < 3, "junior level")
        .when(years < 6, "mid-level")
        .when(years < 8, "senior level")
        .otherwise("principal level")
    )


def level_number(text: Column) -> Column:
    """1-4 for the first level phrase found in the text, null when none is."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), i + 1) for i, p in enumerate(K.LEVEL_PHRASES)])


def experience_gap(posting_level: Column, resume_level: Column) -> Column:
    """Weighted level difference; null when either side names no level."""
    steps = len(K.LEVEL_PHRASES) - 1
    d = resume_level - posting_level
    return F.when(d >= 0, F.lit(K.OVER_LEVEL_FACTOR) * d / steps).otherwise(F.lit(K.UNDER_LEVEL_FACTOR) * d / steps)


def gap_penalty(gap: Column, resume_is_query: bool) -> Column:
    if resume_is_query:
        return F.lit(0.0)
    return F.when(gap < 0, K.UNDER_LEVEL_PENALTY).otherwise(K.OVER_LEVEL_PENALTY)
