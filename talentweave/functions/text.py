"""Column functions on strings. All run inside the JVM, except ``compose_unicode``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talentweave import constants as K

# Private-use characters that bracket a regex match inside a text.
OPEN = "\ue000"
CLOSE = "\ue001"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when the body uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every whitespace character, not only blanks."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lines_of(c: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def words_of(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != "")


def any_of(words: list[str]) -> str:
    """Regex alternation of fixed strings."""
    return "(?:" + "|".join(r"\Q" + w + r"\E" for w in words) + ")"


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when one of the fixed strings occurs in ``c``."""
    return F.rlike(c, F.lit(any_of(needles)))


def clean_field(c: Column) -> Column:
    """Pipes and spaced dashes become blanks, edge punctuation goes, runs of whitespace shrink."""
    spaced = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(" ")), r"(?U)\s+-\s+", " ")
    return squeeze(F.btrim(spaced, F.lit(" .,;|-•*:\n\t")))


def blank_placeholder(c: Column) -> Column:
    return F.when(c.isNull() | F.lower(c).isin(K.PLACEHOLDERS), F.lit("")).otherwise(c)


def join_present(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[non_empty(p) for p in parts])


def fix_characters(c: Column) -> Column:
    """Non-breaking space and long dashes to their plain forms."""
    return F.translate(c, "".join(K.CHARACTER_FIXES), "".join(K.CHARACTER_FIXES.values()))


@F.pandas_udf(StringType())
def compose_unicode(text: pd.Series) -> pd.Series:
    """NFC. Spark has no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def drop_footers_and_translate(c: Column) -> Column:
    """Remove page footers, put language names in English."""
    out = F.regexp_replace(c, "(?i)" + K.PAGE_FOOTER_PATTERN, "")
    for name, english in K.LANGUAGE_NAMES.items():
        out = F.replace(out, F.lit(name), F.lit(english))
    return out


def is_duration_line(c: Column) -> Column:
    return F.rlike(strip(c), F.lit("(?iU)" + K.DURATION_PATTERN))


def is_location_line(c: Column) -> Column:
    def test(low: Column) -> Column:
        place = contains_any(low, K.KNOWN_PLACES) | (F.contains(c, F.lit(",")) & (F.length(c) < 50))
        return ~contains_any(low, K.ORGANISATION_WORDS) & place

    return let(F.lower(c), test)


def mark(c: Column, pattern: str, shown: str = "$0") -> Column:
    """Bracket every match of ``pattern`` with OPEN and CLOSE."""
    plain = F.translate(c, OPEN + CLOSE, "  ")
    return F.regexp_replace(plain, pattern, OPEN + shown + CLOSE)


def segments(parts: Column) -> Column:
    """Matches with the text around them, from ``split(marked text, OPEN)`` held in a column of its own.

    Every gap between two matches is both the ``after`` of one and the ``before`` of the next, so each
    piece of text is copied at most twice, whatever the number of matches.
    """
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x, i: F.struct(
            i.cast("int").alias("pos"),
            F.substring_index(x, CLOSE, 1).alias("match"),
            F.substring_index(F.get(parts, i), CLOSE, -1).alias("before"),
            F.substring_index(x, CLOSE, -1).alias("after"),
        ),
    )


def is_json_object(c: Column) -> Column:
    """Whether a text is one JSON object; null, other JSON values and broken text are not."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
