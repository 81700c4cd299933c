"""Cleaning of extracted text: nine steps in a fixed order, each a projection.

Defined results: a null text gives null everywhere; an empty one an empty text, zero lengths
and a reduction of 0; rows may repeat; other columns pass through unless named like a result,
which replaces them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import NOT_SPACE, SPACE, SPACE_SET, java, map_lines, rstrip
from ..functions.text import UNSEEN, nfc, order_numbers, scrub

#: Lines that hold one of these are never blanked.
PROTECTED = [
    r"(?iu)G\.O\.|Government Order|G\.O\s*No",
    r"(?iu)\bSection\b|\bClause\b|\bArticle\b|\bRule\b|\bChapter\b",
    r"(?iu)\b(?:Act|Circular|Notification|Order|Gazette)\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\bNo\.\s*\d+",
    r"\bRs\.?\s*\d+",
    r"\bProclaimed|Enacted|Whereas|In exercise",
]
#: Lines that are page numbers, marks of status, or garbled.
PAGE_NUMBER = r"(?iu)^(?:[\-–—]?\s*Page\s*\d+\s*[\-–—]?|[\-–—]\s*\d+\s*[\-–—]|\d+)$"
STATUS_MARK = r"(?iu)^(?:CONFIDENTIAL|DRAFT|RESTRICTED|OFFICIAL USE ONLY|NOT FOR DISTRIBUTION)$"
GARBLED = r"^[^\p{L}\p{N}_\n]{1,3}$"


def is_protected(line: Column) -> Column:
    return reduce(lambda a, b: a | b, (line.rlike(java(p)) for p in PROTECTED))


def standard_marks(text: Column) -> Column:
    """Composed; curly quotes and dashes plain, an em dash spaced, no-break spaces blank."""
    t = F.translate(nfc(text), "‘’“”–  ", "''\"\"-  ")
    return F.replace(t, F.lit("\u2014"), F.lit(" - "))


def drop_controls(text: Column) -> Column:
    """White space but line feed, carriage return, tab and blank is deleted, and NUL."""
    return F.regexp_replace(text, rf"[{SPACE_SET}\x00&&[^\n\r\t\x20]]", "")


def _blank_lines(text: Column, pattern: str) -> Column:
    """Lines that match when stripped become empty. White space around is part of the pattern,
    as stripping every line would take most of the time."""
    flags, core = re.fullmatch(r"(\(\?\w+\))?\^(.*)\$", pattern, re.S).groups()
    around = rf"{flags or ''}^{SPACE}*(?={NOT_SPACE})(?:{core})(?<={NOT_SPACE}){SPACE}*\z"
    return map_lines(text, lambda x: F.when(x.rlike(around) & ~is_protected(x), "").otherwise(x))


def drop_page_numbers(text: Column) -> Column:
    return _blank_lines(text, java(PAGE_NUMBER))


def drop_status_marks(text: Column) -> Column:
    return _blank_lines(text, STATUS_MARK)


def drop_separators(text: Column) -> Column:
    return F.regexp_replace(text, r"[-_=*~]{5,}", "\n")


def shorten_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"\.{4,}", "...")


def drop_garbled(text: Column) -> Column:
    return _blank_lines(text, GARBLED)


def collapse(text: Column) -> Column:
    """Runs of blanks to one, three or more line feeds to two, then line ends stripped."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return map_lines(t, rstrip)


STEPS = [standard_marks, drop_controls, drop_page_numbers, drop_status_marks, drop_separators, shorten_dots, drop_garbled, collapse, scrub]


def clean_text(text: Column) -> Column:
    return reduce(lambda t, step: step(t), STEPS, text)


def clean_part(text: Column) -> Column:
    """The same steps for one part of a text whose parts are joined by blank lines, so that a
    long text needs no cleaning as a whole: all steps but the last strip work within lines,
    and line feeds between two parts always come down to two. Null for a part of nothing but
    line feeds. The cleaned text is the other parts joined and stripped (join_parts)."""
    t = reduce(lambda t, step: step(t), STEPS[: STEPS.index(collapse)], text)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.nullif(F.regexp_replace(t, r"\A\n+|\n+\z", ""), F.lit(""))
    return F.regexp_replace(nfc(map_lines(t, rstrip)), UNSEEN, "")


def join_parts(parts: list[str | None]) -> str:
    return "\n\n".join(p for p in parts if p is not None).strip()


def clean(df: DataFrame, text: str = "text", out: str = "cleaned_text") -> DataFrame:
    """Add the cleaned text, its lengths, the reduction in percent and the order numbers."""
    df = df.withColumn(out, clean_text(F.col(text)))
    before, after = F.length(text), F.length(out)
    removed = F.greatest(F.lit(0), before - after)
    return df.withColumns({
        "original_length": before,
        "cleaned_length": after,
        "removed_chars": removed,
        "reduction_percent": F.when(before == 0, F.lit(0.0)).otherwise(F.round(removed / before * 100, 2)),
        "go_numbers": order_numbers(F.col(out)),
    })
