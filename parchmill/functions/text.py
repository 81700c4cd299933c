"""Scalar text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import count_words, find_all, java, strip


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it. Null stays null."""
    return _nfc(text)


#: Control, format and unassigned characters but line feed, carriage return, tab.
UNSEEN = r"[\p{C}&&[^\n\r\t]]"


def scrub(text: Column) -> Column:
    """Composed, without control, format and unassigned characters but line feed, carriage
    return and tab (so without joiners, soft hyphens and byte-order marks), ends stripped."""
    return strip(F.regexp_replace(nfc(text), UNSEEN, ""))


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks and tabs to one blank, three or more line feeds to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to the last blank where that is not the first
    character; shorter texts as they are."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.when(F.length(cut) > 0, cut).otherwise(head))


def size_mb(length: Column) -> Column:
    return length / F.lit(1048576.0)


#: Patterns of government-order numbers, by use.
ORDER_NUMBERS = {
    "clean": [r"G\.O\.\s*(?:Ms\.|Rt\.|P\.|No\.?)?\s*\d+", r"GO\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+", r"Government\s+Order\s+(?:No\.?)?\s*\d+"],
    "utils": [r"G\.O\.\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+", r"GO\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+", r"Government Order\s+(?:No\.?)?\s*\d+"],
    "chunk": [r"(?:G\.O\.\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+|GO\s*(?:No\.?)?\s*\d+)"],
    "extended": [r"G\.O\.\s*(?:(?:Ms\.|Rt\.|P\.)\s*)?(?:No\.?)?\s*\d+", r"GO\s*(?:(?:Ms\.|Rt\.)\s*)?(?:No\.?)?\s*\d+", r"Government\s+Order\s+(?:No\.?)?\s*\d+"],
}


def order_numbers(text: Column, use: str = "clean") -> Column:
    """Distinct order numbers, sorted by code points; [] for none, null for null."""
    found = F.concat(*(find_all(text, "(?iu)" + java(p)) for p in ORDER_NUMBERS[use]))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def order_mentions(text: Column) -> Column:
    """Order numbers in order of appearance, repeats kept."""
    return find_all(text, "(?iu)" + java(ORDER_NUMBERS["chunk"][0]))


def approx_tokens(text: Column) -> Column:
    return count_words(text)
