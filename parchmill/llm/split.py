"""Problem 4: cut oversized texts at natural boundaries.

Word offsets give prefix sums; the boundaries of each strength form a sorted array. The
end of a piece is the last boundary under the limit, found by binary search from the
strongest kind (blank line, line, sentence, clause, word) to the weakest; a kind counts
when it keeps at least half of the room. Where no boundary exists (scripts without
spaces, long codes) the piece is cut hard, never before a combining mark. The next piece
starts ``overlap`` words back, and always after the start of the one before. Where words
cannot give that (the cut is hard, or fewer words lie between), it starts as many characters
back as ``overlap`` words may have at the limits, so that every piece of two or more
characters shares some with the next; these are white space only where a run of it is long.

Defined results: null and blank texts have no pieces; a text within both limits is one
piece, whole; rows may repeat, each is split by itself; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_CHARS, OVERLAP_WORDS = 400, 3200, 40
#: What counts as white space, as a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_WORD = re.compile(r"\S+")
_KINDS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"(?<=[.!?।॥])[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*"),
    re.compile(r"(?<=[,;:])\s+|[，；：、]"),
    re.compile(r"\s+"),
)
_HEADING = re.compile(r"^(?:(?:SECTION|Section|CHAPTER|Chapter|PART|ARTICLE|Article|CLAUSE|Clause|RULE|Rule|SCHEDULE|ANNEXURE|APPENDIX|FORM|G\.O\.)\s.{0,120}|\(?\d{1,3}[.)]\s+\S.{0,120})$", re.M)


def pieces_of(text: str | None, label: str | None = None, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> list[dict]:
    if text is None or not text.strip():
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, n = [a for a, _ in spans], len(text)
    if len(spans) <= max_words and n <= max_chars:
        return [{"piece_no": 0, "piece_start": 0, "piece_end": n, "piece_text": text, "piece_label": label, "piece_tokens": len(spans), "hard_cut": False, "oversized": False}]
    kinds = [[m.end() for m in k.finditer(text)] for k in _KINDS]
    heads = [(m.start(), m.group()) for m in _HEADING.finditer(text)]
    head_at = [p for p, _ in heads]
    out, at = [], 0
    last = spans[-1][1]
    while at < last:
        first = bisect_left(starts, at)
        inside = first and spans[first - 1][1] > at  # the piece opens within a word
        room = max_words - bool(inside)
        top = min(at + max_chars, starts[first + room] if first + room < len(starts) else n)
        hard = False
        if top >= last:
            end = n if n - at <= max_chars else last
        else:
            end = 0
            for ends in kinds:
                i = bisect_right(ends, top) - 1
                if i >= 0 and ends[i] > at + (top - at) // 2:
                    end = ends[i]
                    break
            if not end:
                end, hard = top, True
                while end > at + 1 and unicodedata.combining(text[end]):
                    end -= 1
        body = text[at:end]
        i = bisect_right(head_at, at) - 1
        out.append({"piece_no": len(out), "piece_start": at, "piece_end": end, "piece_text": body, "piece_label": heads[i][1] if i >= 0 else label, "piece_tokens": len(body.split()), "hard_cut": hard, "oversized": True})
        if end >= last:
            break
        if not overlap:
            at = end
            continue
        before = bisect_left(starts, end)
        again = starts[before - overlap] if before >= overlap else 0
        if hard or again <= at:
            chars = -(-overlap * max_chars // max_words)
            stop = min(end, spans[before - 1][1]) if before else end
            if stop <= at or end - stop + chars > max_chars // 2:  # too much white space to go back over
                stop = end
            again = _back(text, max(at, again - 1), stop, chars)
        at = again
    return out


def _back(text: str, after: int, end: int, chars: int) -> int:
    """The place ``chars`` before ``end``, or the nearest that is past ``after`` and not before
    a combining mark."""
    start = max(end - chars, after + 1)
    return next((p for p in chain(range(start, after, -1), range(start + 1, end)) if not unicodedata.combining(text[p])), end)


_PIECES = "array<struct<piece_no:int,piece_start:int,piece_end:int,piece_text:string,piece_label:string,piece_tokens:int,hard_cut:boolean,oversized:boolean>>"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)))


def _with_pieces(df: DataFrame, text: str, label: Column, max_words: int, max_chars: int, overlap: int) -> DataFrame:
    """The rows whose text may be over a limit, with its pieces in ``_p``."""

    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([pieces_of(t, b, max_words, max_chars, overlap) for t, b in zip(texts, labels)], dtype=object)

    return df.where(_large(F.col(text), max_words, max_chars)).withColumn("_p", cut(F.col(text), label))


def _large(text: Column, max_words: int, max_chars: int) -> Column:
    """A text with more than max_words words has at least 2 * max_words + 1 characters."""
    return F.length(text) > min(2 * max_words, max_chars)


def oversized(df: DataFrame, text: str = "text", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The rows whose text was over a limit when it was cut, whatever the number of its pieces;
    a blank text has none and counts by its length."""
    cut = _with_pieces(df, text, F.lit(None).cast("string"), max_words, max_chars, overlap)
    return cut.where(F.coalesce(F.get("_p", F.lit(0))["oversized"], F.length(text) > max_chars)).drop("_p")


def split_oversized(df: DataFrame, text: str = "text", label: str = "section_label", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """One row per piece with piece_no, n_pieces, piece_start, piece_end, piece_text,
    piece_label (the last heading before the piece, else ``label``), piece_tokens, hard_cut,
    oversized (the text was over a limit)."""
    t, own = F.col(text), F.col(label) if label in df.columns else F.lit(None).cast("string")
    names = ["piece_no", "piece_start", "piece_end", "piece_text", "piece_label", "piece_tokens", "hard_cut", "oversized"]
    base = [c for c in df.columns if c not in (*names, "n_pieces")]
    many = _with_pieces(df, text, own, max_words, max_chars, overlap).select(*base, F.size("_p").alias("n_pieces"), F.explode("_p").alias("_q")).select(*base, "n_pieces", "_q.*")
    few = df.where(~_large(t, max_words, max_chars) & t.rlike(f"[^{SPACE}]")).select(*base, F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_no"), F.lit(0).alias("piece_start"), F.length(t).alias("piece_end"), t.alias("piece_text"), own.alias("piece_label"), word_count(t).alias("piece_tokens"), F.lit(False).alias("hard_cut"), F.lit(False).alias("oversized"))
    return many.unionByName(few)
