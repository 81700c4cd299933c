"""Regular expressions that mean the same in the JVM as in the text model of this project.

Character classes are spelled out, as the JVM's own ones are ASCII or count combining marks
as letters. SPACE is Unicode white space with the separators U+001C to U+001F; WORD is a
letter, a number or the underscore, without combining marks; EDGE is a change between WORD
and anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The members of the white-space class.
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java(pattern: str) -> str:
    r"""A pattern written with \s \S \w \d \b in the JVM's dialect. Inside a bracket only
    \s, \w and \d may be used."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            k = pattern[i + 1]
            full = {"s": SPACE, "S": NOT_SPACE, "w": WORD, "W": r"[^\p{L}\p{N}_]", "d": DIGIT, "b": EDGE}
            part = {"s": SPACE_SET, "w": r"\p{L}\p{N}_", "d": DIGIT}
            out.append((part if inside else full).get(k, "\\" + k))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE)


def words(text: Column) -> Column:
    """The pieces between white space."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def count_words(text: Column) -> Column:
    """Number of pieces between white space; 0 for an empty text, null for null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def map_lines(text: Column, f) -> Column:
    """Each line rewritten by f; lines end at a line feed only."""
    return F.array_join(F.transform(F.split(text, "\n"), f), "\n")


def let(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it within other lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)
