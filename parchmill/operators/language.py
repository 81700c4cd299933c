"""Language detection and translation of texts, with pluggable back ends.

A back end is a function from a batch of texts to a batch of texts, loaded once in a task.
The built-in detector counts letters of each script; the built-in translator is the
identity. Rows that need no translation never reach Python.

Defined results: null and blank texts are English and translate to themselves; rows may
repeat; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import PROFILES, Config

#: Letters that tell a script.
SCRIPTS = {"ta": r"[\x{0B80}-\x{0BFF}]", "hi": r"[\x{0900}-\x{097F}]", "en": r"[A-Za-z]"}
_PIECE = re.compile(r"(?<=[.!?।॥\n])\s+")


def script_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in SCRIPTS.items()}


def detect(text: Column) -> Column:
    """'ta' or 'hi' where letters of their script are at least as many as Latin ones, the
    more frequent of both; 'en' otherwise."""
    n = {k: F.coalesce(c, F.lit(0)) for k, c in script_counts(text).items()}
    return F.when((n["ta"] > 0) & (n["ta"] >= n["hi"]) & (n["ta"] >= n["en"]), "ta").when((n["hi"] > 0) & (n["hi"] >= n["en"]), "hi").otherwise("en")


#: Detectors that run in Python: a loader of a function from texts to codes.
DETECTORS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def with_language(df: DataFrame, text: str, out: str = "lang", cfg: Config = PROFILES["module"]) -> DataFrame:
    """Add ``out`` by the detector of the settings; 'script' is the native expression."""
    if cfg.detector == "script":
        return df.withColumn(out, detect(F.col(text)))
    if cfg.detector not in DETECTORS:
        raise ValueError(f"unknown detector {cfg.detector!r}")
    load = DETECTORS[cfg.detector]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()  # once for all batches of a task
        for texts in batches:
            yield pd.Series(f(list(texts)), dtype=object)

    return df.withColumn(out, run(F.col(text)))


def translate_pieces(text: str | None, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, at sentence ends or line feeds; longer
    sentences are cut hard."""
    if text is None:
        return []
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    held = ""
    for s in _PIECE.split(text):
        if len(held) + len(s) + 1 <= limit:
            held = f"{held} {s}".strip()
            continue
        if held:
            out.append(held)
        whole = max(0, (len(s) - 1) // limit)
        out += [s[i * limit : (i + 1) * limit] for i in range(whole)]
        held = s[whole * limit :]
    return [*out, held] if held else out


def split_for_translation(df: DataFrame, text: str = "text", limit: int = PROFILES["module"].translate_max_chars, out: str = "pieces") -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([translate_pieces(t, limit) for t in texts], dtype=object)

    return df.withColumn(out, run(F.col(text)))


TRANSLATORS: dict[str, Callable[[], Callable[[list[str], str, str], list[str]]]] = {"identity": lambda: lambda texts, source, target: texts}


#: Characters of a piece, for translators that take fewer than the settings allow.
MOST_CHARS: dict[str, int] = {}


def translate(df: DataFrame, text: str, source: Column, target: Column, out: str, cfg: Config = PROFILES["module"]) -> DataFrame:
    """Add ``out``: the text in the target language, piece by piece, joined by blanks. Texts
    already in it, and blank ones, are taken as they are. Unknown back ends are errors."""
    if cfg.translator not in TRANSLATORS:
        raise ValueError(f"unknown translator {cfg.translator!r}")
    load, limit = TRANSLATORS[cfg.translator], MOST_CHARS.get(cfg.translator, cfg.translate_max_chars)
    if cfg.translator == "identity":
        return df.withColumn(out, F.col(text))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = load()
        for texts, source, target in batches:
            yield pd.Series([None if t is None else " ".join(f(translate_pieces(t, limit), a, b)) for t, a, b in zip(texts, source, target)], dtype=object)

    need = (source != target) & F.col(text).rlike(r"\S")
    as_is = df.where(~F.coalesce(need, F.lit(False))).withColumn(out, F.col(text))
    return as_is.unionByName(df.where(need).withColumn(out, run(F.col(text), source, target)))


def to_english(df: DataFrame, text: str, lang: str, out: str, cfg: Config = PROFILES["module"]) -> DataFrame:
    return translate(df, text, F.col(lang), F.lit("en"), out, cfg)


def from_english(df: DataFrame, text: str, lang: str, out: str, cfg: Config = PROFILES["module"]) -> DataFrame:
    return translate(df, text, F.lit("en"), F.col(lang), out, cfg)


__all__ = ["DETECTORS", "SCRIPTS", "TRANSLATORS", "detect", "with_language", "from_english", "script_counts", "split_for_translation", "to_english", "translate", "translate_pieces"]
