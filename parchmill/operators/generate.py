"""Context, prompt and answer of a question.

Readers are pluggable: a function from (system prompt, prompt, question, context) to a text,
loaded once in a task. The built-in reader quotes the sentences of the context that share
most words with the question. A reader that fails gives NOT_FOUND and the error's text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import is_blank, strip
from ..plans.config import NOT_FOUND, PROFILES, SYSTEM_PROMPT, USER_PROMPT, Config


def context_entry(rank: Column, label: Column, pages: Column, chunk_id: Column, text: Column) -> Column:
    """'[rank] label | Page(s): a, b', or '[rank] Chunk id', and the text on the next line."""
    numbers = F.when(F.size(pages) > 0, F.concat(F.lit("Page(s): "), F.array_join(pages.cast("array<string>"), ", ")))
    head = F.concat_ws(" | ", F.nullif(label, F.lit("")), numbers)
    head = F.when(head == "", F.concat(F.lit("Chunk "), chunk_id.cast("string"))).otherwise(head)
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), head, F.lit("\n"), strip(text))


def contexts(retrieved: DataFrame, key: str = "qid") -> DataFrame:
    """(key, context, context_text): entries by rank with a blank line between; the second
    is the texts alone with blanks between, as the checks take it."""
    entry = context_entry(F.col("rank"), F.col("section_label"), F.col("page_numbers"), F.col("chunk_id"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"), "text")))
    return retrieved.groupBy(key).agg(rows.alias("_r")).select(key, F.array_join("_r.entry", "\n\n").alias("context"), F.array_join("_r.text", " ").alias("context_text"))


def prompt(context: Column, question: Column) -> Column:
    head, rest = USER_PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def system_prompt(profile: str = "module", total_pages: int = 1) -> str:
    """The notebook profile asks for summaries that grow with the number of pages."""
    if profile == "module":
        return SYSTEM_PROMPT
    least, most = max(7, 5 + 2 * total_pages), max(10, max(7, 5 + 2 * total_pages) + 3 * total_pages)
    return SYSTEM_PROMPT.replace("between 7 and 10 lines — no fewer than 7, no more than 10", f"between {least} and {most} lines — no fewer than {least}, no more than {most}")


def _quote(system: str, prompt: str, question: str, context: str) -> str:
    asked = set(re.findall(r"\w+", question.lower()))
    best = sorted(((-len(asked & set(re.findall(r"\w+", s.lower()))), i, s.strip()) for i, s in enumerate(re.split(r"(?<=[.!?।])\s+", context)) if s.strip()), key=lambda x: x[:2])[:3]
    return " ".join(s for n, _, s in sorted(best, key=lambda x: x[1]) if n < 0)


READERS: dict[str, Callable[[], Callable[[str, str, str, str], str]]] = {"extractive": lambda: _quote}


def generate(df: DataFrame, question: str = "question_en", context: str = "context", plain: str = "context_text", cfg: Config = PROFILES["module"], system: str = SYSTEM_PROMPT) -> DataFrame:
    """Add answer and error. No context, a failure or a blank answer give NOT_FOUND."""
    if cfg.reader not in READERS:
        raise ValueError(f"unknown reader {cfg.reader!r}")
    load = READERS[cfg.reader]

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        read = load()  # once for all batches of a task
        for p, q, c in batches:
            out = []
            for a, b, t in zip(p, q, c):
                try:
                    out.append((read(system, a, b or "", t), None) if t is not None else (None, None))
                except Exception as e:  # the reader is foreign code
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["answer", "error"])

    df = df.withColumn("_a", run(prompt(F.col(context), F.col(question)), F.col(question), F.col(plain)))
    answer = strip(F.col("_a.answer"))
    return df.withColumn("answer", F.when(answer.isNull() | is_blank(answer), NOT_FOUND).otherwise(answer)).withColumn("error", F.col("_a.error")).drop("_a")
