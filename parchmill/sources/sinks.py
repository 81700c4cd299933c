"""Answers as text, one row per question; write the table to any sink of Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import strip
from ..operators.verify import confidence_text, format_citation, status_label
from ..plans.config import NOT_FOUND

#: Names of the languages.
NAMES = {"en": "English", "ta": "Tamil", "hi": "Hindi"}


def answer_lines(answer: Column) -> Column:
    """The stripped lines that are not blank; the answer itself if there is none."""
    lines = F.filter(F.transform(F.split(answer, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(answer))


def language_name(lang: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.coalesce(names[lang], lang)


def section_line(rank: Column, label: Column, chunk_id: Column, pages: Column, percent: Column) -> Column:
    shown = F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Chunk "), chunk_id.cast("string")))
    numbers = F.coalesce(F.nullif(F.array_join(pages.cast("array<string>"), ", "), F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), shown, F.lit("  |  Page(s): "), numbers, F.lit("  |  Score: "), F.format_string("%.1f", percent), F.lit("%"))


def render(df: DataFrame) -> DataFrame:
    """Add ``rendered``. Takes question, lang, question_en, section_lines (null where nothing
    was retrieved), answer_en, answer, passed, confidence, failure_reason, section_label,
    page_numbers, go_numbers."""
    foreign = F.col("lang") != "en"
    name = language_name(F.col("lang"))
    both = F.when(foreign, F.concat(F.lit("[English Answer]:\n"), F.array_join(answer_lines(F.col("answer_en")), "\n"), F.lit("\n["), name, F.lit(" Answer]:\n")))
    shown = F.concat(F.coalesce(both, F.lit("")), F.array_join(answer_lines(F.col("answer")), "\n"))
    cited = F.when(F.col("passed") & (F.col("confidence") > 0), F.concat(F.lit("Confidence Score : "), confidence_text(F.col("confidence")), F.lit("\nSource Citation  : "), format_citation(F.col("section_label"), F.col("page_numbers"), F.col("go_numbers"))))
    full = F.concat_ws(
        "\n",
        F.concat(F.lit("Question         : "), F.col("question")),
        F.concat(F.lit("Detected Language: "), name, F.lit(" ("), F.col("lang"), F.lit(")")),
        F.when(foreign, F.concat(F.lit("Translated Q     : "), F.col("question_en"))),
        F.lit("Retrieved Sections:"),
        F.array_join("section_lines", "\n"),
        F.lit("Generated Answer:"),
        shown,
        F.concat(F.lit("Verification     : "), status_label(F.col("passed"))),
        F.when(~F.col("passed"), F.concat(F.lit("Failure Reason   : "), F.col("failure_reason"))),
        cited,
    )
    nothing = F.concat_ws("\n", F.concat(F.lit("Question          : "), F.col("question")), F.concat(F.lit("Detected Language : "), name), F.lit("Generated Answer  : " + NOT_FOUND), F.lit("Verification      : N/A (no matching context)"))
    return df.withColumn("rendered", F.when(F.col("section_lines").isNull(), nothing).otherwise(full))
