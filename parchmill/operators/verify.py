"""Checks that an answer is grounded in its context: token overlap, entities, sentences.

Everything is an expression over two strings, so a table of any size is one projection.
Defined results: a null or blank answer fails as empty; a null context is a missing one;
an answer without entities or sentences passes those stages; rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import WORD, count_words, find_all, is_blank, java, let, strip
from ..plans.config import NOT_FOUND, PROFILES, Config

#: Words without content.
STOPWORDS = """
a an the is are was were be been being have has had do does did will would shall should may might must can could
of in on at to for with by from as or and but not that this it its which who whom their there they these those
such any all also up into through after before about under above if so than then no yes
""".split()
#: Patterns of checkable facts.
ENTITIES = [
    r"\b\d+(?:\.\d+)?\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\b(?:19|20)\d{2}\b",
    r"(?iu)G\.O\.\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+",
    r"(?iu)GO\s*(?:No\.?)?\s*\d+",
    r"(?iu)(?:Section|Clause|Article|Rule|Chapter)\s+\d+(?:\.\d+)*",
    r"(?iu)\b\d+\s+(?:years?|months?|days?|weeks?|hours?)\b",
    r"Rs\.?\s*\d[\d,]*",
    r"\b\d+(?:\.\d+)?%",
]


def content_tokens(text: Column) -> Column:
    """The distinct words in lower case, without STOPWORDS and single characters."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_except(F.filter(F.array_distinct(find_all(F.lower(text), f"{WORD}+")), lambda w: F.length(w) > 1), stop)


def share(part: Column, whole: Column) -> Column:
    """Of the members of ``whole``, the share also in ``part``; 0 if there are none."""
    return let(whole, lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, part)) / F.size(w)).otherwise(F.lit(0.0)))


def token_overlap(answer: Column, context: Column) -> Column:
    return share(content_tokens(context), content_tokens(answer))


def entities(text: Column) -> Column:
    """Distinct facts in lower case, sorted by code points."""
    found = F.concat(*(find_all(text, java(p)) for p in ENTITIES))
    return F.array_sort(F.array_distinct(F.transform(found, lambda e: F.lower(strip(e)))))


def unsupported(answer_entities: Column, context: Column) -> Column:
    """Facts that are neither facts nor part of the text of the context. Its own facts are
    only looked for where the text lacks some."""
    lacking = let(F.lower(context), lambda low: F.filter(answer_entities, lambda e: ~F.contains(low, e)))
    return let(lacking, lambda m: F.when(F.size(m) > 0, let(entities(context), lambda known: F.filter(m, lambda e: ~F.array_contains(known, e)))).otherwise(m))


def entity_coverage(answer: Column, context: Column) -> Column:
    return let(entities(answer), lambda e: F.when(F.size(e) == 0, F.lit(1.0)).otherwise((F.size(e) - F.size(unsupported(e, context))) / F.size(e)))


def sentences(text: Column) -> Column:
    """Pieces after a full stop, question, exclamation mark or danda, of over three words."""
    return F.filter(F.transform(F.split(text, java(r"(?<=[.!?।])\s+")), strip), lambda s: count_words(s) > 3)


def sentence_coverage(answer: Column, context: Column, cfg: Config = PROFILES["module"]) -> Column:
    enough = lambda known: lambda x: let(content_tokens(x), lambda t: (F.size(t) == 0) | (F.size(F.array_intersect(t, known)) / F.size(t) >= cfg.sentence_overlap))
    ratio = lambda known: let(sentences(answer), lambda s: F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.size(F.filter(s, enough(known))) / F.size(s)))
    return let(content_tokens(context), ratio)


def verify(df: DataFrame, answer: str = "answer", context: str = "context", top_score: str | None = None, cfg: Config = PROFILES["module"]) -> DataFrame:
    """Add passed, verified_answer, confidence, token_overlap, entity_coverage,
    sentence_coverage and failure_reason. The measures of stages not reached are 0."""
    a, c = F.col(answer), F.col(context)
    empty = a.isNull() | is_blank(a)
    unknown = F.contains(F.lower(a), F.lit(NOT_FOUND.lower()))
    trivial = empty | unknown | c.isNull()
    df = df.withColumn("_trivial", trivial)
    df = df.withColumn("_t", F.when(~F.col("_trivial"), token_overlap(a, c)))
    one = F.col("_t") >= cfg.min_overlap
    df = df.withColumn("_ents", F.when(one, entities(a)))
    df = df.withColumn("_bad", F.when(one, unsupported(F.col("_ents"), c)))
    df = df.withColumn("_e", F.when(one, F.when(F.size("_ents") == 0, F.lit(1.0)).otherwise((F.size("_ents") - F.size("_bad")) / F.size("_ents"))))
    two = one & (F.col("_e") >= cfg.min_entities)
    df = df.withColumn("_s", F.when(two, sentence_coverage(a, c, cfg)))
    three = two & (F.col("_s") >= cfg.min_sentences)
    score = F.col("_t") * 40.0 + F.col("_e") * 40.0 + F.col("_s") * 20.0
    if top_score:
        score = F.when(F.col(top_score) > cfg.bonus_above, F.least(F.lit(100.0), score + cfg.bonus)).otherwise(score)
    df = df.withColumn("_c", F.when(three, score))
    four = three & (F.col("_c") >= cfg.min_confidence)
    quoted = F.concat(F.lit("["), F.array_join(F.transform(F.slice("_bad", 1, 3), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    two_places = lambda x: F.format_string("%.2f", x)
    reason = (
        F.when(empty, "Answer is empty.")
        .when(unknown, F.lit(None))
        .when(c.isNull(), "No retrieved chunks to verify against.")
        .when(~one, F.concat(F.lit("Token overlap "), two_places(F.col("_t")), F.lit(f" < threshold {cfg.min_overlap}.")))
        .when(~two, F.concat(F.lit("Entity coverage "), two_places(F.col("_e")), F.lit(" < 0.5. Unsupported: "), quoted))
        .when(~three, F.concat(F.lit("Sentence coverage "), two_places(F.col("_s")), F.lit(" < 0.5.")))
        .when(~four, F.concat(F.lit("Confidence "), F.format_string("%.1f", F.col("_c")), F.lit(f" < threshold {cfg.min_confidence:g}.")))
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    passed = F.coalesce((~empty & unknown) | four, F.lit(False))
    good = F.coalesce(four, F.lit(False))
    return df.withColumns({
        "passed": passed,
        "verified_answer": F.when(good, a).otherwise(F.lit(NOT_FOUND)),
        "confidence": F.when(good, F.round("_c", 2)).otherwise(F.lit(0.0)),
        "token_overlap": zero("_t"), "entity_coverage": zero("_e"), "sentence_coverage": zero("_s"),
        "failure_reason": reason,
    }).drop("_trivial", "_t", "_ents", "_bad", "_e", "_s", "_c")


def citations(retrieved: DataFrame, key: str = "qid") -> DataFrame:
    """One citation per question from its retrieved chunks (rank, chunk_id, section_label,
    page_numbers, go_numbers, score): label of the first rank, all pages sorted, order
    numbers in order of appearance, chunks and scores by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "section_label", "page_numbers", "go_numbers", "score")))
    df = retrieved.groupBy(key).agg(rows.alias("_r"))
    return df.select(
        key,
        F.col("_r")[0]["section_label"].alias("section_label"),
        F.array_sort(F.array_distinct(F.flatten(F.filter(F.col("_r.page_numbers"), lambda x: x.isNotNull())))).alias("page_numbers"),
        F.array_distinct(F.flatten(F.filter(F.col("_r.go_numbers"), lambda x: x.isNotNull()))).alias("go_numbers"),
        F.col("_r.chunk_id").alias("chunk_ids"),
        F.col("_r.score").alias("similarity_scores"),
    )


def format_citation(label: Column, pages: Column, orders: Column) -> Column:
    parts = F.array(
        F.when(F.length(label) > 0, F.concat(F.lit("Section: "), label)),
        F.when(F.size(pages) > 0, F.concat(F.lit("Page: "), F.array_join(pages.cast("array<string>"), ", "))),
        F.when(F.size(orders) > 0, F.concat(F.lit("GO: "), F.array_join(orders, ", "))),
    )
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " | ")
    return F.when(text == "", "Document (section unknown)").otherwise(text)


def status_label(passed: Column) -> Column:
    return F.when(passed, "PASSED ✓").otherwise("FAILED ✗")


def confidence_text(confidence: Column) -> Column:
    return F.concat(F.format_string("%.1f", confidence), F.lit("%"))


def select_answer(df: DataFrame, first: str = "first", second: str = "retry") -> DataFrame:
    """Of two attempts (structs with passed, answer, results and the verification): the
    first if it passed, else the second; the second's results only if the second passed,
    otherwise its verification is shown with the first's results."""
    f, s = F.col(first), F.col(second)
    chosen = F.when(f["passed"], f["answer"]).otherwise(s["answer"])
    return df.withColumns({
        "answer": chosen,
        "passed": F.when(f["passed"], F.lit(True)).otherwise(s["passed"]),
        "confidence": F.when(f["passed"], f["confidence"]).otherwise(s["confidence"]),
        "results": F.when(f["passed"] | ~s["passed"], f["results"]).otherwise(s["results"]),
        "attempt": F.when(f["passed"], F.lit(1)).otherwise(F.lit(2)),
    })
