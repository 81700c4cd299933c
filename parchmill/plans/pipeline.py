"""The two pipelines: files to an index of chunks, and questions to checked answers.

Both work on whole tables: many documents and many questions in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import is_blank
from ..operators import chunk, clean, embed, generate, language, vectors, verify
from ..sources import files, sinks
from ..session import cut, small_batches
from .config import PROFILES, Config

#: Words that end a dialogue.
EXIT_WORDS = ("exit", "quit", "q", "bye")


def build_index(pages: DataFrame, cfg: Config = PROFILES["module"]) -> DataFrame:
    """(chunk_uid, doc_id, chunk_id, text, section_label, page_numbers, metadata, embedding)
    of all pages: joined by document, translated, cleaned, cut into chunks, embedded. Without
    a translator pages are cleaned by themselves and stream into the chunks of their
    document, so that none is a row."""
    text, size = F.col("text"), F.coalesce(F.length("text"), F.lit(0))
    shown = text.isNotNull() & ~is_blank(text)
    parts = pages.select("doc_id", F.col("page_number").alias("number"), F.when(shown, text).alias("order"), size.alias("size"))
    if cfg.translator == "identity":
        parts = parts.withColumn("part", clean.clean_part(F.col("order")))
    else:  # translators take a document's text as a whole
        docs, _ = files.split_empty(files.documents(pages))
        docs = language.to_english(language.with_language(docs, "raw_text", cfg=cfg), "raw_text", "lang", "text", cfg)
        docs = docs.select("doc_id", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("order"), F.lit(-2).alias("size"), clean.clean_part(text).alias("part"))
        parts = docs.unionByName(parts.withColumns({"order": F.lit(None).cast("string"), "part": F.lit(None).cast("string")}))
    chunks = chunk.chunk_parts(parts, clean.join_parts, cfg=cfg)
    chunks = chunks.withColumn("chunk_uid", F.xxhash64("doc_id", "chunk_id"))
    return embed.embed(chunks, cfg=cfg)


def asked(questions: DataFrame, text: str = "question") -> DataFrame:
    """Questions that are neither blank nor an exit word."""
    q = F.col(text)
    return questions.where(q.isNotNull() & ~is_blank(q) & ~F.lower(F.trim(q)).isin(*EXIT_WORDS))


def answer_questions(questions: DataFrame, index: DataFrame, cfg: Config = PROFILES["module"]) -> DataFrame:
    """(qid, question, lang, question_en, answer, passed, confidence, attempt, rendered) of
    every question asked. Both tries share one search; questions of one English text share
    their answer, and the retry is made for those whose first try failed."""
    q = language.with_language(asked(questions).select("qid", "question"), "question", cfg=cfg)
    q = language.to_english(q, "question", "lang", "question_en", cfg)
    q = cut(q.withColumn("ask", F.min("qid").over(Window.partitionBy("question_en"))))
    asks = q.where("qid = ask").select("qid", "question_en").dropDuplicates(["qid"])
    asks = cut(embed.embed(asks, "question_en", "qvec", cfg))
    found = vectors.retrieve_routed(asks, index, cfg=cfg, key="chunk_uid")
    body = index.select("chunk_uid", "chunk_id", "text", "section_label", "page_numbers", F.element_at("metadata", F.lit("go_numbers")).alias("go_numbers"))
    found = cut(found.withColumn("score", F.round("score", 4)))
    tries = {}
    for name in ("first", "retry"):
        due = asks.select("qid", "question_en")
        r = found.where(name)
        if name == "retry":
            failed = tries["first"].where("not first.passed").select("qid")
            if failed.isEmpty():
                break
            due, r = due.join(failed, "qid", "left_semi"), r.join(failed, "qid", "left_semi")
        w = Window.partitionBy("qid").orderBy("rank")
        r = cut(r.withColumn("rank", F.row_number().over(w)).join(body, "chunk_uid"))
        line = sinks.section_line(F.col("rank"), F.col("section_label"), F.col("chunk_id"), F.col("page_numbers"), F.round(F.col("score") * 100, 2))
        lines = r.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("section_lines"), F.max_by("score", -F.col("rank")).alias("top_score"))
        t = due.join(generate.contexts(r), "qid", "left").join(lines, "qid", "left").join(verify.citations(r), "qid", "left")
        t = verify.verify(generate.generate(t, cfg=cfg), context="context_text", top_score="top_score", cfg=cfg)
        fields = ["passed", F.col("verified_answer").alias("answer"), "confidence", "failure_reason", F.struct("section_lines", "section_label", "page_numbers", "go_numbers").alias("results")]
        with small_batches(questions.sparkSession):  # a reader's row holds the texts of all chunks found
            tries[name] = cut(t.select("qid", F.struct(*fields).alias(name)))
    both = q.join(tries["first"].withColumnRenamed("qid", "ask"), "ask")
    if "retry" in tries:
        both = both.join(tries["retry"].withColumnRenamed("qid", "ask"), "ask", "left")
    else:
        both = both.withColumn("retry", F.lit(None).cast(both.schema["first"].dataType))
    both = both.drop("ask")
    none = F.col("first.results.section_lines").isNull()
    out = verify.select_answer(both).withColumn("failure_reason", F.when(F.col("first.passed"), F.lit(None)).otherwise(F.col("retry.failure_reason")))
    out = out.withColumn("results", F.when(none, F.col("first.results")).otherwise(F.col("results"))).select("qid", "question", "lang", "question_en", F.col("answer").alias("answer_en"), "passed", "confidence", "failure_reason", "attempt", "results.*")
    out = language.from_english(out, "answer_en", "lang", "answer", cfg)
    return sinks.render(out)
