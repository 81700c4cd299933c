"""Queries of the operators in this folder, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scan, table
from . import abuse, language, leak, lookalike, neardup, scans, sentences, split, tokenize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = scan(spark, d, "cleaned").select(F.lit("cleaned").alias("tbl"), F.col("doc_id").alias("rec"), F.col("cleaned_text").alias("text"))
    b = scan(spark, d, "doc_pages").select(F.lit("doc_pages").alias("tbl"), F.col("page_id").alias("rec"), "text")
    return lookalike.look_alike_pairs(lookalike.same_form(spark, a.unionByName(b)), "rec")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_classes(scan(spark, d, "chunks"), "chunk_uid", run=3, min_words=20, threshold=0.5)
    return neardup.near_pairs(members, links, "chunk_uid")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(scan(spark, d, "chunks"), "chunk_uid", run=3, min_words=20, threshold=0.5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(spark, scan(spark, d, "doc_pages"))


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_pages(spark, scan(spark, d, "doc_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(scan(spark, d, "chunks").select("chunk_uid", "text")).select("chunk_uid").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    out = split.split_oversized(scan(spark, d, "chunks").select("chunk_uid", "text", "section_label"))
    return out.select("chunk_uid", "piece_no", "n_pieces", "piece_start", "piece_end", "piece_text", "piece_label", "piece_tokens", "hard_cut").dropDuplicates(["chunk_uid", "piece_no"])


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every chunk's pieces must hold: within the limits, from the start to the last word
    without a gap, some of the text in both of any two neighbours, and the text as it is."""
    chunks = scan(spark, d, "chunks").select("chunk_uid", "text").dropDuplicates(["chunk_uid"])
    p = split.split_oversized(chunks)
    w = Window.partitionBy("chunk_uid").orderBy("piece_no")
    p = p.withColumn("before", F.lag("piece_end").over(w))
    long = (F.length("piece_text") > split.MAX_CHARS) | (split.word_count(F.col("piece_text")) > split.MAX_WORDS)
    own = F.expr("substring(text, piece_start + 1, piece_end - piece_start)") == F.col("piece_text")
    return p.groupBy("chunk_uid").agg(
        (F.count("*") > 1).alias("is_cut"), F.bool_and(~long).alias("within_limits"), F.bool_and(F.coalesce(F.col("piece_start") < F.col("before"), F.col("piece_start") == 0)).alias("overlapping"),
        F.bool_or(F.length(F.expr("substring(text, piece_end + 1)")) == 0).alias("to_the_end"), F.bool_and(own).alias("as_written"), F.bool_and(F.col("piece_tokens") == split.word_count(F.col("piece_text"))).alias("counted"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tagger = sentences.fit(table(spark, d, "lang_samples"))
    out = sentences.unit_ends(spark, scan(spark, d, "chunks").select("chunk_uid", "text"), tagger)
    return out.select("chunk_uid", F.explode("ends").alias("sent_end")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fitted = language.fit(table(spark, d, "lang_samples"))
    return language.relabel(spark, _records(spark, d), fitted, scanned="scanned").select("tbl", "rec_id", "lang").distinct()


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    fitted = language.fit(table(spark, d, "lang_samples"))
    out = language.segments(spark, _records(spark, d), fitted, scanned="scanned")
    return out.select("tbl", "rec_id", F.explode("segments").alias("s")).select("tbl", "rec_id", "s.seg_no", "s.lang", "s.sentences", F.round("s.confidence", 6).alias("confidence"), "s.chars").dropDuplicates(["tbl", "rec_id", "seg_no"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    a = scan(spark, d, "doc_pages").select(F.lit("doc_pages").alias("tbl"), F.col("page_id").alias("rec_id"), "lang", "text", F.lit(True).alias("scanned"))
    b = scan(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_uid").alias("rec_id"), "lang", "text", F.lit(False).alias("scanned"))
    return a.unionByName(b)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(spark, scan(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(scan(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    posts = scan(spark, d, "documents").select("doc_id", "text")
    return abuse.score_posts(spark, posts, labels=table(spark, d, "abuse_labels")).where("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_posts(spark, scan(spark, d, "documents").select("doc_id", "source", "text"), labels=table(spark, d, "abuse_labels")).select("doc_id", "source", F.round("score", 6).alias("score")).dropDuplicates(["doc_id"])


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    posts = scan(spark, d, "documents").select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    return abuse.rates(abuse.score_posts(spark, posts, labels=table(spark, d, "abuse_labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Those results that SQL can express. White space is spelled out, as DuckDB's own class
    is ASCII."""
    space = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    words = f"regexp_extract_all(lower(text), '[^{space}]+')"
    runs = f"""w AS (SELECT chunk_uid, w FROM (SELECT DISTINCT chunk_uid, {words} AS w FROM chunks WHERE text IS NOT NULL) WHERE len(w) >= 20),
 s AS (SELECT DISTINCT chunk_uid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT chunk_uid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 n AS (SELECT chunk_uid, count(*) AS n FROM s GROUP BY chunk_uid),
 b AS (SELECT x.chunk_uid AS a, y.chunk_uid AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.chunk_uid < y.chunk_uid GROUP BY ALL),
 f AS (SELECT b.a AS chunk_a, b.b AS chunk_b FROM b JOIN n p ON p.chunk_uid = b.a JOIN n q ON q.chunk_uid = b.b WHERE k >= 0.5 * (p.n + q.n - k))"""
    return {
        "p2_found": f"WITH {runs} SELECT chunk_a, chunk_b FROM f",
        "p2_groups": f"""WITH RECURSIVE {runs}, e AS (SELECT chunk_a AS a, chunk_b AS b FROM f UNION SELECT chunk_b, chunk_a FROM f),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 t AS (SELECT DISTINCT chunk_uid, text FROM chunks),
 l AS (SELECT e.a, count(DISTINCT y.text) AS n FROM e JOIN t x ON x.chunk_uid = e.a JOIN t y ON y.chunk_uid = e.b WHERE x.text <> y.text GROUP BY e.a)
 SELECT c.chunk_uid, coalesce(least(g.m, c.chunk_uid), c.chunk_uid) AS group_id, coalesce(l.n, 0) AS n_links FROM (SELECT DISTINCT chunk_uid FROM chunks) c
 LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) g ON g.a = c.chunk_uid LEFT JOIN l ON l.a = c.chunk_uid""",
        "p4_checks": f"SELECT chunk_uid, length(text) > 3200 OR len({words}) > 400 AS is_cut, true AS within_limits, true AS overlapping, true AS to_the_end, true AS as_written, true AS counted FROM (SELECT DISTINCT chunk_uid, text FROM chunks) WHERE len({words}) > 0",
        "p4_found": f"SELECT DISTINCT chunk_uid FROM chunks WHERE length(text) > 3200 OR len({words}) > 400",
    }
