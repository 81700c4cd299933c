"""Queries of the engine's own operators over whole tables, with their SQL counterparts.

Repeated deliveries of a row count once in every query. Where SQL cannot express an operator
(sequential packing with overlap, models, bytes), the query has none and is tested against a
plain version in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import map_lines, words
from ..operators import chunk, clean, embed, generate, language, vectors, verify
from ..session import spread, table
from ..sources import files, sinks
from . import oracle as O
from . import pipeline
from .config import NOT_FOUND, PROFILES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CFG = PROFILES["module"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- tables, repeated rows counted once


def _pages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "doc_pages")
    return spread(t.select("page_id", "doc_id", "page_number", "text", "is_ocr", "confidence").dropDuplicates(["page_id"]), t)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunks")
    return spread(t.dropDuplicates(["chunk_uid"]), t)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cleaned")
    return spread(t.select("doc_id", F.col("cleaned_text").alias("text")).distinct(), t)


P = "(SELECT DISTINCT page_id, doc_id, page_number, text, is_ocr, confidence FROM doc_pages)"
C = "(SELECT DISTINCT ON (chunk_uid) * FROM chunks)"
D = "(SELECT DISTINCT doc_id, cleaned_text AS text FROM cleaned)"

# ---- vectors


def _query_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose key is divisible by 100, against all."""
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), v


_SCORES = "(SELECT q.vec_id AS qid, e.vec_id, {f}(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) {o}, vec_id) AS rank FROM {s})"
_IP = _RANKED.format(o="DESC", s=_SCORES.format(f="list_inner_product"))
_L2 = _RANKED.format(o="ASC", s="(SELECT qid, vec_id, score * score AS score FROM " + _SCORES.format(f="list_distance") + ")")


@query
def vec_topk_cosine(spark, d):
    q, v = _query_vectors(spark, d)
    return vectors.search(q, v, 5).select("qid", "rank", "vec_id", F.round("score", 4).alias("score"))


_SQL["vec_topk_cosine"] = f"SELECT qid, rank::INT AS rank, vec_id, round(score, 4) AS score FROM {_IP} WHERE rank <= 5"


@query
def vec_topk_threshold(spark, d):
    q, v = _query_vectors(spark, d)
    return vectors.retrieve(q, v, CFG).select("qid", "rank", "vec_id", "score", "score_percent")


_SQL["vec_topk_threshold"] = f"SELECT qid, rank::INT AS rank, vec_id, round(score, 4) AS score, round(round(score, 4) * 100, 2) AS score_percent FROM {_IP} WHERE rank <= 5 AND score >= 0.3"


@query
def vec_topk_l2(spark, d):
    q, v = _query_vectors(spark, d)
    return vectors.search(q, v, 5, "l2").select("qid", "rank", "vec_id", F.round("score", 4).alias("score"))


_SQL["vec_topk_l2"] = f"SELECT qid, rank::INT AS rank, vec_id, round(score, 4) AS score FROM {_L2} WHERE rank <= 5"


@query
def vec_normalize(spark, d):
    v = table(spark, d, "embeddings").withColumn("n", vectors.normalize(F.col("embedding")))
    return v.select("vec_id", F.round(vectors.dot(F.col("n"), F.col("n")), 6).alias("norm2"), F.round(F.col("n")[0], 6).alias("first"), vectors.dimension(F.col("embedding")).alias("dimension"))


_SQL["vec_normalize"] = """SELECT vec_id, round(list_inner_product(n, n), 6) AS norm2, round(n[1], 6) AS first, len(n)::INT AS dimension FROM
 (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings)"""


@query
def vec_cells(spark, d):
    """Approximate search; the tests hold its recall@5 on sf0.1 to 0.9 or more."""
    q, v = _query_vectors(spark, d)
    return vectors.CellIndex(v).search(q, 5).select("qid", "rank", "vec_id", F.round("score", 4).alias("score"))


@query
def vec_cells_recall(spark, d):
    """What vec_cells finds against the exact search: pairs found, whether their scores are
    exact, and whether recall@5 is 0.9 or more."""
    q, v = _query_vectors(spark, d)
    exact = vectors.search(q, v, 5).select("qid", "vec_id", F.lit(1).alias("hit"))
    found = vectors.CellIndex(v).search(q, 5)
    true = found.join(v.select("vec_id", "embedding"), "vec_id").join(q, "qid").withColumn("true", F.abs(vectors.dot(F.col("qvec"), F.col("embedding")) - F.col("score")) < 1e-9)
    return true.join(exact, ["qid", "vec_id"], "left").agg(F.count("*").alias("n_found"), F.bool_and("true").alias("exact_scores"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("recall_reached"))


_SQL["vec_cells_recall"] = "SELECT sum(least(5, n)) AS n_found, true AS exact_scores, true AS recall_reached FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE vec_id % 100 = 0)"


@query
def vec_routed(spark, d):
    """Each question is searched with the vector whose key is its own modulo the table."""
    v = table(spark, d, "embeddings")
    q = table(spark, d, "questions").where("qid % 100 = 0").select("qid", F.coalesce("question_en", "question").alias("question_en")).distinct()
    n = F.lit(v.count())
    q = q.join(v.select(F.col("vec_id"), F.col("embedding").alias("qvec")), F.col("qid") % n == F.col("vec_id")).drop("vec_id")
    out = vectors.retrieve_routed(q, v)
    return out.select("qid", "rank", "vec_id", F.round("score", 4).alias("score"), "first", "retry")


_SQL["vec_routed"] = """WITH n AS (SELECT count(*) AS n FROM embeddings),
 q AS (SELECT DISTINCT qid, coalesce(question_en, question) AS t FROM questions WHERE qid % 100 = 0),
 s AS (SELECT q.qid, t, e.vec_id, list_inner_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q, n, embeddings v, embeddings e WHERE v.vec_id = q.qid % n.n),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vec_id) AS rank, coalesce(lower(t) LIKE '%summary%' OR lower(t) LIKE '%summarise%' OR lower(t) LIKE '%summarize%', false) AS m FROM s),
 f AS (SELECT *, rank <= CASE WHEN m THEN 16 ELSE 5 END AND score >= CASE WHEN m THEN 0.15 ELSE 0.3 END AS first, rank <= 8 AND score >= 0.3 * 0.6 AS retry FROM r)
 SELECT qid, rank::INT AS rank, vec_id, round(score, 4) AS score, first, retry FROM f WHERE first OR retry"""

# ---- cleaning and scalar text functions


@query
def clean_pages(spark, d):
    c = clean.clean(_pages(spark, d))
    return c.select("page_id", "cleaned_text", "original_length", "cleaned_length", "removed_chars", F.round("reduction_percent", 1).alias("reduction_percent"), F.array_join("go_numbers", "; ").alias("go_numbers"))


_SQL["clean_pages"] = f"""SELECT page_id, c9 AS cleaned_text, length(text)::INT AS original_length, length(c9)::INT AS cleaned_length, greatest(0, length(text) - length(c9))::INT AS removed_chars,
 CASE WHEN length(text) = 0 THEN 0.0 ELSE round(round(greatest(0, length(text) - length(c9)) / length(text) * 100, 2), 1) END AS reduction_percent, array_to_string({O.orders("c9")}, '; ') AS go_numbers FROM {O.clean(P)}"""


@query
def clean_lines(spark, d):
    """The steps that blank lines, one after the other."""
    p = _pages(spark, d)
    t = clean.drop_garbled(clean.drop_status_marks(clean.drop_page_numbers(F.col("text"))))
    return p.select("page_id", t.alias("kept"))


_SQL["clean_lines"] = f"SELECT page_id, a3 AS kept FROM (SELECT page_id, {O.blanked('a2', r'^[^\p{L}\p{N}_\n]{1,3}$')} AS a3 FROM (SELECT page_id, {O.blanked('a1', '(?i)^(?:CONFIDENTIAL|DRAFT|RESTRICTED|OFFICIAL USE ONLY|NOT FOR DISTRIBUTION)$')} AS a2 FROM (SELECT page_id, {O.clean_steps('x')[2][1].replace('c2', 'text')} AS a1 FROM {P})))"


@query
def clean_separators(spark, d):
    """Separators and dot runs, over posts, which have both."""
    t = clean.shorten_dots(clean.drop_separators(F.col("text")))
    return table(spark, d, "documents").select("doc_id", t.alias("kept"))


_SQL["clean_separators"] = f"SELECT doc_id, {O.sub(O.sub('text', r'[-_=*~]{5,}', 'chr(10)'), r'\.{4,}', chr(39) + '...' + chr(39))} AS kept FROM documents"


@query
def protected_lines(spark, d):
    p = _pages(spark, d).where("text is not null").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return p.where(clean.is_protected(F.col("line"))).groupBy("page_id").agg(F.count("*").alias("n_protected"), F.min("line_no").alias("first_line"))


_SQL["protected_lines"] = f"SELECT page_id, count(*) AS n_protected, min(i - 1)::INT AS first_line FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {P} WHERE text IS NOT NULL) WHERE {O.protected('line')} GROUP BY page_id"


@query
def scrub_posts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.scrub(F.col("text")).alias("scrubbed"), T.collapse_spaces(F.col("text")).alias("collapsed"))


_SQL["scrub_posts"] = f"SELECT doc_id, {O.nfc_scrub('text')} AS scrubbed, {O.strip(O.sub(O.sub('text', r'[ \t]+', chr(39) + ' ' + chr(39)), r'\n{3,}', 'chr(10)||chr(10)'))} AS collapsed FROM documents"


@query
def word_counts(spark, d):
    return _chunks(spark, d).select("chunk_uid", T.approx_tokens(F.col("text")).alias("n_words"), T.truncate(F.col("text"), 80).alias("short"))


_SQL["word_counts"] = f"""SELECT chunk_uid, len({O.words("text")})::INT AS n_words, CASE WHEN length(text) <= 80 THEN text WHEN regexp_replace(left(text, 80), ' [^ ]*$', '') <> '' THEN regexp_replace(left(text, 80), ' [^ ]*$', '') ELSE left(text, 80) END AS short FROM {C}"""


@query
def go_extract(spark, d):
    return _chunks(spark, d).select("chunk_uid", F.array_join(T.order_numbers(F.col("text")), "; ").alias("numbers"), F.array_join(T.order_mentions(F.col("text")), "; ").alias("mentions"))


_SQL["go_extract"] = f"SELECT chunk_uid, array_to_string({O.orders('text')}, '; ') AS numbers, array_to_string({O.mentions('text')}, '; ') AS mentions FROM {C}"



@query
def go_extract_utils(spark, d):
    """The order numbers of the general patterns, over pages."""
    return _pages(spark, d).select("page_id", F.array_join(T.order_numbers(F.col("text"), "utils"), "; ").alias("numbers"))


_SQL["go_extract_utils"] = f"SELECT page_id, array_to_string({O.orders('text', 'utils')}, '; ') AS numbers FROM {P}"

# ---- sources


@query
def source_checks(spark, d):
    c = files.file_checks(table(spark, d, "source_files").select("doc_id", "path", "length").distinct())
    return c.select("doc_id", "path", "suffix", F.round("size_mb", 6).alias("size_mb"), "reject_reason")


_SQL["source_checks"] = r"""SELECT doc_id, path, s AS suffix, round(length / 1048576.0, 6) AS size_mb,
 CASE WHEN path IS NULL OR path = '' THEN 'missing path' WHEN path LIKE '%/' THEN 'not a file' WHEN s NOT IN ('.pdf', '.txt', '.docx') THEN 'unsupported suffix: ' || s END AS reject_reason
 FROM (SELECT DISTINCT doc_id, path, length, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS s FROM source_files)"""


@query
def source_pages(spark, d):
    """Pages of all files; decoding is tested against the codecs of Python."""
    src = table(spark, d, "source_files").select("doc_id", "path", "length", "content").dropDuplicates(["doc_id", "path"])
    pages, _ = files.extract(src)
    return pages.select("doc_id", "page_number", "text", "is_ocr", "error")


_BYTE = "(instr('0123456789ABCDEF', substr(h, 2 * i::INT + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i::INT + 2, 1)) - 1"
_SQL["source_pages"] = rf"""SELECT doc_id, 1 AS page_number, CASE WHEN s = '.txt' THEN regexp_replace(coalesce(TRY(decode(content)), array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr(({_BYTE})::INT)), '')), '\r\n?', chr(10), 'g') ELSE '' END AS text,
 s = '.pdf' AS is_ocr, CASE WHEN s <> '.txt' THEN 'ValueError: no content' END AS error FROM
 (SELECT *, hex(content) AS h, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS s FROM (SELECT DISTINCT ON (doc_id, path) * FROM source_files)) WHERE s IN ('.pdf', '.txt', '.docx')"""


@query
def doc_raw_text(spark, d):
    return files.documents(_pages(spark, d))


_SQL["doc_raw_text"] = f"SELECT doc_id, coalesce(string_agg(text, chr(10)||chr(10) ORDER BY page_number, text) FILTER (WHERE {O.has('text', f'[^{O.SP}]')}), '') AS raw_text, count(*) AS total_pages, coalesce(bool_or(is_ocr), false) AS used_ocr FROM {P} GROUP BY doc_id"


@query
def scanned_pages(spark, d):
    return _pages(spark, d).select("page_id", files.printable_count(F.col("text")).alias("n_printable"), files.is_scanned(F.col("text")).alias("is_scanned"))


_SQL["scanned_pages"] = f"SELECT page_id, n::INT AS n_printable, n < 30 AS is_scanned FROM (SELECT page_id, length({O.sub('coalesce(text, chr(32))', r'[\p{C}\p{Z}\s]')}) AS n FROM {P})"


@query
def ocr_words(spark, d):
    """Words of every page with made-up confidences, put together again."""
    w = _pages(spark, d).where("text is not null").select("page_id", "page_number", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    w = w.withColumn("conf", (F.col("pos") * 37 + F.col("page_number")) % 103 - 2)
    return files.words_to_page(w, "page_id").select("page_id", "text", F.round("confidence", 4).alias("confidence"))


_SQL["ocr_words"] = f"""SELECT page_id, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE conf >= 0), '') AS text, round(coalesce(avg(conf) FILTER (WHERE conf >= 0), 0.0), 4) AS confidence FROM
 (SELECT *, (pos * 37 + page_number) % 103 - 2 AS conf FROM (SELECT page_id, page_number, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT page_id, page_number, {O.words("text")} AS w FROM {P} WHERE text IS NOT NULL))) GROUP BY page_id"""

# ---- chunking


@query
def section_split(spark, d):
    s = chunk.sections(_cleaned(spark, d))
    return s.select("doc_id", "section_no", "char_start", "label", F.length("body").alias("n_chars"))


def _re2_headings() -> list[str]:
    return [O.re2(p) for p in chunk.HEADINGS]


_LABEL = "coalesce(" + ", ".join(f"nullif(regexp_extract(body, {O.q('^(?:' + p + ')')}), '')" for p in _re2_headings()) + ")"
_SQL["section_split"] = f"""WITH s AS (SELECT doc_id, string_split({O.sub("text", "(?m)^((?:" + "|".join(_re2_headings()) + "))", "chr(1)||'" + chr(92) + "1'")}, chr(1)) AS l FROM {D}),
 p AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS i FROM s),
 o AS (SELECT *, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i) - length(body) AS a FROM p)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS section_no, a::INT AS char_start, CASE WHEN i > 1 THEN {O.strip(_LABEL)} END AS label, length(body)::INT AS n_chars FROM o WHERE {O.has("body", f"[^{O.SP}]")}"""


@query
def sentence_blocks(spark, d):
    """Posts packed by sentences into blocks of at most 400 words."""
    fits = CFG.chunk_max

    @F.pandas_udf("array<string>")
    def pack(texts):
        import pandas as pd

        return pd.Series([None if t is None else list(chunk.packed(chunk._SENTENCE.split(t), " ", lambda x: chunk.size(x) <= fits)) or [t] for t in texts], dtype=object)

    b = table(spark, d, "documents").where("text is not null").withColumn("b", pack("text"))
    return b.select("doc_id", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: F.size(words(x)).cast("string")), ",").alias("sizes"), F.md5(F.array_join("b", "\x01")).alias("digest"))


def _size(x: str) -> str:
    return f"len({O.words(x)})"


_SQL["sentence_blocks"] = f"""WITH s AS (SELECT doc_id, text, {O.sentence_list("text", ".!?।॥")} AS l FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, text, list_reduce(list_transform(l, lambda x: {{'o': CAST([] AS VARCHAR[]), 'c': x}}), lambda a, b: CASE WHEN a.c = '' THEN {{'o': a.o, 'c': b.c}}
  WHEN {_size("a.c || ' ' || b.c")} <= 400 THEN {{'o': a.o, 'c': {O.strip("a.c || ' ' || b.c")}}} ELSE {{'o': list_append(a.o, a.c), 'c': b.c}} END) AS z FROM s),
 f AS (SELECT doc_id, CASE WHEN z.c <> '' THEN list_append(z.o, z.c) WHEN len(z.o) > 0 THEN z.o ELSE [text] END AS b FROM r)
 SELECT doc_id, len(b)::INT AS n_blocks, array_to_string(list_transform(b, lambda x: {_size("x")}::VARCHAR), ',') AS sizes, md5(array_to_string(b, chr(1))) AS digest FROM f"""


@query
def page_map(spark, d):
    return chunk.page_map(_pages(spark, d))


_SQL["page_map"] = f"SELECT doc_id, page_number AS page, (hi - n)::BIGINT AS lo, hi::BIGINT AS hi FROM (SELECT doc_id, page_number, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page_number) AS hi FROM (SELECT doc_id, page_number, coalesce(length(text), 0) + 2 AS n FROM {P}))"


@query
def chunk_pages(spark, d):
    c = _chunks(spark, d).select("doc_id", F.col("chunk_uid").alias("chunk_id"), F.array(F.struct(F.col("char_start").alias("lo"), F.col("char_end").alias("hi"))).alias("spans"))
    out = chunk.with_pages(c, _pages(spark, d))
    return out.select(F.col("chunk_id").alias("chunk_uid"), F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"))


_SQL["chunk_pages"] = f"""WITH m AS ({_SQL["page_map"]}) SELECT c.chunk_uid, coalesce(string_agg(m.page::VARCHAR, ',' ORDER BY m.page) FILTER (WHERE m.page IS NOT NULL), '') AS pages
 FROM {C} c LEFT JOIN m ON m.doc_id = c.doc_id AND c.char_start < m.hi AND c.char_end > m.lo GROUP BY c.chunk_uid"""


@query
def chunk_full(spark, d):
    """Chunks of every cleaned file with their pages; tested against a plain version."""
    out = chunk.with_pages(chunk.chunk(_cleaned(spark, d).where("text is not null")), _pages(spark, d))
    return out.select("doc_id", "chunk_id", "section_label", "char_start", "char_end", "token_count", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"), F.md5("text").alias("digest"))


def _sql_chunks(source: str) -> str:
    return O.chunks(source, _re2_headings(), O.strip(_LABEL), _SQL["page_map"], CFG.chunk_max, CFG.chunk_min, CFG.chunk_overlap)


_SQL["chunk_full"] = f"""{_sql_chunks(D)} SELECT doc_id, chunk_id, label AS section_label, cs AS char_start, ce AS char_end, {_size("text")}::INT AS token_count, pages, md5(text) AS digest FROM done"""


@query
def short_citations(spark, d):
    c = _chunks(spark, d)
    pages = F.coalesce(F.col("page_numbers"), F.array().cast("array<int>"))
    return c.select("chunk_uid", chunk.short_citation(F.col("section_label"), pages, F.col("chunk_id")).alias("citation"))


_SQL["short_citations"] = f"""SELECT chunk_uid, CASE WHEN x = '' THEN 'Chunk ' || chunk_id ELSE x END AS citation FROM (SELECT chunk_uid, chunk_id, concat_ws(' | ', nullif(section_label, ''),
 CASE WHEN len(page_numbers) = 1 THEN 'Page ' || page_numbers[1] WHEN len(page_numbers) > 1 THEN 'Pages ' || page_numbers[1] || '-' || page_numbers[-1] END) AS x FROM {C})"""

# ---- language


@query
def script_language(spark, d):
    return _chunks(spark, d).select("chunk_uid", language.detect(F.col("text")).alias("detected"))


def _count(p: str) -> str:
    return f"coalesce(length(text) - length({O.sub('text', p)}), 0)"


_SQL["script_language"] = rf"SELECT chunk_uid, CASE WHEN t > 0 AND t >= h AND t >= e THEN 'ta' WHEN h > 0 AND h >= e THEN 'hi' ELSE 'en' END AS detected FROM (SELECT chunk_uid, {_count(r'[\x{0B80}-\x{0BFF}]')} AS t, {_count(r'[\x{0900}-\x{097F}]')} AS h, {_count('[A-Za-z]')} AS e FROM {C})"


@query
def ocr_language(spark, d):
    return files.ocr_language(_pages(spark, d), language.detect)


_SQL["ocr_language"] = rf"""WITH f AS (SELECT doc_id, arg_min(text, page_number) AS text FROM {P} WHERE page_number <= 3 AND length(trim(text)) > 20 GROUP BY doc_id),
 n AS (SELECT doc_id, text, {_count(r'[\x{0B80}-\x{0BFF}]')} AS t, {_count(r'[\x{0900}-\x{097F}]')} AS h, {_count('[A-Za-z]')} AS e FROM f)
 SELECT p.doc_id, CASE WHEN text IS NULL THEN 'ta' WHEN t > 0 AND t >= h AND t >= e THEN 'ta' WHEN h > 0 AND h >= e THEN 'hi' ELSE 'en' END AS ocr_lang FROM (SELECT DISTINCT doc_id FROM doc_pages) p LEFT JOIN n ON n.doc_id = p.doc_id"""


@query
def translate_pieces(spark, d):
    """Pieces of at most 500 characters; tested against a plain version."""
    p = language.split_for_translation(table(spark, d, "documents").where("text is not null"), limit=500)
    return p.select("doc_id", F.size("pieces").alias("n_pieces"), F.array_max(F.transform("pieces", F.length)).alias("longest"), F.md5(F.array_join("pieces", "\x01")).alias("digest"))


_SQL["translate_pieces"] = f"""SELECT doc_id, len(p)::INT AS n_pieces, list_max(list_transform(p, lambda x: length(x)))::INT AS longest, md5(array_to_string(p, chr(1))) AS digest FROM
 (SELECT doc_id, {O.translation_pieces("text", 500)} AS p FROM documents WHERE text IS NOT NULL)"""


# ---- questions and answers


@query
def asked_questions(spark, d):
    return pipeline.asked(table(spark, d, "questions").select("qid", "question").distinct())


_SQL["asked_questions"] = f"SELECT DISTINCT qid, question FROM questions WHERE {O.has('question', f'[^{O.SP}]')} AND lower(trim(question)) NOT IN ('exit', 'quit', 'q', 'bye')"


@query
def question_routes(spark, d):
    q = table(spark, d, "questions").select("qid", F.coalesce("question_en", "question").alias("t")).distinct()
    r = vectors.routes(F.col("t"), CFG)
    return q.select("qid", *(c.alias(k) for k, c in r.items()))


_SQL["question_routes"] = """SELECT qid, m AS is_summary, CASE WHEN m THEN 16 ELSE 5 END AS k, CASE WHEN m THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END AS min_score, 8 AS retry_k, 0.18::DOUBLE AS retry_min_score FROM
 (SELECT DISTINCT qid, coalesce(lower(t) LIKE '%summary%' OR lower(t) LIKE '%summarise%' OR lower(t) LIKE '%summarize%', false) AS m, t FROM (SELECT qid, coalesce(question_en, question) AS t FROM questions))"""


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    """The five longest chunks of every file stand for what a question retrieved."""
    c = _chunks(spark, d).where("text is not null").withColumn("n", T.approx_tokens(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "chunk_uid")
    c = c.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return c.select(F.col("doc_id").alias("qid"), "rank", "chunk_id", "text", F.nullif("section_label", F.lit("")).alias("section_label"), F.coalesce("page_numbers", F.array().cast("array<int>")).alias("page_numbers"), T.order_mentions(F.col("text")).alias("go_numbers"), (F.lit(1.0) / F.col("rank")).alias("score"))


_R = f"""(SELECT doc_id AS qid, rank, chunk_id, text, nullif(section_label, '') AS section_label, coalesce(page_numbers, []) AS page_numbers, {O.mentions("text")} AS go_numbers FROM
 (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_size("text")} DESC, chunk_uid) AS rank FROM {C} WHERE text IS NOT NULL) WHERE rank <= 5)"""


@query
def build_context(spark, d):
    c = generate.contexts(_retrieved(spark, d))
    return c.select("qid", "context", generate.prompt(F.col("context"), F.lit("What is due?")).alias("prompt"))


_ENTRY = f"""'[' || rank || '] ' || coalesce(nullif(concat_ws(' | ', section_label, CASE WHEN len(page_numbers) > 0 THEN 'Page(s): ' || array_to_string(page_numbers, ', ') END), ''), 'Chunk ' || chunk_id) || chr(10) || {O.strip("text")}"""
_SQL["build_context"] = f"""SELECT qid, c AS context, 'Document Excerpts:' || chr(10) || c || chr(10) || chr(10) || 'Question: What is due?' || chr(10) || chr(10) || 'Answer (cite the section/clause/GO number if mentioned; use clear numbered points):' AS prompt FROM
 (SELECT qid, string_agg({_ENTRY}, chr(10)||chr(10) ORDER BY rank) AS c FROM {_R} GROUP BY qid)"""


@query
def citations(spark, d):
    c = verify.citations(_retrieved(spark, d))
    return c.select("qid", verify.format_citation(F.col("section_label"), F.col("page_numbers"), F.array_sort("go_numbers")).alias("citation"), F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


_SQL["citations"] = f"""SELECT qid, coalesce(nullif(concat_ws(' | ', 'Section: ' || l, CASE WHEN len(p) > 0 THEN 'Page: ' || array_to_string(p, ', ') END, CASE WHEN len(g) > 0 THEN 'GO: ' || array_to_string(g, ', ') END), ''), 'Document (section unknown)') AS citation, chunk_ids FROM
 (SELECT qid, max(section_label) FILTER (WHERE rank = 1) AS l, list_sort(list_distinct(flatten(list(page_numbers)))) AS p, list_sort(list_distinct(flatten(list(go_numbers)))) AS g, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids FROM {_R} GROUP BY qid)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as an answer; the chunk before and the one after it in the file as the
    contexts of a first try and a retry."""
    w = Window.partitionBy("doc_id").orderBy("chunk_uid")
    return _chunks(spark, d).select("chunk_uid", "doc_id", F.col("text").alias("answer")).withColumns({"context": F.lag("answer").over(w), "later": F.lead("answer").over(w)})


_PAIRS = f"(SELECT chunk_uid, text AS answer, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_uid) AS context, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_uid) AS later FROM {C})"


def _sql_checks(context: str) -> str:
    """Overlap t, coverage e and s of all pairs, not yet short-cut."""
    stop = verify.STOPWORDS
    a, c = O.tokens("answer", stop), O.tokens(context, stop)
    share = lambda x, y: f"CASE WHEN len({x}) > 0 THEN len(list_intersect({x}, {y})) / len({x}) ELSE 0.0 END"
    base = f"(SELECT *, {a} AS ta, {c} AS tc, {O.entities(O.ascii_words('answer'))} AS ea, {O.entities(O.ascii_words(context))} AS ec, list_filter(list_transform({O.sentence_list('answer')}, lambda x: {O.strip('x')}), lambda x: {_size('x')} > 3) AS sl FROM {_PAIRS})"
    token = O.tokens("x", stop)
    return f"""(SELECT *, {share("ta", "tc")} AS t, CASE WHEN len(ea) = 0 THEN 1.0 ELSE len(list_filter(ea, lambda x: list_contains(ec, x) OR contains(lower({context}), x))) / len(ea) END AS e,
 CASE WHEN len(sl) = 0 THEN 1.0 ELSE len(list_filter(sl, lambda x: len({token}) = 0 OR len(list_intersect({token}, tc)) / len({token}) >= 0.4)) / len(sl) END AS s FROM {base})"""


def _sql_verified(context: str) -> str:
    blank = f"(answer IS NULL OR NOT {O.has('answer', f'[^{O.SP}]')})"
    return f"""(SELECT chunk_uid, answer, passed, CASE WHEN passed THEN round(t * 40.0 + e * 40.0 + s * 20.0, 2) ELSE 0.0 END AS confidence, CASE WHEN ok THEN t ELSE 0.0 END AS t, CASE WHEN ok AND t >= 0.4 THEN e ELSE 0.0 END AS e, CASE WHEN ok AND t >= 0.4 AND e >= 0.5 THEN s ELSE 0.0 END AS s FROM
 (SELECT *, NOT {blank} AND {context} IS NOT NULL AS ok, coalesce(NOT {blank} AND {context} IS NOT NULL AND t >= 0.4 AND e >= 0.5 AND s >= 0.5, false) AS passed FROM {_sql_checks(context)}))"""


@query
def verify_full(spark, d):
    v = verify.verify(_pairs(spark, d))
    return v.select("chunk_uid", "passed", F.round("confidence", 1).alias("confidence"), *(F.round(c, 6).alias(c) for c in ("token_overlap", "entity_coverage", "sentence_coverage")), F.md5("verified_answer").alias("answer_digest"))


_SQL["verify_full"] = f"SELECT chunk_uid, passed, round(confidence, 1) AS confidence, round(t, 6) AS token_overlap, round(e, 6) AS entity_coverage, round(s, 6) AS sentence_coverage, md5(CASE WHEN passed THEN answer ELSE {O.q(NOT_FOUND)} END) AS answer_digest FROM {_sql_verified('context')}"


@query
def entity_extract(spark, d):
    return _chunks(spark, d).select("chunk_uid", F.array_join(verify.entities(F.col("text")), "; ").alias("entities"))


_SQL["entity_extract"] = f"SELECT chunk_uid, array_to_string({O.entities(O.ascii_words('text'))}, '; ') AS entities FROM {C}"


@query
def content_tokens(spark, d):
    t = verify.content_tokens(F.col("text"))
    return _chunks(spark, d).select("chunk_uid", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(verify.sentences(F.col("text"))).alias("n_sentences"))


_SQL["content_tokens"] = f"SELECT chunk_uid, array_to_string(list_sort({O.tokens('text', verify.STOPWORDS)}), ' ') AS tokens, coalesce(len(list_filter(list_transform({O.sentence_list('text')}, lambda x: {O.strip('x')}), lambda x: {_size('x')} > 3)), -1)::INT AS n_sentences FROM {C}".replace("coalesce(len(", "(len(").replace("), -1)::INT", "))::INT")


@query
def answer_retry_select(spark, d):
    p = _pairs(spark, d)
    one = verify.verify(p).select("chunk_uid", F.struct("passed", F.col("verified_answer").alias("answer"), "confidence", F.lit("before").alias("results")).alias("first"))
    two = verify.verify(p.drop("context").withColumnRenamed("later", "context")).select("chunk_uid", F.struct("passed", F.col("verified_answer").alias("answer"), "confidence", F.lit("after").alias("results")).alias("retry"))
    out = verify.select_answer(one.join(two, "chunk_uid"))
    return out.select("chunk_uid", "passed", F.round("confidence", 1).alias("confidence"), "results", "attempt")


_SQL["answer_retry_select"] = f"""SELECT a.chunk_uid, a.passed OR b.passed AS passed, round(CASE WHEN a.passed THEN a.confidence ELSE b.confidence END, 1) AS confidence, CASE WHEN a.passed OR NOT b.passed THEN 'before' ELSE 'after' END AS results, CASE WHEN a.passed THEN 1 ELSE 2 END AS attempt
 FROM {_sql_verified("context")} a JOIN {_sql_verified("later")} b ON a.chunk_uid = b.chunk_uid"""


@query
def answer_lines(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_uid", F.array_join(sinks.answer_lines(F.col("text")), "\n").alias("lines"))


_SQL["answer_lines"] = f"SELECT chunk_uid, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE text END AS lines FROM (SELECT chunk_uid, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {O.strip('x')}), lambda x: x <> '') AS l FROM {C} WHERE text IS NOT NULL)"


@query
def index_chunks(spark, d):
    """The whole index: pages to embedded chunks."""
    i = pipeline.build_index(_pages(spark, d))
    return i.select("doc_id", "chunk_id", "section_label", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"), F.size("embedding").alias("dimension"), F.md5("text").alias("digest"))


_RAW = f"(SELECT doc_id, raw_text AS text FROM ({_SQL['doc_raw_text']}) WHERE {O.has('raw_text', f'[^{O.SP}]')})"
_SQL["index_chunks"] = f"{_sql_chunks(f'(SELECT doc_id, c9 AS text FROM {O.clean(_RAW)})')} SELECT doc_id, chunk_id, label AS section_label, pages, {CFG.dimensions} AS dimension, md5(text) AS digest FROM done"


@query
def answers(spark, d):
    """All questions against the index of all chunks, checked and rendered."""
    c = _chunks(spark, d).where("text is not null").select("chunk_uid", "doc_id", "chunk_id", "text", F.nullif("section_label", F.lit("")).alias("section_label"), F.coalesce("page_numbers", F.array().cast("array<int>")).alias("page_numbers"), F.create_map(F.lit("go_numbers"), T.order_mentions(F.col("text"))).alias("metadata"))
    q = table(spark, d, "questions").select("qid", "question").dropDuplicates(["qid"])
    return pipeline.answer_questions(q, embed.embed(c)).select("qid", "lang", "answer", "passed", F.round("confidence", 2).alias("confidence"), "attempt", "rendered")


__all__ = ["map_lines", "oracle_sql", "queries"]
