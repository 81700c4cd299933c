"""Structure-aware chunks of a document, and their pages.

Headings split a text into sections (native expressions). Packing a section's blocks under a
word limit, with overlap and merging of small pieces, depends on the piece before, so it
runs as one Arrow function over a document's sections, linear in the document's length.
Pages come from a range join on the document with the running offsets of its pages.

Defined results: null and blank texts have no chunks; a text without headings is one
section; documents whose pages are missing get chunks without pages; rows may repeat.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import is_blank, java
from ..functions.text import order_mentions
from ..plans.config import PROFILES, Config

#: Heading lines; the first that matches names the section.
HEADINGS = [
    r"G\.O\.\s*(?:Ms\.|Rt\.|P\.|No\.?)?\s*\d+[^\n]*",
    r"GO\s*(?:Ms\.|Rt\.|No\.?)?\s*\d+[^\n]*",
    r"CHAPTER\s+[IVXLCDM0-9]+\b[^\n]*",
    r"Chapter\s+[IVXLCDM0-9]+\b[^\n]*",
    r"PART\s+[IVXLCDM0-9]+\b[^\n]*",
    r"SECTION\s+\d+(?:\.\d+)*\b[^\n]*",
    r"Section\s+\d+(?:\.\d+)*\b[^\n]*",
    r"ARTICLE\s+\d+(?:\.\d+)*\b[^\n]*",
    r"Article\s+\d+(?:\.\d+)*\b[^\n]*",
    r"CLAUSE\s+\d+(?:\.\d+)*\b[^\n]*",
    r"Clause\s+\d+(?:\.\d+)*\b[^\n]*",
    r"RULE\s+\d+(?:\.\d+)*\b[^\n]*",
    r"Rule\s+\d+(?:\.\d+)*\b[^\n]*",
    r"\d{1,3}\.\s+[A-Z][^\n]{5,}",
    r"\(\d+\)\s+[A-Z][^\n]{5,}",
    r"Notification\s+No\.\s*\d+[^\n]*",
    r"NOTIFICATION\s+No\.\s*\d+[^\n]*",
    r"Circular\s+No\.\s*\d+[^\n]*",
    r"SCHEDULE\s+[IVXLCDM0-9]*\b[^\n]*",
    r"THE\s+[A-Z ]{4,}\s+ACT[,\s]\d{4}[^\n]*",
]
#: A character that no text holds stands before each heading.
MARK = "\uffff"
_ANY = "(?md)^(?=" + "|".join(java(p) for p in HEADINGS) + ")"


def pieces(text: Column) -> Column:
    """The text cut before every heading line; the first piece may be empty. A heading that
    runs over a line end into another of the same kind counts as two."""
    return F.split(F.regexp_replace(text, _ANY, MARK), MARK)


def heading(piece: Column) -> Column:
    """The heading line a piece begins with, stripped; null for a preamble."""
    first = [F.nullif(F.regexp_extract(piece, "^(?:" + java(p) + ")", 0), F.lit("")) for p in HEADINGS]
    return F.regexp_replace(F.coalesce(*first), java(r"^\s+|\s+$"), "")


def sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, char_start, label, body): sections that are not blank, numbered by
    place; offsets are those of the text."""
    parts = df.select(key, F.posexplode(pieces(F.col(text))).alias("place", "body"))
    w = Window.partitionBy(key).orderBy("place")
    parts = parts.withColumn("char_start", F.sum(F.length("body")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body"))
    parts = parts.withColumn("label", F.when(F.col("place") > 0, heading(F.col("body")))).where(~is_blank(F.col("body")))
    return parts.select(key, (F.row_number().over(w) - 1).alias("section_no"), F.col("char_start").cast("int").alias("char_start"), "label", "body")


#: Characters of a document whose pages and spans are joined together.
PAGE_BUCKET = 8192
_SENTENCE = re.compile(r"(?<=[.!?।॥])\s+")
_PARAGRAPH = re.compile(r"\n{2,}")


def size(text: str) -> int:
    return len(text.split())


def packed(parts, glue: str, fits, oversized=None):
    """Consecutive parts joined while the whole fits; a part that alone does not fit goes to
    ``oversized``, or stays whole, and nothing is packed across it."""
    held = ""
    for part in parts:
        whole = (held + glue + part).strip() if held else part
        if fits(whole):
            held = whole
            continue
        if held:
            yield held
        held = part
        if oversized is not None and not fits(part):
            yield from oversized(part)
            held = ""
    if held:
        yield held


def blocks(section: str, limit: int) -> list[str]:
    """A section in blocks of at most ``limit`` words: by paragraphs, then by sentences."""
    fits = lambda t: size(t) <= limit
    if fits(section):
        return [section]
    by_sentence = lambda p: list(packed(_SENTENCE.split(p), " ", fits)) or [p]
    return list(packed(_PARAGRAPH.split(section), "\n\n", fits, by_sentence)) or [section]


def assemble(parts: list[str], labels: list[str | None], cfg: Config) -> list[dict]:
    """The chunks of one document. ``spans`` are the ranges whose pages a chunk has: its own
    and those of chunks it absorbed; text merged without a range adds none."""
    out: list[dict] = []
    tail, start, number = "", 0, 0
    for body, label in zip(parts, labels):
        at, start = start, start + len(body)
        if not body.strip():
            continue
        for i, block in enumerate(blocks(body, cfg.chunk_max)):
            text = block.strip()
            if tail and not i:
                text = tail + "\n\n" + text
            if not text.strip():
                continue
            if not i and out and size(text) < cfg.chunk_min:
                out[-1]["text"] += "\n\n" + text
                continue
            a = at + body.find(block)
            out.append({"chunk_id": number, "text": text, "section_label": label, "char_start": a, "char_end": a + len(block), "spans": [{"lo": a, "hi": a + len(block)}]})
            number += 1
            tail = " ".join(text.split()[-cfg.chunk_overlap :])
    return merge_small(out, cfg)


def merge_small(chunks: list[dict], cfg: Config) -> list[dict]:
    """A chunk that is small and has no label absorbs the next, which loses its label."""
    out: list[dict] = []
    for c in chunks:
        if out and not out[-1]["section_label"] and size(out[-1]["text"]) < cfg.chunk_min:
            last = out[-1]
            last["text"] += "\n\n" + c["text"]
            last["char_end"] = c["char_end"]
            last["spans"] = last["spans"] + c["spans"]
        else:
            out.append(dict(c))
    for c in out:
        c["token_count"] = size(c["text"])
    return out


_CHUNK = "array<struct<chunk_id:int,text:string,section_label:string,char_start:int,char_end:int,token_count:int,spans:array<struct<lo:int,hi:int>>>>"


def chunk(df: DataFrame, key: str = "doc_id", text: str = "text", cfg: Config = PROFILES["module"]) -> DataFrame:
    """(key, chunk_id, text, section_label, char_start, char_end, token_count, spans,
    metadata) of every document. Identifiers are given before small chunks are merged, so
    they may have gaps."""

    @F.pandas_udf(_CHUNK)
    def run(parts: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([[] if p is None else assemble(list(p), list(b), cfg) for p, b in zip(parts, labels)], dtype=object)

    body = F.col(text)
    rows = df.where(body.isNotNull() & ~is_blank(body)).select(key, pieces(body).alias("_p"))
    rows = rows.withColumn("_l", F.transform("_p", lambda p, i: F.when(i > 0, heading(p))))
    rows = rows.select(key, F.explode(run("_p", "_l")).alias("c")).select(key, "c.*")
    return rows.withColumn("metadata", F.create_map(F.lit("go_numbers"), order_mentions(F.col("text"))))


_AT_HEADING = re.compile("(?m)^(?=" + "|".join(HEADINGS) + ")")
_EACH_HEADING = [re.compile(p) for p in HEADINGS]


def heading_of(piece: str) -> str | None:
    return next((m.group().strip() for p in _EACH_HEADING if (m := p.match(piece))), None)


def pages_of(spans: list[dict], numbers: list[int | None], edges: list[int]) -> list[int | None]:
    """The pages that spans overlap, in order of spans, each once. Page i goes from edges[i]
    to edges[i + 1]."""
    out: dict[int | None, None] = {}
    for s in spans:
        lo, hi = max(0, bisect_right(edges, s["lo"]) - 1), bisect_left(edges, s["hi"])
        out |= dict.fromkeys(sorted((n for n, a, b in zip(numbers[lo:hi], edges[lo:hi], edges[lo + 1 : hi + 1]) if s["lo"] < b and s["hi"] > a), key=lambda n: (n is not None, n)))
    return list(out)


#: Chunks that leave Python at a time.
OUT_ROWS = 500


def chunk_parts(parts: DataFrame, join: Callable[[list], str], key: str = "doc_id", cfg: Config = PROFILES["module"]) -> DataFrame:
    """What with_pages(chunk(..)) gives, without ``spans``, from documents in parts: rows of
    (key, number, order, size, part), where ``join`` makes a document's text of its parts by
    number and order, and ``size`` is the length of the page that the part was. Parts stream
    into Python, sorted; it holds one document at a time, and the JVM none."""
    kind = parts.schema[key].dataType.simpleString()

    def of_document(numbers: list, sizes: list[int], texts: list) -> list[dict]:
        text = join(texts)
        if not text:
            return []
        bodies = _AT_HEADING.split(text)
        rows = assemble(bodies, [heading_of(b) if i else None for i, b in enumerate(bodies)], cfg)
        edges = [0]
        for n in sizes:
            edges.append(edges[-1] + n + 2)
        for r in rows:
            r["page_numbers"] = pages_of(r.pop("spans"), numbers, edges)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        schema = None

        def full(doc, numbers, sizes, texts):
            ready.extend({key: doc} | r for r in of_document(numbers, sizes, texts))
            while len(ready) >= OUT_ROWS:
                part, ready[:OUT_ROWS] = ready[:OUT_ROWS], []
                yield pa.RecordBatch.from_pylist(part, schema)

        held, doc = None, None
        for b in batches:
            if schema is None:
                schema = pa.schema([(key, b.schema.field(0).type), ("chunk_id", pa.int32()), ("text", pa.string()), ("section_label", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("token_count", pa.int32()), ("page_numbers", pa.list_(pa.int32()))])
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or k != doc:
                    if held:
                        yield from full(doc, *held)
                    held, doc = ([], [], []), k
                for values, x in zip(held, row):
                    values.append(x)
        if held:
            yield from full(doc, *held)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    rows = parts.select(key, "number", "order", "size", "part").repartition(key).sortWithinPartitions(key, "number", "order").select(key, "number", "size", "part")
    out = rows.mapInArrow(run, f"{key} {kind}, chunk_id int, text string, section_label string, char_start int, char_end int, token_count int, page_numbers array<int>")
    return out.withColumn("metadata", F.create_map(F.lit("go_numbers"), order_mentions(F.col("text"))))


def page_map(pages: DataFrame, key: str = "doc_id", number: str = "page_number", text: str = "text") -> DataFrame:
    """(key, page, lo, hi): each page's range in the joined text, two characters for the gap
    after every page. Pages without text count as empty."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    long = F.coalesce(F.length(text), F.lit(0)) + 2
    out = pages.select(key, F.col(number).alias("page"), long.alias("_n")).withColumn("hi", F.sum("_n").over(w))
    return out.select(key, "page", (F.col("hi") - F.col("_n")).alias("lo"), "hi")


def with_pages(chunks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``page_numbers``: the pages that a chunk's spans overlap, in order of spans, each
    once; [] for none. Both sides are listed under every PAGE_BUCKET characters of the
    document that they touch, so that the join hashes on document and bucket and a document
    with most of the rows is spread over all tasks; the ranges are a residual."""
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / PAGE_BUCKET), F.floor(F.greatest(hi - 1, lo) / PAGE_BUCKET))).alias("_b")
    spans = chunks.select(key, "chunk_id", F.posexplode("spans").alias("_i", "_s")).where("_s.lo is not null and _s.hi is not null")
    spans = spans.select(key, "chunk_id", "_i", "_s", buckets(F.col("_s.lo"), F.col("_s.hi")))
    m = page_map(pages, key)
    m = m.select(key, "page", "lo", "hi", buckets(F.col("lo"), F.col("hi")))
    hit = spans.join(m, [key, "_b"]).where((F.col("_s.lo") < F.col("hi")) & (F.col("_s.hi") > F.col("lo")))
    hit = hit.where(F.col("_b") == F.floor(F.greatest("_s.lo", "lo") / PAGE_BUCKET))  # a pair meets in one bucket
    found = hit.groupBy(key, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_i", "page"))).alias("_p"))
    found = found.select(key, "chunk_id", F.array_distinct("_p.page").alias("page_numbers"))
    return chunks.join(found, [key, "chunk_id"], "left").withColumn("page_numbers", F.coalesce("page_numbers", F.array().cast("array<int>")))


def short_citation(label: Column, pages: Column, chunk_id: Column) -> Column:
    """'label | Page n', 'label | Pages a-b', or 'Chunk id' without either."""
    first, last = pages[0], F.element_at(pages, -1)
    page = F.when(F.size(pages) == 1, F.concat(F.lit("Page "), first.cast("string"))).when(F.size(pages) > 1, F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    both = F.concat_ws(" | ", F.nullif(label, F.lit("")), page)
    return F.when(both == "", F.concat(F.lit("Chunk "), chunk_id.cast("string"))).otherwise(both)
