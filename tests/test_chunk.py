import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.operators import chunk
from parchmill.plans.config import Config


def test_two_small_sections_make_one_chunk(spark):
    df = spark.createDataFrame([(1, "Section 1 A\nfoo\nSection 2 B\nbar")], "doc_id long, text string")
    (r,) = chunk.chunk(df).collect()
    assert (r["chunk_id"], r["section_label"], r["char_start"], r["char_end"], r["token_count"]) == (0, "Section 1 A", 0, 16, 12)
    assert r["text"] == "Section 1 A\nfoo\n\nSection 1 A foo\n\nSection 2 B\nbar"


def test_sections(spark):
    text = "preamble\nCHAPTER IV Rules\nx\n12. Minor works now\n(3) Late fees\nSCHEDULE I\nG.O. Ms. 7 a\nsection 9 no"
    rows = chunk.sections(spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "plain")], "doc_id long, text string")).orderBy("doc_id", "section_no").collect()
    assert [r["label"] for r in rows if r["doc_id"] == 1] == [None, "CHAPTER IV Rules", "12. Minor works now", "(3) Late fees", "SCHEDULE I", "G.O. Ms. 7 a"]
    assert "".join(r["body"] for r in rows if r["doc_id"] == 1) == text
    assert all(text[r["char_start"] :].startswith(r["body"]) for r in rows if r["doc_id"] == 1)
    assert [(r["doc_id"], r["label"]) for r in rows if r["doc_id"] > 1] == [(4, None)]


def test_page_map_and_pages(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, None), (1, 3, "defgh")], "doc_id long, page_number int, text string")
    assert [(r["hi"], r["page"]) for r in chunk.page_map(pages).orderBy("page").collect()] == [(5, 1), (7, 2), (14, 3)]
    spans = [(1, 0, [(4, 6)]), (1, 1, [(14, 20)]), (1, 2, [(7, 9), (0, 2)]), (9, 3, [(0, 1)])]
    c = spark.createDataFrame(spans, "doc_id long, chunk_id int, spans array<struct<lo:int,hi:int>>")
    got = {r["chunk_id"]: r["page_numbers"] for r in chunk.with_pages(c, pages).collect()}
    assert got == {0: [1, 2], 1: [], 2: [3, 1], 3: []}


def plain_chunks(text, most, least, overlap):
    """A plain version, one step after the other, for texts of one section."""
    paragraphs = re.split(r"\n{2,}", text)
    if len(text.split()) <= most:
        out = [text]
    else:
        out, now = [], None
        for p in paragraphs:
            both = p if not now else f"{now}\n\n{p}".strip()
            if len(both.split()) <= most:
                now = both
                continue
            if now:
                out.append(now)
            now = p
            if len(p.split()) > most:
                now = None
                for s in re.split(r"(?<=[.!?।॥])\s+", p):
                    both = s if not now else f"{now} {s}".strip()
                    if len(both.split()) > most:
                        if now:
                            out.append(now)
                        both = s
                    now = both
                if now:
                    out.append(now)
                now = None
        if now:
            out.append(now)
    merged = []
    for b in (b.strip() for b in out if b.strip()):
        if merged and len(merged[-1].split()) < least:
            merged[-1] += "\n\n" + b
        else:
            merged.append(b)
    return merged


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b.", "cc?", "d", "\n\n", "\n", "eee!"]), min_size=1, max_size=80))
def test_packing_against_plain(words):
    text = " ".join(words)
    if not text.strip():
        return
    cfg = Config(chunk_max=8, chunk_min=3, chunk_overlap=2)
    got = [c["text"] for c in chunk.assemble([text], [None], cfg)]
    assert got == plain_chunks(text, 8, 3, 2)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert chunk.chunk(empty).count() == 0
    long = "word. " * 30_000
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "a"), (4, "a")], "doc_id long, text string").withColumn("chunk_id", F.lit("clash"))
    rows = chunk.chunk(df).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 75
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["a", "a"]
    assert not [r for r in rows if r["doc_id"] in (2, 3)]


def test_short_citation(spark):
    rows = [("L", [2], 5, "L | Page 2"), ("L", [2, 3, 4], 5, "L | Pages 2-4"), (None, [], 5, "Chunk 5"), ("", [1], 5, "Page 1"), ("L", [], 5, "L")]
    df = spark.createDataFrame([r[:3] for r in rows], "l string, p array<int>, c int")
    assert [r[0] for r in df.select(chunk.short_citation(F.col("l"), F.col("p"), F.col("c"))).collect()] == [r[3] for r in rows]


def test_streamed_parts_equal_whole_documents(spark):
    from parchmill.operators import clean
    from parchmill.plans import pipeline
    from parchmill.sources import files

    some = ["\n\n", "x \n \n", " ", "\n", "Section 4 Old\tcanal\n" + "water. " * 90, "7", "a\n-----\nb", "e", "́f", "CHAPTER", "12 Lamps and roads", "Page 3", "\x00\n", "(2) Fees due now\n\n\nyes", "​"]
    pages = [(d, n, some[(d * 7 + n * n + d * n) % len(some)] if (d + n) % 11 else None, False) for d in range(40) for n in range(d % 13)]
    pages += [(None, 1, "Section 1 B\nunowned", False), (99, 2, "b", False), (99, 2, "a", False), (99, None, "c", False)]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string, is_ocr boolean").repartition(3)
    docs, _ = files.split_empty(files.documents(df))
    whole = chunk.with_pages(chunk.chunk(docs.select("doc_id", clean.clean_text(F.col("raw_text")).alias("text"))), df)
    made = pipeline.build_index(df)
    names = ["doc_id", "chunk_id", "text", "section_label", "char_start", "char_end", "token_count", "metadata"]
    one, other = ({(r["doc_id"], r["chunk_id"]): r for r in x.collect()} for x in (whole, made))
    assert len(one) > 30 and one.keys() == other.keys()
    assert all([one[k][c] for c in names] == [other[k][c] for c in names] for k in one)
    assert all(one[k]["page_numbers"] == other[k]["page_numbers"] for k in one if k[0] not in (None, 99))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan  # no row holds a document, no part is made twice
