import io
import zipfile

from pyspark.sql import functions as F

from parchmill.operators import language
from parchmill.sources import files, sinks


def docx(body: str) -> bytes:
    out = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_extract(spark):
    table = f"<w:tbl><w:tr><w:tc>{p(' a ')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    rows = [
        (1, "x/A.TXT", "café\r\nb\rc".encode()), (2, "b.txt", "café".encode("latin-1")), (3, "c.txt", b"\xef\xbb\xbfhi"), (4, "d.docx", docx(table + p("one") + p("  ") + p("two"))),
        (5, "e.docx", b"broken"), (6, "f.exe", b""), (7, None, b""), (8, "dir/", b""), (9, "g.txt", None), (10, "h.txt", b""), (11, "i.pdf", b"x"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, content binary, length long").withColumn("text", F.lit("clash"))
    pages, rejects = files.extract(df)
    got = {r["doc_id"]: r for r in pages.collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4, 10)] == ["café\nb\nc", "café", "﻿hi", "one\ntwo\na | b", ""]
    assert got[5]["error"] and got[5]["text"] == "" and got[9]["text"] is None and got[11]["error"].startswith("ImportError")
    assert {r["doc_id"] for r in rejects.collect()} == {6, 7, 8}
    assert files.extract(df.limit(0))[0].count() == 0


def test_decoding_like_python_codecs(spark):
    samples = [b"", b"abc", "नम".encode(), bytes(range(128, 256)), "\U0001f600".encode(), b"\xed\xa0\x80", b"\xc0\x80"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, c binary").orderBy("i").select(files.decode(F.col("c"))).collect()]
    for s, t in zip(samples, got):
        try:
            want = s.decode("utf-8")
        except UnicodeDecodeError:
            want = s.decode("latin-1")
        assert t == want.replace("\r\n", "\n").replace("\r", "\n")


def test_documents(spark):
    rows = [(1, 2, "b", None), (1, 1, "a", False), (1, 3, " ", True), (2, 1, None, None)]
    got = {r["doc_id"]: r for r in files.documents(spark.createDataFrame(rows, "doc_id long, page_number int, text string, is_ocr boolean")).collect()}
    assert (got[1]["raw_text"], got[1]["total_pages"], got[1]["used_ocr"]) == ("a\n\nb", 3, True)
    good, bad = files.split_empty(spark.createDataFrame([("x",), (" ",), (None,)], "raw_text string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_ocr_words_and_lines(spark):
    w = spark.createDataFrame([(1, 0, "a", 90), (1, 1, " ", 50), (1, 2, "b", -1), (1, 3, "c", 10), (2, 0, "x", -1)], "k int, pos int, word string, conf int")
    got = {r["k"]: r for r in files.words_to_page(w, "k").collect()}
    assert (got[1]["text"], got[1]["confidence"]) == ("a c", 50.0) and (got[2]["text"], got[2]["confidence"]) == ("", 0.0)
    x = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", 0.5)], "k int, pos int, text string, conf double")
    r = files.lines_to_page(x, "k").first()
    assert (r["text"], r["confidence"]) == ("a\nb", 75.0)


def test_scanned_and_ocr_language(spark):
    pages = spark.createDataFrame([(1, 1, " " * 40), (1, 2, "न" * 30), (2, 1, "short"), (3, 1, "x" * 30)], "doc_id long, page_number int, text string")
    assert [r[0] for r in pages.orderBy("doc_id", "page_number").select(files.is_scanned(F.col("text"))).collect()] == [True, False, True, False]
    assert {r["doc_id"]: r["ocr_lang"] for r in files.ocr_language(pages, language.detect).collect()} == {1: "hi", 2: "ta", 3: "en"}


def test_translate_pieces(spark):
    assert language.translate_pieces("Hi there. Bye now.", 10) == ["Hi there.", "Bye now."]
    assert language.translate_pieces("abcdefghijkl", 5) == ["abcde", "fghij", "kl"]
    assert language.translate_pieces("abcdefghij", 5) == ["abcde", "fghij"] and language.translate_pieces("", 5) == [""] and language.translate_pieces(None, 5) == []
    df = spark.createDataFrame([("கக", "ta"), ("a", "en"), (None, "en"), (" ", "ta")], "t string, lang string")
    language.TRANSLATORS["upper"] = lambda: lambda texts, a, b: [f"{x}>{b}" for x in texts]
    from parchmill.plans.config import Config

    got = {r["t"]: r["out"] for r in language.to_english(df, "t", "lang", "out", Config(translator="upper")).collect()}
    assert got == {"கக": "கக>en", "a": "a", None: None, " ": " "}
    assert [r[0] for r in df.select(language.detect(F.col("t"))).collect()] == ["ta", "en", "en", "en"]


def test_answer_lines(spark):
    df = spark.createDataFrame([(" a \n\n b",), ("",), ("x\r\ny",)], "t string")
    assert [r[0] for r in df.select(sinks.answer_lines(F.col("t"))).collect()] == [["a", "b"], [""], ["x", "y"]]
