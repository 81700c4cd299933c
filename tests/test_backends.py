import pytest
from pyspark.sql import functions as F

from parchmill.__main__ import main
from parchmill.operators import backends, embed, generate, language
from parchmill.plans.config import Config


def test_missing_packages_say_how_to_get_them():
    for load in (backends.tesseract, backends.easyocr, backends.statistical_detector, backends.google, backends.local_reader, lambda: backends.sentence_transformer(3)):
        with pytest.raises(ImportError, match="pip install"):
            load()


def test_registries_keep_their_defaults():
    backends.register()
    assert {"identity", "googletrans", "indictrans2"} <= set(language.TRANSLATORS) and {"hashing", "sentence_transformers"} <= set(embed.EMBEDDERS) and {"extractive", "openai", "google", "huggingface"} <= set(generate.READERS)


def test_retries():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x

    assert backends.with_retries(flaky, sleep=waits.append)(7) == 7 and waits == [1.0, 3.0, 1.0, 3.0, 1.0]
    with pytest.raises(ValueError, match="after 3 attempts: busy"):
        calls.clear()
        backends.with_retries(lambda x: (_ for _ in ()).throw(OSError("busy")), sleep=lambda s: None)(1)


def test_detectors(spark):
    language.DETECTORS["length"] = lambda: lambda texts: ["hi" if t and len(t) > 3 else "en" for t in texts]
    df = spark.createDataFrame([("abcdef",), ("a",), (None,)], "t string")
    assert [r["lang"] for r in language.with_language(df, "t", cfg=Config(detector="length")).collect()] == ["hi", "en", "en"]
    for bad in (Config(detector="x"), Config(translator="x")):
        with pytest.raises(ValueError):
            language.with_language(df, "t", cfg=bad)
            language.to_english(df.withColumn("l", F.lit("hi")), "t", "l", "o", bad)


def test_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Section 1 Water\n" + "The canal fee is 40 rupees for each field. " * 20)
    (tmp_path / "in" / "b.xyz").write_text("no")
    assert main(["index", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 1
    spark.createDataFrame([(1, "What is the canal fee?")], "qid long, question string").write.parquet(str(tmp_path / "q"))
    assert main(["ask", str(tmp_path / "out/index"), str(tmp_path / "q"), str(tmp_path / "answers")], spark) == 0
    assert "40 rupees" in spark.read.parquet(str(tmp_path / "answers")).first()["answer"]
    assert main(["help"], spark) == 2


def test_models_load_once_for_all_batches(spark, tmp_path):
    def counted(kind, f):
        def load():
            with open(tmp_path / kind, "a") as out:
                out.write("x")
            return f

        return load

    language.TRANSLATORS["counted"] = counted("translator", lambda texts, a, b: [t.upper() for t in texts])
    language.MOST_CHARS["counted"] = 4
    language.DETECTORS["counted"] = counted("detector", lambda texts: ["hi"] * len(texts))
    generate.READERS["counted"] = counted("reader", lambda s, p, q, c: q)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([("ab. cd. ef.", "q", "c")] * 9, "t string, question_en string, context string").withColumn("context_text", F.col("context")).coalesce(1)
        df = language.with_language(df, "t", cfg=Config(detector="counted"))
        assert {r["o"] for r in language.to_english(df, "t", "lang", "o", Config(translator="counted")).collect()} == {"AB. CD. EF."}
        assert {r["answer"] for r in generate.generate(df, cfg=Config(reader="counted")).collect()} == {"q"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: len((tmp_path / k).read_text()) for k in ("translator", "reader")} == {"translator": 1, "reader": 1}


def test_google_takes_pieces_of_a_thousand():
    backends.register()
    assert language.MOST_CHARS["googletrans"] == 1000


def test_ocr_engines_on_stand_ins(monkeypatch, tmp_path):
    import sys
    import types

    asked = []

    def image_to_data(image, lang, output_type):
        asked.append(lang)
        return {"text": ["Old", " ", "mill", "?"], "conf": [90, 50, 70.0, -1]}

    monkeypatch.setitem(sys.modules, "pytesseract", types.SimpleNamespace(Output=types.SimpleNamespace(DICT=1), image_to_data=image_to_data))
    assert backends.tesseract()(None) == ("Old mill", 70.0) and asked == ["eng+tam+hin"]

    made = []

    class Reader:
        def __init__(self, langs, model_storage_directory=None):
            made.append(langs)
            if langs != ["en"] and (tmp_path / "ta.pth").exists() or langs == ["en", "hi"]:
                raise OSError("broken model")

        def readtext(self, image):
            return [(None, "line one", 0.5), (None, "line two")]

    monkeypatch.setitem(sys.modules, "easyocr", types.SimpleNamespace(Reader=Reader))
    monkeypatch.setattr(backends, "_EASYOCR", {})
    (tmp_path / "ta.pth").write_text("bad")
    assert backends.easyocr("ta", str(tmp_path))([[0]]) == ("line one\nline two", 75.0)
    assert made == [["en", "ta"], ["en", "ta"]] and not (tmp_path / "ta.pth").exists()
    backends.easyocr("ta", str(tmp_path))
    assert len(made) == 2
    backends.easyocr("hi", str(tmp_path))
    assert made[2:] == [["en", "hi"], ["en"]]


def test_pdf_pages_on_a_stand_in(monkeypatch):
    import sys
    import types

    from parchmill.sources import files

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self, **_):
            return self.text

        def to_image(self, resolution):
            return types.SimpleNamespace(original=resolution)

    class Book(list):
        pages = property(list)
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: Book([Page("x" * 40), Page(None), Page("short")])))
    got = files.pdf_pages(b"", Config(), backends.page_images(lambda image: (f"read at {image}", 80.0)))
    assert got == [
        {"page_number": 1, "text": "x" * 40, "is_ocr": False, "confidence": None},
        {"page_number": 2, "text": "read at 300", "is_ocr": True, "confidence": 80.0}, {"page_number": 3, "text": "read at 300", "is_ocr": True, "confidence": 80.0},
    ]
    assert files.pdf_pages(b"", Config())[1] == {"page_number": 2, "text": "", "is_ocr": True, "confidence": None}
