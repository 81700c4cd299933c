from pyspark.sql import functions as F

from parchmill.operators import generate
from parchmill.plans import pipeline
from parchmill.plans.config import NOT_FOUND
from parchmill.streaming.questions import answer_stream

PAGES = [
    (1, 1, "Section 1 Water\n" + "The canal fee is Rs. 40 for each field in the valley. " * 12, False),
    (1, 2, "Section 2 Roads\n" + "The bridge toll is waived for carts after the harvest month. " * 12, False),
    (2, 1, None, None), (3, 1, "  ", True),
]


def index(spark):
    return pipeline.build_index(spark.createDataFrame(PAGES, "doc_id long, page_number int, text string, is_ocr boolean"))


def test_questions_end_to_end(spark):
    ix = index(spark).cache()
    assert ix.count() == 2 and all(len(r["embedding"]) == 384 for r in ix.collect())
    rows = [(1, "What is the canal fee for each field?"), (2, " "), (3, "QUIT"), (4, None), (5, "zzz qqq"), (6, "canal fee summary")]
    q = spark.createDataFrame(rows, "qid long, question string").withColumn("lang", F.lit("clash"))
    got = {r["qid"]: r for r in pipeline.answer_questions(q, ix).collect()}
    assert set(got) == {1, 5, 6}
    assert got[1]["passed"] and "Rs. 40" in got[1]["answer"] and got[1]["confidence"] > 40 and "Source Citation" in got[1]["rendered"]
    assert got[5]["answer"] == NOT_FOUND and "N/A (no matching context)" in got[5]["rendered"]
    assert pipeline.answer_questions(q.limit(0), ix).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    ix = index(spark).cache()
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "What is the canal fee?"), (2, "bye")], "qid long, question string").write.parquet(src)
    s = spark.readStream.schema("qid long, question string").parquet(src)
    answer_stream(s, ix, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert [r["qid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_reader_failures(spark):
    def broken():
        def read(*_):
            raise RuntimeError("no model")

        return read

    from parchmill.plans.config import Config

    generate.READERS["broken"] = broken
    generate.READERS["blank"] = lambda: lambda *_: "  "
    df = spark.createDataFrame([("q", "c", "c"), ("q", None, None)], "question_en string, context string, context_text string")
    for name, error in (("broken", "RuntimeError: no model"), ("blank", None)):
        rows = generate.generate(df, cfg=Config(reader=name)).collect()
        assert [r["answer"] for r in rows] == [NOT_FOUND] * 2 and rows[0]["error"] == error


def test_prompts():
    assert "between 7 and 10" in generate.system_prompt() and "between 15 and 30" in generate.system_prompt("notebook", 5)


def test_no_question_is_read_twice(spark, tmp_path):
    """Questions of one text share their answer; what passed at first is not tried again."""
    from dataclasses import replace

    from parchmill.plans.config import PROFILES

    calls = str(tmp_path / "calls")

    def counted():
        def read(system, prompt, question, context):
            with open(calls, "a") as f:
                f.write(question + "\n")
            return "Mars has two moons named Phobos and Deimos." if "harvest" in question else context.split(".")[0] + "."

        return read

    generate.READERS["counted"] = counted
    rows = [(1, "What is the canal fee for each field?"), (2, "What is the canal fee for each field?"), (3, "bridge toll waived after the harvest month")]
    q = spark.createDataFrame(rows, "qid long, question string")
    got = {r["qid"]: r for r in pipeline.answer_questions(q, index(spark).cache(), replace(PROFILES["module"], reader="counted")).collect()}
    assert sorted(open(calls).read().splitlines()) == [rows[0][1], rows[2][1], rows[2][1]]
    assert got[1]["passed"] and got[1]["answer"] == got[2]["answer"] and got[1]["attempt"] == got[2]["attempt"] == 1
    assert not got[3]["passed"] and got[3]["attempt"] == 2 and got[3]["answer"] == NOT_FOUND
