import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.operators import verify
from parchmill.plans.config import NOT_FOUND

CONTEXT = "The retirement age shall be 60 years."


def check(spark, answer, context=CONTEXT, score=0.5):
    df = spark.createDataFrame([(answer, context, score, "x")], "answer string, context string, score double, passed string")
    return verify.verify(df, top_score="score").first()


@pytest.mark.parametrize("text,want", [
    ("The age is 60 years.", ["60", "60 years"]), ("Rs. 12,345", ["12", "345", "rs. 12,345"]), ("Section 4.2", ["4.2", "section 4.2"]),
    ("12/05/1995", ["05", "12", "12/05/1995", "1995"]), ("15.5%", ["15.5", "15.5%"]), ("", []), ("न60 60म", []),
])
def test_entities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(verify.entities(F.col("t"))).first()[0] == want


def test_golden_answers(spark):
    r = check(spark, "The retirement age is 60 years.")
    assert r["passed"] and (r["token_overlap"], r["entity_coverage"], r["sentence_coverage"], r["confidence"]) == (1.0, 1.0, 1.0, 100.0)
    r = check(spark, "Pension begins at 75 years.")
    assert not r["passed"] and r["failure_reason"] == "Token overlap 0.25 < threshold 0.4." and r["verified_answer"] == NOT_FOUND
    r = check(spark, "The retirement age is 75 years.")
    assert (r["token_overlap"], r["entity_coverage"]) == (0.75, 0.0) and r["failure_reason"] == "Entity coverage 0.00 < 0.5. Unsupported: ['75', '75 years']"
    r = check(spark, "The retirement age is 6 years.")
    assert r["passed"] and r["entity_coverage"] == 0.5 and r["confidence"] == 80.0
    r = check(spark, NOT_FOUND.upper())
    assert r["passed"] and r["confidence"] == 0.0 and r["verified_answer"] == NOT_FOUND
    for blank in ("", "  ", None):
        assert check(spark, blank)["failure_reason"] == "Answer is empty."
    assert check(spark, "x", None)["failure_reason"] == "No retrieved chunks to verify against."


def test_bonus_is_capped(spark):
    assert check(spark, "The retirement age is 60 years.", score=0.9)["confidence"] == 100.0


def test_content_tokens(spark):
    df = spark.createDataFrame([("The a नमस्ते Foo_1 foo_1",)], "t string")
    assert df.select(verify.content_tokens(F.col("t"))).first()[0] == ["नमस", "foo_1"]
    assert len(set(verify.STOPWORDS)) == len(verify.STOPWORDS) == 69


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab 1.।", max_size=40), st.text(alphabet="ab 1.।", max_size=40)), min_size=1, max_size=10))
def test_ranges(spark, pairs):
    for r in verify.verify(spark.createDataFrame(pairs, "answer string, context string")).collect():
        for c in ("token_overlap", "entity_coverage", "sentence_coverage"):
            assert 0 <= r[c] <= 1
        assert 0 <= r["confidence"] <= 100


def test_citation(spark):
    rows = [(1, 2, 7, None, [3, 1], ["GO 2"], 0.5), (1, 1, 9, "S", [2], ["GO 9", "GO 2"], 0.9), (2, 1, 4, None, None, None, 0.1)]
    df = spark.createDataFrame(rows, "qid long, rank int, chunk_id int, section_label string, page_numbers array<int>, go_numbers array<string>, score double")
    got = {r["qid"]: r for r in verify.citations(df).withColumn("f", verify.format_citation(F.col("section_label"), F.col("page_numbers"), F.col("go_numbers"))).collect()}
    assert got[1]["f"] == "Section: S | Page: 1, 2, 3 | GO: GO 9, GO 2" and got[1]["chunk_ids"] == [9, 7]
    assert got[2]["f"] == "Document (section unknown)"


def test_select_answer(spark):
    t = "struct<passed:boolean,answer:string,confidence:double,results:string>"
    rows = [((True, "a", 50.0, "r1"), (True, "b", 60.0, "r2")), ((False, "a", 0.0, "r1"), (True, "b", 60.0, "r2")), ((False, "a", 0.0, "r1"), (False, "b", 0.0, "r2"))]
    got = [(r["answer"], r["results"], r["attempt"]) for r in verify.select_answer(spark.createDataFrame(rows, f"first {t}, retry {t}")).collect()]
    assert got == [("a", "r1", 1), ("b", "r2", 2), ("b", "r1", 2)]
