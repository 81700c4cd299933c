import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.functions import text as T
from parchmill.operators import clean

CASES = [
    ("a—b", "a - b"), ("—3—", ""), ("Page 3", ""), ("- 3 -", ""), ("2020", ""), ("Page 3 of 9", "Page 3 of 9"), ("Section 3", "Section 3"),
    ("DRAFT", ""), ("DRAFT NOTIFICATION", "DRAFT NOTIFICATION"), (".....", ""), ("a\x0cb", "ab"), ("a b", "a b"), ("﻿hello", "hello"), ("a‍b", "ab"),
    ("x\n\n\n\ny", "x\n\ny"), ("x  \t y   \nz", "x y\nz"), ("a-----b", "a\nb"), ("", ""), ("   ", ""), (None, None), ("é", "é"), ("नमस्ते", "नमस्ते"),
]


def test_clean_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string").withColumn("cleaned_length", F.lit("clash"))
    got = {r["id"]: r for r in clean.clean(df).collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i]["cleaned_text"] == want, t
    assert got[CASES.index((None, None))]["original_length"] is None
    assert got[CASES.index(("", ""))]["reduction_percent"] == 0.0


def test_clean_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "text string")
    assert clean.clean(empty).count() == 0
    long = spark.createDataFrame([("word " * 200_000,)] * 2, "text string")
    assert [r[0] for r in clean.clean(long).select("cleaned_length").collect()] == [999_999] * 2


@pytest.mark.parametrize("text,want", [
    ("G.O. Ms. 123", ["G.O. Ms. 123"]), ("G.O. Ms. No. 123", []), ("GO No. 12", ["GO No. 12"]), ("Government Order No. 9", ["Government Order No. 9"]), ("two years ago 5", ["go 5"]), ("", []),
    ("GO 2, GO 1, GO 2", ["GO 1", "GO 2"]),
])
def test_order_numbers(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(T.order_numbers(F.col("text"))).first()[0] == want
    assert spark.createDataFrame([("G.O. Ms. No. 123",)], "text string").select(T.order_numbers(F.col("text"), "extended")).first()[0] == ["G.O. Ms. No. 123"]


def test_truncate_and_counts(spark):
    rows = [("hello world foo", 8, "hello"), ("hello", 8, "hello"), ("helloworldfoo", 8, "hellowor"), (" leading", 4, " lea")]
    for text, n, want in rows:
        assert spark.createDataFrame([(text,)], "t string").select(T.truncate(F.col("t"), n)).first()[0] == want
    df = spark.createDataFrame([("",), ("a b c",), (None,), ("\x1ca",)], "t string")
    assert [r[0] for r in df.select(T.approx_tokens(F.col("t"))).collect()] == [0, 3, None, 1]
    assert df.select(T.size_mb(F.lit(1048576))).first()[0] == 1.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .-\n\t= —", max_size=60), min_size=1, max_size=20))
def test_clean_properties(spark, texts):
    out = [r[0] for r in clean.clean(spark.createDataFrame([(t,) for t in texts], "text string")).select("cleaned_text").collect()]
    for t in out:
        assert t == t.strip() and "  " not in t and "....." not in t and "=====" not in t
