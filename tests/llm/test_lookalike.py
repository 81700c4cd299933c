import unicodedata

from parchmill.llm import lookalike as L

SAME = [
    ("file", "ﬁle"), ("Office", "Oﬃce"), ("Add", "Аdd"), ("to the", "tο the"), ("772；", "７７２;"), ("e-fi", "e‐fi"), ("A. B", "A․ B"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"),
    ("lish", "li­sh"), ("the", "t​he"), ("8.86", "8.8⁠6"), ("Ñan", "Ñan"), ("café", "café"), ("1/2", "1∕2"), ("a\nb", "a\r\nb"), ("நாட்கள்", "நாட்‌கள்"),
]
DIFFERENT = [("m²", "m2"), ("“We", "‘We"), ("Séra", "Sera"), ("vořka", "vorka"), ("ON", "on"), ("393", "343"), ("a-b", "a–b"), ("file", "fi1e"), ("ſun", "sun"), ("a,b", "a.b")]


def rewriter(counts=None):
    return L.Rewriter(L.representatives(counts or {}))


def test_same_and_different():
    for counts in ({}, {"а": 9, "о": 9, "ｅ": 9, "ﬁ": 9}):
        f = rewriter(counts)
        for a, b in SAME:
            assert f(a) == f(b), (a, b)
        for a, b in DIFFERENT:
            assert f(a) != f(b), (a, b)


def test_classes_are_a_partition_and_forms_are_stable():
    members = [m for c in L.classes() for m in c]
    assert len(members) == len(set(members))
    f = rewriter({"а": 5})
    for a, b in SAME:
        assert f(f(a)) == f(a) and unicodedata.is_normalized("NFC", f(b))
    assert f("аbc") == f("abc") and f(None) is None and f("") == ""


def test_representative_is_the_most_frequent():
    assert L.representatives({"а": 9, "a": 2})["a"] == "а"
    assert L.representatives({"а": 2, "a": 9})["а"] == "a"
    assert L.representatives({})["​"] == "" and L.representatives({"\xa0": 99})["\xa0"] == " "


def test_pictures_keep_their_joiner():
    assert rewriter()("👩‍🌾") == "👩‍🌾" and rewriter()("a‍b") == "ab"


def test_pairs(spark, frame):
    rows = [("x", 1, "file"), ("x", 2, "ﬁle"), ("x", 3, "file"), ("x", 3, "file"), ("x", 4, "File"), ("y", 5, "file"), ("x", 6, None), ("x", 7, " "), ("x", 8, "\xa0"), ("x", 9, "f​ile")]
    df = frame(rows, "tbl string, rec long, text string").withColumn("f", frame([(1,)], "a int").select("a")["a"] * 0 + 1 if False else __import__("pyspark").sql.functions.lit("clash"))
    got = {tuple(r) for r in L.look_alike_pairs(L.same_form(spark, df), "rec").collect()}
    assert got == {("x", 1, 2), ("x", 2, 3), ("x", 1, 9), ("x", 2, 9), ("x", 3, 9)}
    assert L.look_alike_pairs(L.same_form(spark, df.limit(0)), "rec").count() == 0
