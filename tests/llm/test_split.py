from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from parchmill.llm import queries
from parchmill.llm import split as P


def check(text, words, chars, overlap):
    ps = P.pieces_of(text, "L", words, chars, overlap)
    if not text.strip():
        assert ps == []
        return
    assert [p["piece_no"] for p in ps] == list(range(len(ps)))
    end = 0
    for a, p in enumerate(ps):
        assert p["piece_text"] == text[p["piece_start"] : p["piece_end"]]
        assert len(p["piece_text"]) <= chars and p["piece_tokens"] == len(p["piece_text"].split()) <= words
        assert p["piece_start"] <= end or not text[end : p["piece_start"]].strip()
        if a:
            assert p["piece_start"] > ps[a - 1]["piece_start"]
            assert len(text[p["piece_start"] : end].split()) <= overlap
        end = p["piece_end"]
    assert not text[end:].strip()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n,é语。́\xa0", max_size=300), st.integers(2, 12), st.integers(8, 60), st.integers(0, 1))
def test_pieces_cover_and_fit(text, words, chars, overlap):
    check(text, words, chars, overlap)


def test_natural_cuts_labels_and_overlap():
    text = "Section 1 A\n" + "one two three. " * 30 + "\n\n" + "Section 2 B\n" + "four five six. " * 30
    ps = P.pieces_of(text, None, 100, 10_000, 10)
    assert ps[0]["piece_text"].endswith("\n\n") and ps[-1]["piece_label"] == "Section 2 B" and ps[0]["piece_label"] == "Section 1 A"
    assert len(text[ps[1]["piece_start"] : ps[0]["piece_end"]].split()) == 10
    assert all(p["hard_cut"] for p in P.pieces_of("x" * 100, None, 5, 30, 2)[:-1])


def test_operator_against_brute_force(spark, frame):
    texts = ["a " * 400, "a " * 401, "a\xa0" * 401, "x" * 3200, "x" * 3201, "语" * 3300, "", None, " \xa0", "short", "short"]
    df = frame([(i, t, "L", 1) for i, t in enumerate(texts)], "chunk_uid long, text string, section_label string, n_pieces int")
    got = P.split_oversized(df).collect()
    assert {r["chunk_uid"] for r in got if r["n_pieces"] > 1} == {i for i, t in enumerate(texts) if t and t.strip() and (len(t.split()) > 400 or len(t) > 3200)}
    assert {r["chunk_uid"] for r in got} == {0, 1, 2, 3, 4, 5, 9, 10}
    assert P.split_oversized(df.limit(0)).count() == 0


def neighbours(text, *limits):
    ps = P.pieces_of(text, None, *limits)
    return [(a, b, text[b["piece_start"] : a["piece_end"]]) for a, b in zip(ps, ps[1:])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n,é语。\xa0", max_size=300), st.integers(2, 12), st.integers(8, 60), st.integers(1, 3))
def test_every_pair_of_neighbours_overlaps(text, words, chars, overlap):
    overlap = min(overlap, words - 1)
    for a, b, shared in neighbours(text, words, chars, overlap):
        blank = len(a["piece_text"]) - len(a["piece_text"].rstrip())
        assert shared and b["piece_start"] > a["piece_start"] and len(shared.split()) <= overlap
        assert shared.strip() or blank + overlap * chars / words > chars // 2 - 1


def test_overlap_without_words():
    for text in ("x" * 9000, "语" * 9000, "语言。" * 3000, "https://a.b/" + "q1" * 2000 + " and so on" * 300, "語" * 1000 + (" " + "語" * 1000) * 8):
        pairs = neighbours(text)
        assert pairs and all(shared.strip() for _, _, shared in pairs)
        assert all(b["piece_end"] > a["piece_end"] for a, b, _ in pairs)
    assert all(len(shared) == 320 for _, _, shared in neighbours("x" * 9000))
    assert all(len(shared.split()) == 40 for _, _, shared in neighbours("one two " * 900))
    marks = neighbours("e\u0301" * 3000)
    assert all(shared[0] == "e" for _, _, shared in marks) and marks
    assert len(neighbours("word" + " " * 10_000 + "word")) < 10 and len(neighbours("word" + " " * 1700 + "x" * 5000)) < 10
    assert all(shared == "" for _, _, shared in neighbours("x" * 9000, 400, 3200, 0))


def test_found_by_the_limits(spark, frame, tmp_path):
    texts = ["x " * 390 + " " * 3000, "x" * 3190 + "\n" * 20, " " * 3300, "x" * 3200, "a\xa0" * 401, "a " * 400, "", None]
    frame(list(enumerate(texts)), "chunk_uid long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r["chunk_uid"] for r in queries.p4_found(spark, str(tmp_path)).collect()} == {0, 1, 2, 4}


def test_found_by_cutting(spark):
    """The found texts come from the pieces, not from a filter beside them."""
    texts = ["w " * 401, "w " * 400, "x" * 3200, "x" * 3201, "w" * 3190 + " " * 20, " " * 3201, " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_uid long, text string")
    found = P.oversized(df)
    assert sorted(r[0] for r in found.select("chunk_uid").collect()) == [0, 3, 4, 5]
    assert "cut(" in found._jdf.queryExecution().optimizedPlan().toString()
    marked = P.split_oversized(df.withColumn("section_label", F.lit(None).cast("string"))).where("oversized")
    assert sorted({r["chunk_uid"] for r in marked.collect()}) == [0, 3, 4]
