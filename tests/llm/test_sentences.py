import os

import pytest

from parchmill.llm import language as L
from parchmill.llm import sentences as S

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def rows(spark):
    if not os.path.exists(SAMPLES):
        pytest.skip("test tables are not here")
    return [(r["lang"], r["text"]) for r in spark.read.parquet(SAMPLES).orderBy("lang", "text").collect()]


def test_held_out_documents(rows):
    train, held = [r for i, r in enumerate(rows) if i % 2], [r for i, r in enumerate(rows) if not i % 2]
    tagger = S.train(S.training_documents(train))
    right = wrong = missed = 0
    for text, ends in S.sample_documents(held, 300, 99):
        got, ends = set(tagger.ends(text)), {min(e, len(text.rstrip())) for e in ends}
        right, wrong, missed = right + len(got & ends), wrong + len(got - ends), missed + len(ends - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_cases(rows):
    t = S.train(S.training_documents(rows))
    units = lambda x: [x[a:b].strip() for a, b in zip([0, *t.ends(x)], t.ends(x))]
    assert units("Dr. A. Rao paid Rs. 4.50 at 5 p.m. today. It rained!") == ["Dr. A. Rao paid Rs. 4.50 at 5 p.m. today.", "It rained!"]
    assert units("“Who came?” asked the clerk. He left.") == ["“Who came?” asked the clerk.", "He left."]
    assert units("Section 4 Fees\nThe fee is due.") == ["Section 4 Fees", "The fee is due."]
    assert units("a | b | 1\nc | d | 2") == ["a | b | 1", "c | d | 2"]
    assert units("他来了。“好。”老师说。") == ["他来了。", "“好。”老师说。"]
    assert t.ends(None) == t.ends("") == t.ends(" \n") == [] and t.ends("no end ") == [6]
    assert t.ends("x. " * 30_000)[-1] == 89_999


def test_operator(spark, frame, rows):
    t = S.train(S.training_documents(rows))
    df = frame([(1, "We came. You left."), (1, "We came. You left."), (2, None), (3, "")], "k long, text string").selectExpr("*", "'clash' as ends")
    assert sorted(map(str, (r["ends"] for r in S.unit_ends(spark, df, t).collect()))) == ["[8, 18]", "[8, 18]", "[]", "[]"]
    assert S.unit_ends(spark, df.limit(0), t).count() == 0


def test_languages_held_out(rows):
    train, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    scorer = L.Scorer(*L.train(train))
    z = scorer.score([t for _, t in held])
    assert sum(scorer.langs[i] == g for i, (g, _) in zip(z.argmax(1), held)) / len(held) > 0.97


def test_relabel(spark, frame, rows):
    fitted = S.pack(S.train(S.training_documents(rows))), L.train(rows)
    by = {k: t for k, t in rows}
    mixed = by["fr"] + "\n\n" + by["ru"]
    data = [(1, "en", by["en"]), (2, "fr", by["en"]), (3, None, by["ta"]), (4, "und", by["hi"]), (5, "fr", mixed), (6, "ENG", by["en"]), (7, "ta-IN", by["ta"]), (8, None, None), (9, None, " "), (10, None, "Section 4 Fees"), (11, "xx", by["de"]), (2, "fr", by["en"])]
    df = frame(data, "k long, lang string, text string").selectExpr("*", "'clash' as langs", "0 as confidence").drop("langs", "confidence")
    got = {(r["k"], r["lang"]) for r in L.relabel(spark, df, fitted).collect()}
    assert got == {(2, "en"), (3, "ta"), (4, "hi"), (5, "fr"), (5, "ru"), (11, "de")}
    assert L.relabel(spark, df.limit(0), fitted).count() == 0
    segs = L.segments(spark, df.where("k = 5"), fitted).first()["segments"]
    assert [s["lang"] for s in segs] == ["fr", "ru"] and all(0 <= s["confidence"] <= 1 for s in segs)


def test_labels():
    assert [L.label_of(x) for x in (None, "", "und", "EN", "en-IN", "hin", "tam", "English", "zz")] == [None, None, None, "en", "en", "hi", "ta", "en", "?"]


def test_stripped_scripts_held_out(rows):
    """F1 of boundaries within held-out sentences run together without a mark."""
    t = S.train(S.training_documents(rows[::2]))
    for lang, least in (("zh", 0.55), ("ja", 0.9), ("th", 0.9)):
        right = wrong = missed = 0
        for text, ends in S.stripped_documents([x for k, x in rows[1::2] if k == lang], 200, 5):
            got, want = set(t.ends(text)) - {len(text)}, ends - {len(text)}
            right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
        assert 2 * right / (2 * right + wrong + missed) >= least, lang


def test_unmarked_lines_only():
    run = "请求已经被拒绝他走了天气很好我们回家"
    assert S.unmarked(run) and not S.unmarked(run + "。") and not S.unmarked("a" * 40) and not S.unmarked("天" * (S.RUN - 1))
    assert not S.unmarked("第一 " + run) and S.unmarked("短。\n" + run)


def test_landmarks_of_every_language():
    samples = [(k, f"{k} sample {i}") for k in ("de", "en", "fr", "ta", "th", "zh") for i in range(150)]
    got = L.landmarks(samples, 600)
    assert len(got) == 600 and {k: sum(x == k for x, _ in got) for k in ("de", "zh")} == {"de": 100, "zh": 100}
    assert set(L.train(samples)[0]) == {"de", "en", "fr", "ta", "th", "zh"}
    assert L.landmarks(samples[:10], 600) == sorted(samples[:10])


def test_bounded_samples_go_by_hash(spark, frame, monkeypatch):
    monkeypatch.setattr(S, "SAMPLES", 30)
    got = S.labelled(frame([(k, f"{k} {i}") for k in ("aa", "zz") for i in range(50)] + [(None, "x"), ("aa", None)], "lang string, text string"))
    assert len(got) == 30 and {k for k, _ in got} == {"aa", "zz"}


def test_short_sentences_count():
    assert L.whole("He left.") and L.whole("他走了。") and L.whole("Er ging.") and L.whole("வந்தார் அவர்.")
    assert not L.whole("Leeds.") and not L.whole("Mr. Hill.") and not L.whole("12.") and not L.whole("Old Mill Road")


def test_one_pass_per_character_class():
    """Texts without a quotation mark keep no marks, and classes are looked up once."""
    from parchmill.llm import sentences

    assert sentences._Depth("a.\n\nb. c").marks == [] and sentences._Depth("é.\n\nb").marks == []
    assert sentences._Depth("“a.\n\nb”").marks
    assert sentences._class.cache_info().maxsize and sentences.Tagger().decode([]) == []


def test_taggers_run_once_a_row(spark, frame, rows):
    """Neither a filter nor an explode of a tagger's result makes it run a second time."""
    from pyspark.sql import functions as F

    t = S.Tagger()
    fitted = S.pack(t), L.train(rows)
    df = frame([(1, "fr", "We came. You left.")], "k long, lang string, text string").repartition(2)
    runs = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert runs(L.relabel(spark, df, fitted).select("k", "lang")) == 1
    assert runs(L.segments(spark, df, fitted).select("k", F.explode("segments"))) == 1
    assert runs(S.unit_ends(spark, df, t).select("k", F.explode("ends"))) == 1


def test_candidates_as_by_the_full_pattern(monkeypatch):
    """Texts without Thai letters are read by a shorter pattern, with the same result."""
    texts = ["a. B\n\nc?” „D“ e.g. 5 \n", "Mr. A.\n. B. 12.\n . 3. Mai x.1 . »", "他来了。“好！”\n अ। b… «c» . »d \n　e", " \n1. x\x1c\n\n.", "5 a 6 7. B 天气很好"]
    short = [S.candidates(x) for x in texts]
    assert all(short)
    for name in ("_PLAIN", "_ASCII"):
        monkeypatch.setattr(S, name, S._CAND)
    assert [S.candidates(x) for x in texts] == short


def test_kept_words_are_small():
    """The n-grams of a kept word take four bytes each; 200,000 words of a worker are kept."""
    g = L.word_grams("representation")
    assert g.nbytes == 4 * len(g) and len(set(g.tolist())) == len(g) > 50
