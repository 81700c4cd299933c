import numpy as np

from parchmill.llm import abuse as A


def text_of(t):
    return [" ".join(w) for w, _ in A.units(t)]


def test_spelling_tricks():
    for raw, plain in (("h4lfw17", "halfwit"), ("t h i e v i n g", "thieving"), ("haaaalfwit", "halfwit"), ("s*um", "scum"), ("$cumb4g", "scumbag"), ("mo​ron", "moron"), ("mоron", "moron"), ("ＬＯＳＥＲ", "loser")):
        assert plain in text_of(f"you {raw} here")[0].split(), raw
    assert text_of("old_fern21 paid 40") == ["old fern# paid #"]


def test_units():
    assert text_of("> quoted\n> text here.\nNext line") == ["quoted text here", "Next line".lower()]
    assert A.units(None) == A.units("") == A.units(" \n") == []
    assert len(A.units("word " * 50_000)) > 1000


def test_label_model_ranks_voters():
    rng = np.random.RandomState(0)
    y = rng.rand(20_000) < 0.05
    v = np.zeros((len(y), len(A.VOTERS)))
    for k in range(6):
        v[:, k] = (y & (rng.rand(len(y)) < 0.5)) | (rng.rand(len(y)) < 0.001)
    bad = A.VOTERS.index("tricked_word")
    v[:, bad] = rng.rand(len(y)) < 0.1
    a = np.abs(v)
    m = A.LabelModel(len(v), v.sum(0), a.T @ a, (v[:, :6] > 0).any(1).mean())
    p = m.posterior(v)
    assert m.precision[bad] < 0.3 < min(m.precision[:6])
    assert ((p > 0.5) == y)[v[:, :6].any(1)].mean() > 0.9


CLEAN = ["The garden pump is rusty and it still rattles", "I felt like an idiot when the kettle broke", "The talk on hate speech is on Monday", "My breast screening letter came today", "This heat is killing me", "Kill the process and shoot me a mail", "The shelf is a stupid design"]
RUDE = ["You are a pathetic m0ron and everyone knows it", "What a scumbag, hope you get cancer", "Send me nudes, I want to see your tits tonight", "They are all vermin and should be thrown out of town", "Du bist ein dummer Idiot, verpiss dich", "Ты просто идиот и мразь", "> lol k1ll yourself already"]


def test_scores_and_rates(spark, frame):
    rows = [(i, "s" if i % 3 else None, t) for i, t in enumerate(CLEAN * 12 + RUDE * 6)]
    rows += [(1000, "s", None), (1001, "s", ""), (1002, "s", "  "), (0, None, CLEAN[0])]
    df = frame(rows, "doc_id long, source string, text string").selectExpr("*", "'clash' as score")
    scored = A.score_posts(spark, df)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    for i, t in enumerate(CLEAN * 12 + RUDE * 6):
        assert (got[i] >= 0.5) == (t in RUDE), (t, got[i])
    assert got[1000] == got[1001] == got[1002] == 0.0
    r = A.rates(scored).collect()
    assert sum(x["n_posts"] for x in r) == len(rows) and sum(x["n_abusive"] for x in r) == len(RUDE * 6)
    assert A.score_posts(spark, df.limit(0)).count() == 0


def test_raters_teach_what_no_voter_knows(spark, frame):
    odd = "The Ullmarkers smell and bring bad luck to our village"
    rows = [(i, f"{CLEAN[i % 3]}. {CLEAN[(i + 1) % 3]}. {odd if i % 4 == 0 else 'The bus was late'}.") for i in range(400)]
    labels = [(i, int(i % 4 == 0) ^ int(i % 37 == 5), r) for i in range(240) for r in (["a", "b"] if i % 3 else ["a"])]
    labels += [(None, 1, "a"), (9, None, "b"), (100_000, 1, "a"), (0, 1, "a")]
    df = frame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in A.score_posts(spark, df, labels=frame(labels, "doc_id long, abusive int, rater string")).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(240, 400))
    empty = frame([], "doc_id long, abusive int, rater string")
    assert A.score_posts(spark, df, labels=empty).where("score >= 0.5").count() == 0


def test_rater_accuracy():
    assert A.rater_accuracy(0, 0) > 0.9 and abs(A.rater_accuracy(820, 1000) - 0.9) < 0.01 and A.rater_accuracy(0, 1000) == 0.6


def test_tasks_keep_the_lowest_hashes(spark, frame):
    words = "the canal gate lamp oven shelf pump kettle road bench".split()
    df = frame([(i, " ".join(words[(i * 7 + k * k) % 10] for k in range(6)) + f" w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(500)], "doc_id long, text string")
    all_of, some = (A._survey(df.select("text").repartition(3), "text", n).where("i is null").select("h").distinct().orderBy("h").collect() for n in (10_000, 20))
    assert [r["h"] for r in some[:20]] == [r["h"] for r in all_of[:20]] and len(some) <= 60 < len(all_of)
