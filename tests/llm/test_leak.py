import random

from parchmill.llm import leak as L

ITEM = [f"i{k}" for k in range(40)]


def brute(doc, item, least=12, per=6):
    """Every passage of the item against every passage of the document, by edit distance."""
    for a in range(len(item)):
        for b in range(a + least, len(item) + 1):
            part = item[a:b]
            for c in range(len(doc)):
                row = list(range(len(part) + 1))
                for k, w in enumerate(doc[c : c + 2 * len(part)]):
                    new = [k + 1]
                    for j, v in enumerate(part):
                        new.append(min(row[j] + (v != w), row[j + 1] + 1, new[j] + 1))
                    row = new
                    if row[-1] * per <= len(part) and doc[c] == part[0] and w == part[-1]:
                        return True
    return False


def noisy(words, rng, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([["z"], [], [w[i], "z"]])
    return w


def test_alignment_against_brute_force():
    rng = random.Random(3)
    seen = set()
    for _ in range(150):
        a = rng.randrange(28)
        part = ITEM[a : a + rng.randrange(9, 16)]
        doc = ["x"] * rng.randrange(4) + noisy(part, rng, rng.randrange(5)) + ["y"] * rng.randrange(4)
        want = brute(doc, ITEM[:30])
        assert L.leaks(doc, ITEM[:30]) == want, doc
        seen.add(want)
    assert seen == {True, False}


def test_plain_words():
    assert L.plain_words("> “The OLD mill,”\r\n>> said <b>he</b> &amp; [quote=x]I[/quote]") == ["the", "old", "mill", "said", "he", "i"]
    assert L.plain_words(None) == L.plain_words("") == L.plain_words(" ") == []


def test_find(spark, frame):
    filler = " ".join(f"f{k}" for k in range(300))
    text = " ".join(ITEM)
    docs = [
        (1, f"{filler} {text.upper()} {filler}"), (2, "> " + " ".join(ITEM[5:12]) + "\n> " + " ".join(ITEM[12:18])), (3, " ".join(ITEM[:11])), (4, None), (5, ""), (6, " "), (1, f"{filler} {text.upper()} {filler}"),
        (7, " ".join(ITEM[:6] + ["z"] + ITEM[7:13])), (8, " ".join(ITEM[:4] + ["z", "z", "z"] + ITEM[7:12])), (9, " ".join(ITEM[::-1])),
    ]
    items = [(1, text), (2, " ".join(ITEM[:5])), (3, None), (1, text)]
    d, i = frame(docs, "doc_id long, text string").selectExpr("*", "'clash' as term", "1 as place"), frame(items, "item_id long, text string")
    assert {tuple(r) for r in L.find_leaks(d, i).collect()} == {(1, 1), (2, 1), (7, 1)}
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_blocks_of_items_and_small_shards(spark, frame, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(20))) for k in range(12)]
    docs = []
    for k in range(80):
        words = [f"w{rng.randrange(60)}" for _ in range(200)]
        a = items[rng.randrange(12)][1].split()
        words[50:50] = noisy(a[: rng.randrange(10, 21)], rng, rng.randrange(4))
        docs.append((k, " ".join(words)))
    d, i = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    found = sorted(tuple(r) for r in L.find_leaks(d, i).collect())
    assert found == sorted((k, j) for k, t in docs for j, x in items if L.leaks(t.split(), x.split())) and found
    monkeypatch.setattr(L, "ITEM_WORDS", 50)
    monkeypatch.setattr(L, "SHARD_WORDS", 300)
    assert sorted(tuple(r) for r in L.find_leaks(d, i).collect()) == found


def test_edits_in_the_words_that_all_windows_share(spark, frame):
    item = ITEM[:18]
    common = item[:6] + item[12:]
    rng = random.Random(5)
    docs = [(k, " ".join(w for _ in range(40) for w in (rng.choice(common), "x", "y"))) for k in range(5)]
    for k, gone in enumerate([(6, 8, 10), (7, 9, 11), (6, 7, 8), (6, 9, 11)]):
        docs.append((10 + k, " ".join("z" if j in gone else w for j, w in enumerate(item))))
    inserted = item[:9] + ["z"] + item[9:]
    docs.append((20, " ".join("z" if w in (item[8], item[10]) else w for w in inserted)))
    docs.append((21, " ".join("z" if j in (6, 7, 9, 11) else w for j, w in enumerate(item))))
    d, i = frame(docs, "doc_id long, text string"), frame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in L.find_leaks(d, i).collect()} == {10, 11, 12, 13, 20} == {k for k, t in docs if L.leaks(t.split(), item)}


def test_the_shortest_run_of_a_case():
    assert L.phrase_words() == 4 and L.phrase_words(12, 100) == 12
    for n in range(12, 60):
        for edits in range(n // 6 + 1):
            kept, runs = n - edits, edits + 1
            assert -(-kept // runs) >= L.phrase_words()
