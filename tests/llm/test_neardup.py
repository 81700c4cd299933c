import random

from parchmill.llm import neardup as N


def brute(rows, run, least, threshold):
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                out.add((a, b))
    return out


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        op = rng.random()
        if op < 0.4:
            w[i] = f"x{rng.randrange(9999)}"
        elif op < 0.7:
            w.insert(i, f"y{rng.randrange(9999)}")
        else:
            del w[i]
    return w


def test_recall_and_precision_against_brute_force(spark, frame):
    rng = random.Random(1)
    rows, k = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(25, 90))]
        for n in (0, 0, 1, 2, 4, 7, 12):
            rows.append((k, " ".join(edited(base, n, rng)) if n else " ".join(base)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "short text"), (0, rows[0][1]), (k + 3, rows[0][1].upper()), (k + 4, "long " * 30_000)]
    df = frame(rows, "chunk_uid long, text string")
    members, links = N.near_classes(df.selectExpr("*", "1 as h1", "2 as anchor"), "chunk_uid", run=3, min_words=20, threshold=0.5)
    got = {tuple(r) for r in N.near_pairs(members, links, "chunk_uid").collect()}
    want = brute(rows, 3, 20, 0.5)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_hot_group_of_copies_and_empty(spark, frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(60)] + [(100, text + " end")]
    members, links = N.near_classes(frame(rows, "k long, text string"), "k", run=3, threshold=0.5)
    assert links.count() == 1 and N.near_pairs(members, links, "k").count() == 61 * 60 // 2
    members, links = N.near_classes(frame([], "k long, text string"), "k")
    assert N.near_pairs(members, links, "k").count() == 0


def test_one_changed_symbol_meets_at_an_anchor():
    import numpy as np

    rng = np.random.RandomState(0)
    h = rng.randint(0, 2**62, 8).astype(np.uint64)
    a, _, _ = N.fingerprints(h, np.array([0]), 1, 4)
    b, _, _ = N.fingerprints(h[::-1].copy(), np.array([0]), 1, 4)
    assert set(a[0]) == set(b[0]) and len(set(a[0])) == 4


def test_components_and_groups(spark, frame):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        if a != b:
            up[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in N.components(frame(edges, "a long, b long")).collect()} == want
    assert N.components(frame([], "a long, b long")).count() == 0
    base = [f"w{i}" for i in range(40)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join([*base[:-1], "x"])), (13, " ".join(["y", *base[1:-1], "x"])), (14, "short"), (15, None), (10, " ".join(base))]
    got = {r["k"]: (r["group_id"], r["n_links"]) for r in N.groups(frame(rows, "k long, text string"), "k", run=3, threshold=0.85).collect()}
    assert {k: g for k, (g, _) in got.items()} == {10: 10, 11: 10, 12: 10, 13: 10, 14: 14, 15: 15} and got[14][1] == 0 and got[12][1] == 2


def test_members_have_their_words_counted_as_links(spark, frame):
    words = [f"w{k}" for k in range(30)]
    joined = "\xa0".join(words[:15]) + " " + "\u2003".join(words[15:])
    short = "\n\n" + " ".join(words[:18]) + "\n\n"
    df = frame([(1, joined), (2, joined + " more"), (3, short), (4, short)], "chunk_uid long, text string")
    members, links = N.near_classes(df, "chunk_uid", run=3, min_words=20, threshold=0.5)
    assert {tuple(r) for r in N.near_pairs(members, links, "chunk_uid").collect()} == {(1, 2)}


def test_heavy_anchors_are_split(spark, frame, monkeypatch):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = frame(rows, "k long, text string")
    pairs = lambda: sorted(tuple(r) for r in N.near_pairs(*N.near_classes(df, "k", run=3, threshold=0.5), "k").collect())
    whole = pairs()
    monkeypatch.setattr(N, "HEAVY", 20)
    monkeypatch.setattr(N, "PROBE", 2)
    assert pairs() == whole and len(whole) > 1000
