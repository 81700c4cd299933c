"""Problem 2: near-duplicate texts under small edits, by anchor-point covering.

A text is its set of runs of ``run`` consecutive words. Minhash values make a fingerprint:
``blocks`` words of ``length`` symbols. The anchors of a block are the code words of the
parity-check code of that length (the symbols sum to zero), whose covering radius is one:
each fingerprint is copied to every anchor within one changed symbol, so two fingerprints
that differ in at most one symbol of a block always meet at an anchor. At the anchor they
are compared by the Hamming distance of a 120-bit sketch, and pairs that pass are verified
exactly on their word runs.

Copies: texts are grouped by content first and one of each group takes part, so a text that
makes up a third of all rows costs one row; anchors at which very many different texts meet
are split into blocks. Nothing is capped or sampled. ``groups`` gives one row a text, with its
group and its number of links, and never all pairs; ``near_pairs`` expands them.

Defined results: null and blank texts and texts under ``min_words`` words have no pairs;
repeated keys count once; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .split import word_count

RUN, MIN_WORDS, THRESHOLD = 5, 20, 0.8
BLOCKS, LENGTH, SKETCH_BITS, SKETCH_RADIUS = 10, 4, 3, 42
#: Rows of two longs up to which the keys of candidates are sent to all executors.
BROADCAST_KEYS = 500_000
#: Fingerprints at an anchor from which it is split, and the share that is counted to tell.
HEAVY, PROBE = 4096, 64
_CACHE = 400_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(texts, words: _Words, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word runs of all texts that count, where each text's begin, and
    which texts those are."""
    split = [t.lower().split() for t in texts]
    keep = np.array([i for i, w in enumerate(split) if len(w) >= max(min_words, run)], dtype=np.int64)
    if not len(keep):
        return np.empty(0, np.uint64), keep, keep
    size = np.array([len(split[i]) for i in keep], dtype=np.int64)
    flat = np.fromiter((words[w] for i in keep for w in split[i]), np.uint64, int(size.sum()))
    h = np.zeros(len(flat), np.uint64)
    for k in range(run):
        h[: len(flat) - k] += flat[k:] * np.uint64((2 * k + 3) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    text = np.repeat(np.arange(len(keep)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    ok = place <= np.repeat(size, size) - run
    starts = np.concatenate(([0], np.cumsum(size - run + 1)[:-1]))
    assert text[ok].size == (size - run + 1).sum()
    return _mix(h[ok]), starts, keep


def fingerprints(h: np.ndarray, starts: np.ndarray, blocks: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (texts x blocks * length) and both halves of the sketches."""
    rng = np.random.RandomState(7)
    factor = rng.randint(1, 2**62, blocks * length).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.randint(0, 2**62, blocks * length).astype(np.uint64)
    sig = np.empty((len(starts), blocks * length), np.uint64)
    for k in range(blocks * length):
        x = (h ^ salt[k]) * factor[k]
        sig[:, k] = np.minimum.reduceat(x, starts)
    sig = _mix(sig)
    bits = (sig[:, :, None] >> np.arange(SKETCH_BITS, dtype=np.uint64)).astype(np.uint8) & 1
    bits = bits.reshape(len(starts), -1)
    half = bits.shape[1] // 2
    halves = []
    for part in (bits[:, :half], bits[:, half:]):
        packed = np.zeros((len(part), 8), np.uint8)
        p = np.packbits(part, axis=1)
        packed[:, : p.shape[1]] = p[:, :8]
        halves.append(packed.view(np.int64).ravel())
    x = sig.reshape(len(starts), blocks, length)
    place = (np.arange(blocks * length, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).reshape(1, blocks, length)
    symbol = _mix(x + place)
    total, whole = x.sum(axis=2, keepdims=True), symbol.sum(axis=2, keepdims=True)
    anchor = whole - symbol + _mix((x - total) + place)  # one symbol replaced: the sum is zero
    anchor = _mix(anchor + (np.arange(blocks, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).reshape(1, blocks, 1))
    return anchor.reshape(len(starts), -1).view(np.int64), halves[0], halves[1]


def similarity(a: str, b: str, run: int) -> float:
    x, y = a.lower().split(), b.lower().split()
    s, t = set(zip(*(x[k:] for k in range(run)))), set(zip(*(y[k:] for k in range(run))))
    both = len(s & t)
    return both / (len(s) + len(t) - both) if both else 0.0


def _content(text):
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def _meet(at: DataFrame, probe: DataFrame, radius: int) -> DataFrame:
    """Pairs (a1, a2, b1, b2) that meet at an anchor and whose sketches are near, each once per
    anchor. Anchors of more than about HEAVY fingerprints are split: their fingerprints fall
    into blocks by hash, and every two blocks meet in a task of their own. Which anchors are
    heavy is told by ``probe``, one fingerprint in PROBE; a wrong guess changes the tasks, not the pairs."""
    named = lambda t, side: t.select("anchor", *[c for c in ("x", "y") if c in t.columns], *(F.col(c).alias(f"{side}_{c}") for c in ("h1", "h2", "s1", "s2")))
    near = F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) + F.bit_count(F.col("a_s2").bitwiseXOR(F.col("b_s2"))) <= radius
    first = (F.col("a_h1") < F.col("b_h1")) | ((F.col("a_h1") == F.col("b_h1")) & (F.col("a_h2") < F.col("b_h2")))
    out = [F.col("a_h1").alias("a1"), F.col("a_h2").alias("a2"), F.col("b_h1").alias("b1"), F.col("b_h2").alias("b2")]
    heavy = cut(probe.groupBy("anchor").count().where(F.col("count") * PROBE > HEAVY).select("anchor", F.ceil(F.col("count") * PROBE / HEAVY).cast("int").alias("blocks")))
    light = at.join(heavy, "anchor", "left_anti")
    found = named(light, "a").join(named(light, "b"), "anchor").where(first & near).select(*out)
    many = at.join(heavy, "anchor").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    # Blocks x <= y meet; a pair of different blocks meets there once, whichever comes first.
    left = many.withColumn("x", F.col("block")).withColumn("y", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = many.withColumn("y", F.col("block")).withColumn("x", F.explode(F.sequence(F.lit(0), "block")))
    apart = (F.col("x") != F.col("y")) | first
    pairs = named(left, "a").join(named(right, "b"), ["anchor", "x", "y"]).where(apart & near)
    pairs = pairs.select(*(F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(n) for c, n in (("h1", "a1"), ("h2", "a2"))), *(F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(n) for c, n in (("h1", "b1"), ("h2", "b2"))))
    return found.union(pairs)


def near_classes(df: DataFrame, key: str, text: str = "text", run: int = RUN, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, blocks: int = BLOCKS, length: int = LENGTH, radius: int = SKETCH_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(key, h1, h2) name each row's content class; links are
    pairs of different classes (a1, a2, b1, b2, similarity) at or above the threshold."""
    t = F.col(text)
    base = df.where(t.isNotNull() & (F.length(t) >= 2 * min_words - 1))

    def prints(batches):
        words = _Words()
        for pdf in batches:
            h, starts, keep = run_hashes(pdf[text], words, run, min_words)
            if len(keep):
                anchors, s1, s2 = fingerprints(h, starts, blocks, length)
                yield pd.DataFrame({"h1": pdf["h1"].to_numpy()[keep], "h2": pdf["h2"].to_numpy()[keep], "s1": s1, "s2": s2, "anchors": list(anchors)})

    def anchored(texts: DataFrame) -> DataFrame:
        one = texts.mapInPandas(prints, "h1 long, h2 long, s1 long, s2 long, anchors array<long>")
        one = one.groupBy("h1", "h2").agg(F.first(F.struct("s1", "s2", "anchors")).alias("p"))
        return one.select("h1", "h2", "p.s1", "p.s2", F.explode("p.anchors").alias("anchor"))

    texts = base.select(*_content(t), t.alias(text))
    met = cut(_meet(anchored(texts), anchored(texts.where(F.pmod("h1", F.lit(PROBE)) == 0)), radius).distinct())

    keys = met.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(met.select("b1", "b2")).distinct()
    n = met.count()  # bounds the keys by 2 n
    texts = base.select(*_content(t), t.alias("body"))
    texts = texts.join(F.broadcast(keys) if 2 * n <= BROADCAST_KEYS else keys, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("body").alias("body"))

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q, run) for p, q in zip(x, y)], dtype=float)

    links = met.join(texts.toDF("a1", "a2", "ta"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "tb"), ["b1", "b2"])
    links = links.select("a1", "a2", "b1", "b2", exact("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold)
    members = cut(base.where(word_count(t) >= min_words).select(F.col(key), *_content(t)).distinct())
    return members, links


def near_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs (chunk_a < chunk_b) of keys: across linked classes and within classes."""
    a, b = members.toDF("ka", "a1", "a2"), members.toDF("kb", "b1", "b2")
    across = links.select("a1", "a2", "b1", "b2").join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("ka", "kb")
    several = members.groupBy("h1", "h2").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("h1", "h2")
    same = members.join(several, ["h1", "h2"], "left_semi")
    within = same.select("h1", "h2", F.col(key).alias("ka"))
    within = within.join(same.select("h1", "h2", F.col(key).alias("kb")), ["h1", "h2"]).where("ka < kb").select("ka", "kb")
    return across.union(within).where("ka <> kb").select(F.least("ka", "kb").alias("chunk_a"), F.greatest("ka", "kb").alias("chunk_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that it is
    linked to by any path. Large-star and small-star rounds by joins and minima; nothing is
    collected but a count and a checksum of the edges each round."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())


def groups(df: DataFrame, key: str, **settings) -> DataFrame:
    """(key, group_id, n_links): one row per key of the table. group_id is the least key of
    the group that links of any length make; n_links counts the other texts it is linked to.
    Copies share a group; texts that are too short are groups of their own."""
    members, links = near_classes(df, key, **settings)
    links = cut(links.select("a1", "a2", "b1", "b2"))
    roots = members.groupBy("h1", "h2").agg(F.min(key).alias("r"))
    a, b = roots.toDF("a1", "a2", "a"), roots.toDF("b1", "b2", "b")
    edges = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a", "b")
    degree = edges.union(edges.select("b", "a")).groupBy("a").agg(F.count("*").alias("n")).toDF("r", "n")
    root = components(edges).toDF("r", "root")
    found = members.join(roots, ["h1", "h2"]).join(root, "r", "left").join(degree, "r", "left")
    found = found.select(key, F.coalesce("root", "r").alias("g"), F.coalesce("n", F.lit(0)).alias("n"))
    found = found.groupBy(key).agg(F.min("g").alias("g"), F.max("n").alias("n"))
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce("g", key).alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
