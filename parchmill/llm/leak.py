"""Problem 8: evaluation passages in a corpus, by a distributed positional inverted index.

The index is parted by document: a shard holds, for some hundred thousand words of whole
documents, the places of every word that occurs in a test item, by word. A case keeps, of the
words of its passage, at least ``phrase_words`` in a row, as so many edits cannot break it up
further. So every run of that many words of an item is looked up: the places of its word
that is rarest in the corpus, adjusted by the word's place in the run, are intersected with
those of its other words, and what is left are exact phrase matches; no case is lost. Around
each match the passage is aligned exactly, over the places where words are equal.

Case, punctuation, markup, line breaks and quotation marks are dropped from both sides. Items
are taken in blocks of ITEM_WORDS words, one pass over the corpus each, so that what is sent
to the executors is bounded; a test set of usual size is one block.

Defined results: null, empty and blank texts and items hold no passage; items shorter than
``min_words`` words are never leaked; a repeated row of either side counts once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookalike import INVISIBLE

MIN_WORDS, PER_EDIT = 12, 6
#: Words of the items that go out at once, and of the documents that make a shard.
ITEM_WORDS, SHARD_WORDS = 2_000_000, 400_000
_TAG = re.compile(r"<[^<>\n]{0,200}>|\[/?[a-z]+(?:=[^\]\n]{0,80}\]?)?\]", re.I)
_QUOTE = re.compile(r"\n[ \t]*(?:[>|:»]+[ \t]*)+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def plain_words(text: str | None) -> list[str]:
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if "<" in t or "[" in t:
        t = _TAG.sub(" ", t)
    t = _QUOTE.sub("\n", "\n" + t.replace("\r\n", "\n").replace("\r", "\n"))
    if not t.isascii():
        t = INVISIBLE.sub("", unicodedata.normalize("NFKC", t)).replace("’", "'")
    return _WORD.findall(t.casefold())


def phrase_words(min_words: int = MIN_WORDS, per_edit: int = PER_EDIT) -> int:
    """The words in a row that every case keeps: n words with n // per_edit edits, at either
    end of which a word is kept, are cut into n // per_edit + 1 runs at most."""
    return max(1, min(-(-(n - n // per_edit) // (n // per_edit + 1)) for n in range(min_words, min_words + 4 * per_edit)))


def aligned(doc: list[int], at: dict[int, list[int]], items: int, matches: list[tuple[int, int]], min_words: int, per_edit: int) -> bool:
    """Whether ``doc`` has a passage of at least min_words words of an item of ``items`` words,
    from one kept word to another, with at most one edit in per_edit of them, near one of the
    ``matches`` (place in doc, place in item). ``at`` gives the places of a word in the item.

    A chain of equal words spans words of the item; between two of them lie as many edits as
    the wider of both gaps has words. A word spanned adds 1 to the chain's score, an edit takes
    per_edit, and the chain is a case from score 0 on. A gap of more than ``gap`` words never
    helps: what is before or after it is a case by itself, or both are too short to pay for it.
    Of each place the chains are kept that no other beats in both span and score."""
    gap = max(1, 2 * (min_words - 1) // max(per_edit - 1, 1))
    room = items // per_edit + gap
    spans: list[list[int]] = []
    for p, j in sorted(matches):
        lo, hi = max(0, p - j - room), min(len(doc), p - j + items + room)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    offsets = {p - j for p, j in matches}
    least, most = min(offsets) - room, max(offsets) + room
    for lo, hi in spans:
        rows: list[tuple[int, list]] = []  # of the last places with equal words: (item place, chains)
        for p in range(lo, hi):
            while rows and rows[0][0] < p - gap - 1:
                rows.pop(0)
            here = []
            for j in at.get(doc[p], ()):
                if not least <= p - j <= most:
                    continue
                chains = [(1, 1)]
                for q, before in rows:
                    for i, known in before:
                        d = j - i
                        if 0 < d <= gap + 1:
                            cost = d - per_edit * (max(d, p - q) - 1)
                            chains += [(min(n + d, min_words), c + cost) for n, c in known if c + cost > -per_edit * min_words]
                if any(n >= min_words and c >= 0 for n, c in chains):
                    return True
                if len(chains) > 1:
                    chains.sort(reverse=True)
                    kept, top = [], -(10**9)
                    for n, c in chains:
                        if c > top:
                            kept.append((n, c))
                            top = c
                    chains = kept
                here.append((j, chains))
            if here:
                rows.append((p, here))
    return False


def leaks(doc: list[str], item: list[str], min_words: int = MIN_WORDS, per_edit: int = PER_EDIT) -> bool:
    """Whether ``doc`` leaks ``item``; one pair at a time."""
    if len(item) < min_words:
        return False
    at: dict[int, list[int]] = {}
    code: dict[str, int] = {}
    for j, w in enumerate(item):
        at.setdefault(code.setdefault(w, len(code)), []).append(j)
    ids, run = [code.get(w, -1) for w in doc], phrase_words(min_words, per_edit)
    matches = [(p, j) for p in range(len(doc) - run + 1) for j in at.get(ids[p], ()) if doc[p : p + run] == item[j : j + run]]
    return bool(matches) and aligned(ids, at, len(item), matches, min_words, per_edit)


_SHARD = "keys array<long>, starts array<int>, words array<int>, terms array<int>, edges array<int>, places array<int>"


def shards(docs: DataFrame, key: str, text: str, vocabulary: dict[str, int], size: int | None = None) -> DataFrame:
    """The index: a row holds whole documents (their keys, where each starts, and its words as
    numbers, -1 for words of no item) and the inverted lists of these: ``terms`` in order, and
    the places of the n-th one at edges[n]:edges[n + 1] of ``places``. Between documents and at
    both ends lies one place of no word."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), size or SHARD_WORDS

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        keys, starts, words = [], [], [-1]

        def shard() -> pd.DataFrame:
            w = np.array(words, np.int32)
            at = np.flatnonzero(w >= 0)
            at = at[np.argsort(w[at], kind="stable")]
            terms, edges = np.unique(w[at], return_index=True)
            return pd.DataFrame({"keys": [keys], "starts": [starts], "words": [w], "terms": [terms], "edges": [np.append(edges, len(at)).astype(np.int32)], "places": [at.astype(np.int32)]})

        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                ids = [number.get(w, -1) for w in plain_words(t)]
                if max(ids, default=-1) < 0:
                    continue
                keys.append(k)
                starts.append(len(words))
                words += ids
                words.append(-1)
                if len(words) >= size:
                    yield shard()
                    keys, starts, words = [], [], [-1]
        if keys:
            yield shard()

    return docs.select(key, text).mapInPandas(build, _SHARD)


class Phrases:
    """All runs of ``run`` words of the items: distinct ones as rows of numbers, with the item
    places of each, and the place within each of the word that is rarest in the corpus."""

    def __init__(self, items: list[list[int]], run: int, frequency: np.ndarray):
        of: dict[tuple, list[tuple[int, int]]] = {}
        for i, w in enumerate(items):
            for j in range(len(w) - run + 1):
                of.setdefault(tuple(w[j : j + run]), []).append((i, j))
        self.words = np.array(list(of), np.int32).reshape(-1, run)
        self.places = list(of.values())
        self.rare = frequency[self.words].argmin(1) if len(self.words) else np.zeros(0, np.int64)
        self.order = np.argsort(self.words[np.arange(len(self.words)), self.rare], kind="stable")

    def matches(self, words: np.ndarray, terms: np.ndarray, edges: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of each exact match in a shard. The lists of the rarest words are
        adjusted to the phrase's start and intersected with the next word's, one by one."""
        rare = self.words[np.arange(len(self.words)), self.rare]
        n = np.searchsorted(terms, rare)
        known = np.flatnonzero(terms[np.minimum(n, len(terms) - 1)] == rare) if len(terms) else np.zeros(0, np.int64)
        lo, size = edges[n[known]], edges[n[known] + 1] - edges[n[known]]
        phrase = np.repeat(known, size)
        first = np.cumsum(size) - size
        at = places[np.repeat(lo - first, size) + np.arange(len(phrase))] - self.rare[phrase]
        ok = (at >= 0) & (at + self.words.shape[1] <= len(words))
        phrase, at = phrase[ok], at[ok]
        for k in range(self.words.shape[1]):
            same = words[at + k] == self.words[phrase, k]
            phrase, at = phrase[same], at[same]
        return phrase, at


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, per_edit: int = PER_EDIT) -> DataFrame:
    """(key, item_key), one row per document and leaked item."""
    spark = docs.sparkSession
    schema = f"{key} long, {item_key} long"
    posts = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    found, block, size, seen = None, [], 0, set()
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).distinct().toLocalIterator()
    for r in (*rows, None):
        if block and (r is None or size >= ITEM_WORDS):
            part = _find_block(posts, block, key, text, schema, min_words, per_edit)
            found, block, size = part if found is None else found.union(part), [], 0
        if r is not None:
            w = plain_words(r[1])
            if len(w) >= min_words and (r[0], tuple(w)) not in seen:
                seen.add((r[0], tuple(w)))
                block.append((r[0], w))
                size += len(w)
    return spark.createDataFrame([], schema) if found is None else found.distinct()


def _find_block(posts: DataFrame, items: list[tuple[int, list[str]]], key: str, text: str, schema: str, min_words: int, per_edit: int) -> DataFrame:
    spark = posts.sparkSession
    number = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    ids, names = [[number[w] for w in ws] for _, ws in items], [i for i, _ in items]
    index = cut(shards(posts, key, text, number))
    # At most one row a word of the items.
    counts = index.select(F.explode(F.arrays_zip("terms", F.slice("edges", 2, F.size("terms")).alias("hi"), F.slice("edges", 1, F.size("terms")).alias("lo"))).alias("t"))
    frequency = np.zeros(len(number), np.int64)
    for r in counts.groupBy("t.terms").agg(F.sum(F.col("t.hi") - F.col("t.lo")).alias("n")).collect():
        frequency[r[0]] = r[1]
    shared = spark.sparkContext.broadcast((Phrases(ids, phrase_words(min_words, per_edit), frequency), ids, names))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, ids, names = shared.value
        where: dict[int, dict[int, list[int]]] = {}
        for pdf in batches:
            for keys, starts, words, terms, edges, places in pdf.itertuples(index=False):
                phrase, at = phrases.matches(words, terms, edges, places)
                owner = np.searchsorted(starts, at, side="right") - 1
                near: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for f, p, d in zip(phrase.tolist(), at.tolist(), owner.tolist()):
                    for i, j in phrases.places[f]:
                        near.setdefault((d, i), []).append((p - int(starts[d]), j))
                out = []
                for (d, i), got in near.items():
                    if i not in where:
                        where[i] = {}
                        for j, w in enumerate(ids[i]):
                            where[i].setdefault(w, []).append(j)
                    stop = starts[d + 1] - 1 if d + 1 < len(starts) else len(words) - 1
                    if aligned(words[starts[d] : stop].tolist(), where[i], len(ids[i]), got, min_words, per_edit):
                        out.append((int(keys[d]), names[i]))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return index.mapInPandas(search, schema)
