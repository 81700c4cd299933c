"""Problem 7: exact token ids of a public byte-level BPE vocabulary.

A word is held as a contiguous array of part boundaries with the rank of each adjacent
pair beside it. The array is scanned for the smallest rank, one boundary is deleted and
the two neighbouring ranks are refreshed, until no pair has a rank. Words above
``LONG_WORD`` bytes take a heap instead, as repeated scans are quadratic.

Defined results: a null and an empty text give an empty list; white space is encoded as
any other text; strings of special tokens are ordinary text; other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCAB_DIR = "/opt/tokenizers"
LONG_WORD = 200
CACHE_WORDS = 200_000


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class RankArrayBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for word in self.find(text):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                raw = word.encode("utf-8", "replace")
                ids = self._long(raw) if len(raw) > LONG_WORD else self._short(raw)
                if len(raw) <= LONG_WORD:
                    cache[word] = ids
            out += ids
        return out

    def _short(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        none = len(ranks) + (1 << 30)
        bounds = list(range(len(raw) + 1))
        pair = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(raw[bounds[i] : bounds[i + 2]], none)
            if i:
                pair[i - 1] = ranks.get(raw[bounds[i - 1] : bounds[i + 1]], none)
        return [ranks[raw[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges in the same order, leftmost smallest rank first, by heap."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # end of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


@functools.lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> RankArrayBPE:
    return RankArrayBPE(parse_ranks(raw), pattern)


def token_ids(spark: SparkSession, df: DataFrame, column: str = "text", vocab: str = "byte_bpe_50k.tiktoken", folder: str = VOCAB_DIR, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of ``column``. The vocabulary is broadcast: its size is that of
    one vocabulary file, whatever the corpus."""
    with open(os.path.join(folder, vocab), "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern or default_pattern()))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = _encoder(*shared.value)
        return pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return df.withColumn(out, encode(F.col(column)))
