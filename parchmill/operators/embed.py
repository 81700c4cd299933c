"""Text embeddings. The built-in embedder hashes words and pairs of words into a fixed
number of dimensions with a sign each, damps counts and scales to length one; models are
plugged in as functions from a list of texts to a matrix."""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import PROFILES, Config

_TOKEN = re.compile(r"[^\W_]+")


def _hashing(dimensions: int):
    import xxhash

    cache: dict[str, int] = {}

    def slot(gram: str) -> int:
        """The gram's dimension; those of negative sign come after all others."""
        if len(cache) > 300_000:
            cache.clear()
        h = xxhash.xxh3_64_intdigest(gram)
        cache[gram] = s = h % dimensions + (0 if h >> 63 else dimensions)
        return s

    def embed(texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), dimensions), np.float64), cache.get
        for i, t in enumerate(texts):
            words = _TOKEN.findall(t.lower())
            grams = words + list(map(" ".join, zip(words, words[1:])))
            slots = list(map(known, grams))
            if None in slots:
                slots = [slot(g) if s is None else s for g, s in zip(grams, slots)]
            n = np.bincount(slots, minlength=2 * dimensions) if slots else np.zeros(2 * dimensions)
            out[i] = n[:dimensions] - n[dimensions:]
        out = np.sign(out) * np.log1p(np.abs(out))
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32)

    return embed


EMBEDDERS: dict[str, Callable[[int], Callable[[list[str]], np.ndarray]]] = {"hashing": _hashing}


def embed(df: DataFrame, text: str = "text", out: str = "embedding", cfg: Config = PROFILES["module"]) -> DataFrame:
    """Add ``out``; null for null and blank texts."""
    if cfg.embedder not in EMBEDDERS:
        raise ValueError(f"unknown embedder {cfg.embedder!r}")
    load, n, batch = EMBEDDERS[cfg.embedder], cfg.dimensions, cfg.batch

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load(n)
        for texts in batches:
            ok = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            vectors: list = [None] * len(texts)
            for a in range(0, len(ok), 64 * batch):
                part = ok[a : a + 64 * batch]
                for i, v in zip(part, f([texts.iloc[i] for i in part])):
                    vectors[i] = v
            yield pd.Series(vectors, dtype=object)

    return df.withColumn(out, run(F.col(text)))
