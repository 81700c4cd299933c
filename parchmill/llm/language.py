"""Problem 6: the language of records and of the segments of mixed ones.

A string kernel compares texts by the letter n-grams (orders 1 to ``ORDER``, with word
edges) present in their distinct words. Landmarks are the labelled samples; the Nyström map
of the kernel onto them feeds one-versus-rest kernel ridge regression. As the kernel is a
product of presence vectors, the map and the ridge weights multiply out to one row of
language scores per n-gram; a batch of units is scored by summing the rows of its distinct
words, each word's row being computed once.

Units are those of ``sentences``; a unit counts when it is a whole sentence (a terminator at
its end, or a script without any), no heading, running line or bare name. Its confidence is
the soft-max of its scores; a unit whose best score leads that of the record's main language by
less than ``MARGIN`` is taken to be in the main language.

Defined results: null and blank texts, and texts without a whole sentence, have no language;
labels are compared by language, whatever their spelling; a label outside LABELS names
another language; repeated rows count once; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentences
from .lookalike import invisible

ORDER, RIDGE, LANDMARKS, BITS = 5, 0.05, 600, 18
MARGIN, SHARPNESS = 0.35, 6.0
#: Spellings of each language's label.
LABELS = {
    "en": "en eng english", "ta": "ta tam tamil தமிழ்", "hi": "hi hin hindi हिन्दी हिंदी", "mr": "mr mar marathi मराठी",
    "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch", "es": "es spa spanish español espanol castellano",
    "ru": "ru rus russian русский", "zh": "zh zho chi chinese cmn 中文 mandarin", "ja": "ja jpn japanese 日本語 jp", "th": "th tha thai ไทย",
}
_BY_LABEL = {s: k for k, v in LABELS.items() for s in v.split()}
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’„«»¿¡…।॥。、，！？；：「」『』（）—–•·¬₹§№°²"
_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile("[" + "".join(chr(c) for c in (*range(0xA0, 0x2100), 0xFEFF) if invisible(chr(c))) + "]")
_END = re.compile(r"[.!?…।॥。！？|][\"'”’“»」』)\]]*$")
_LOW = r"(?<!\S)[\"'“«(¿¡‘„]*[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ][^\s]"
_LATER_LOWER = re.compile(rf"\S\s+{_LOW}", re.S)
_ENDING, _CLOSING = frozenset(".!?…।॥。！？|"), "\"'”’“»」』)]"
_THAI_CJK = re.compile(r"[฀-๿぀-鿿]")
_LETTERS_TH = re.compile(r"[฀-๿]")


def label_of(label: str | None) -> str | None:
    """The language a label names; None for none, '?' for one outside LABELS."""
    if label is None:
        return None
    s = label.strip().casefold()
    if s in ("", "und", "unknown", "null", "none", "n/a", "zxx", "mul"):
        return None
    return _BY_LABEL.get(s) or _BY_LABEL.get(re.split(r"[-_]", s)[0], "?")


@functools.lru_cache(maxsize=200_000)
def word_grams(word: str) -> np.ndarray:
    """The n-grams present in a word, as slots; four bytes each, as many words are kept."""
    w = f"\x02{word}\x03"
    grams = {w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)} - {"\x02", "\x03"}
    return np.array(list({xxhash.xxh3_64_intdigest(g) >> (64 - BITS) for g in grams}), np.int32)


def plain(token: str) -> str:
    t = token.strip(_STRIP).casefold()
    if _DIGITS.search(t):
        return "" if t.isascii() else _DIGITS.sub("", t).strip(_STRIP)
    return t


def words_of(text: str) -> set[str]:
    return {p for t in text.split() if (p := plain(t))}


def landmarks(samples: list[tuple[str, str]], most: int = LANDMARKS) -> list[tuple[str, str]]:
    """At most ``most`` samples, as many of each language as there are, those with the lowest
    hashes; every language has one while there are no more of these than ``most``."""
    by: dict[str, list[tuple[int, str]]] = {}
    for k, t in sorted(set(samples)):
        by.setdefault(k, []).append((xxhash.xxh3_64_intdigest(t), t))
    turn = [(n, h, k, t) for k, ts in by.items() for n, (h, t) in enumerate(sorted(ts))]
    return sorted((k, t) for _, _, k, t in sorted(turn)[:most])


def train(samples: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-gram slots, one row of scores per slot)."""
    samples = landmarks(samples)
    langs = sorted({k for k, _ in samples})
    grams = [[g for w in words_of(text) for g in word_grams(w)] for _, text in samples]
    slots = np.unique(np.array([g for gs in grams for g in gs], np.int64))
    presence = np.zeros((len(samples), len(slots)), np.float32)
    for i, gs in enumerate(grams):
        np.add.at(presence[i], np.searchsorted(slots, gs), 1)
    presence /= np.maximum(np.linalg.norm(presence, axis=1, keepdims=True), 1e-9)
    kernel = (presence @ presence.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-5
    root = vector[:, keep] / np.sqrt(value[keep])  # K^-1/2 of the landmarks
    phi = kernel @ root
    y = np.array([[1.0 if k == g else -1.0 / (len(langs) - 1) for g in langs] for k, _ in samples])
    weight = np.array([1.0 / sum(k == g for g, _ in samples) for k, _ in samples])[:, None] * len(samples) / len(langs)
    ridge = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return langs, slots, presence.T @ (root @ ridge).astype(np.float32)


class Scorer:
    def __init__(self, langs: list[str], slots: np.ndarray, rows: np.ndarray):
        self.langs, self.gram_rows = langs, np.zeros((1 << BITS, len(langs)), np.float32)
        self.gram_rows[slots] = rows
        self.clear()

    def clear(self) -> None:
        """Forget the words; row 0 is that of none."""
        self.known: dict[str, int] = {"": 0}
        self.table = np.zeros((1 << 14, len(self.langs) + 1), np.float32)

    def word(self, token: str) -> int:
        """The row of a token as written; its last column is the size of its n-gram set."""
        i = self.known.get(token)
        if i is None:
            p = plain(token)
            i = len(self.known) if p else 0
            if p:
                if i >= len(self.table):
                    self.table = np.vstack((self.table, np.zeros_like(self.table)))
                g = word_grams(p)
                self.table[i, :-1] = self.gram_rows[g].sum(0)
                self.table[i, -1] = len(g)
                self.known[token] = i
            elif len(self.known) < 300_000:
                self.known[token] = 0
        return i

    def score(self, units: list[str]) -> np.ndarray:
        """Kernel ridge scores of each unit, normalised by the size of its presence."""
        if len(self.known) > 300_000:
            self.clear()
        ids, starts, get, word = [], [], self.known.get, self.word
        for u in units:
            starts.append(len(ids))
            tokens = u.split()
            rows = set(map(get, tokens))
            if None in rows:
                rows.discard(None)
                rows.update([word(t) for t in tokens if t not in self.known])
            ids += rows
        if not units:
            return np.zeros((0, len(self.langs)))
        s = np.add.reduceat(self.table[ids], starts, axis=0)
        return s[:, :-1] / np.sqrt(np.maximum(s[:, -1:], 1))


_FURNITURE = re.compile(r"^[\W\d_]*$|^\W*(?:page|pg|p|seite|página|стр)?\W*\d*\W*(?:of|/|\|)?[\W\d]*(?:p a g e)?\W*$", re.I)


def unwrap(text: str, scanned: bool) -> str:
    """Scanned lines joined to running text, without lines that look like page furniture."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "|" in text:
        text = re.sub(r"(?<=[ऀ-ॿ])[|¦]+", "।", text)
    if not scanned or "\n" not in text:
        return text
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    for i in (*full[:2], *full[-2:]):
        x = lines[i].strip()
        words = [w for w in x.split() if w[:1].isalpha()]
        if _FURNITURE.match(x) or words and not _END.search(x) and len(x) < 60 and all(w[0].isupper() or len(w) < 4 for w in words):
            lines[i] = ""
    out = []
    for x in lines:
        x = x.strip()
        if out and x and out[-1] and not sentences._HEAD.match(out[-1]):
            prev = out[-1]
            if prev[-1] in "-‐¬­" and len(prev) > 1 and prev[-2].isalpha():
                out[-1] = prev[:-1] + x
            else:
                out[-1] = prev + " " + x
        else:
            out.append(x)
    return "\n".join(out)


def whole(unit: str) -> bool:
    """A sentence to its end: no heading, no bare name or number."""
    ended = unit.rstrip(_CLOSING)[-1:] in _ENDING
    if not ended and sentences._HEAD.match(unit):
        return False
    far = not unit.isascii() and max(unit) >= "\u0e00"
    if not ended and not (far and _LETTERS_TH.search(unit)):
        return False
    if far and _THAI_CJK.search(unit):
        return len(unit) > 1
    # Two words, of which one is no name: in running text a word of small letters after the first.
    return _LATER_LOWER.search(unit) is not None or " " in unit and unit.upper() == unit


class Detector:
    def __init__(self, tagger: sentences.Tagger, scorer: Scorer):
        self.tagger, self.scorer = tagger, scorer

    def batch(self, texts, scanned) -> list[list[tuple[int, int, str, float]]]:
        """Of each text its whole sentences as (start, end, language, confidence), offsets in
        the unwrapped text. The main language of a text is that of most of its clear units;
        it takes those whose best score leads its own by less than MARGIN."""
        units, owner, spans = [], [], []
        for k, (t, s) in enumerate(zip(texts, scanned)):
            if t is None or not t.strip():
                continue
            t = unwrap(t, s)
            at = 0
            for e in self.tagger.ends(t):
                u = t[at:e].strip()
                if whole(u):
                    units.append(u), owner.append(k), spans.append((e - len(u), e))
                at = e
        out: list[list] = [[] for _ in texts]
        if not units:
            return out
        z, who = self.scorer.score(units), np.array(owner)
        best = z.argmax(1)
        top = z[np.arange(len(z)), best]
        lead = top - np.partition(z, -2, axis=1)[:, -2]
        votes = np.zeros((len(texts), z.shape[1]))
        np.add.at(votes, (who, best), np.where(lead >= MARGIN, 1.0, 0.01))
        np.add.at(votes, who, 1e-4 * z)
        main = votes.argmax(1)[who]
        best = np.where(top - z[np.arange(len(z)), main] < MARGIN, main, best)
        p = np.exp(SHARPNESS * (z - top[:, None]))
        conf = p[np.arange(len(z)), best] / p.sum(1)
        for k, sp, i, c in zip(owner, spans, best, conf):
            out[k].append((*sp, self.scorer.langs[i], float(c)))
        return out


def languages(found: list[tuple[int, int, str, float]]) -> dict[str, tuple[int, float]]:
    """Language -> (sentences, mean confidence)."""
    out: dict[str, list[float]] = {}
    for _, _, lang, conf in found:
        out.setdefault(lang, []).append(conf)
    return {k: (len(v), float(np.mean(v))) for k, v in out.items()}


def fit(samples: DataFrame) -> tuple:
    """(sentence tagger, scorer tables) from the labelled samples, a table of fixed size."""
    rows = sentences.labelled(samples)
    tagger = sentences.train(sentences.training_documents(rows))
    return sentences.pack(tagger), train(rows)


_CACHE: dict = {}


def _named(name: str, broadcast) -> Detector:
    """The detector of one fit, built once in a worker."""
    if name not in _CACHE:
        _CACHE.clear()
        (weights, chain), scores = broadcast.value
        _CACHE[name] = Detector(sentences.Tagger(dict(weights), np.array(chain)), Scorer(*scores))
    return _CACHE[name]


def detect(spark: SparkSession, df: DataFrame, fitted: tuple, text: str = "text", scanned: str | None = None, out: str = "langs") -> DataFrame:
    """Add ``out``: array of (lang, sentences, confidence), the languages of whole sentences."""
    shared, name = spark.sparkContext.broadcast(fitted), uuid.uuid4().hex

    @F.pandas_udf("array<struct<lang:string,sentences:int,confidence:double>>")
    def run(texts: pd.Series, flags: pd.Series) -> pd.Series:
        d = _named(name, shared)
        got = d.batch(list(texts), list(flags))
        return pd.Series([[{"lang": k, "sentences": n, "confidence": c} for k, (n, c) in sorted(languages(x).items())] for x in got], dtype=object)

    return df.withColumn(out, sentences.once(run)(F.col(text), F.col(scanned) if scanned else F.lit(False)))


def segments(spark: SparkSession, df: DataFrame, fitted: tuple, text: str = "text", scanned: str | None = None, out: str = "segments") -> DataFrame:
    """Add ``out``: runs of whole sentences in one language, as (seg_no, lang, sentences,
    confidence, chars)."""
    shared, name = spark.sparkContext.broadcast(fitted), uuid.uuid4().hex

    @F.pandas_udf("array<struct<seg_no:int,lang:string,sentences:int,confidence:double,chars:int>>")
    def run(texts: pd.Series, flags: pd.Series) -> pd.Series:
        d, rows = _named(name, shared), []
        for x in d.batch(list(texts), list(flags)):
            segs: list[dict] = []
            for a, b, lang, conf in x:
                if segs and segs[-1]["lang"] == lang:
                    s = segs[-1]
                    s["confidence"] = (s["confidence"] * s["sentences"] + conf) / (s["sentences"] + 1)
                    s["sentences"], s["chars"] = s["sentences"] + 1, s["chars"] + b - a
                else:
                    segs.append({"seg_no": len(segs), "lang": lang, "sentences": 1, "confidence": conf, "chars": b - a})
            rows.append(segs)
        return pd.Series(rows, dtype=object)

    return df.withColumn(out, sentences.once(run)(F.col(text), F.col(scanned) if scanned else F.lit(False)))


def relabel(spark: SparkSession, df: DataFrame, fitted: tuple, text: str = "text", lang: str = "lang", scanned: str | None = None) -> DataFrame:
    """Rows whose label is missing or wrong, or whose text is mixed, one per language."""
    spellings = F.create_map(*(F.lit(x) for k, v in LABELS.items() for s in v.split() for x in (s, k)))
    s = F.lower(F.trim(F.col(lang)))
    named = F.when(s.isNull() | s.isin("", "und", "unknown", "null", "none", "n/a", "zxx", "mul"), F.lit(None)).otherwise(F.coalesce(spellings[s], spellings[F.split(s, "[-_]")[0]], F.lit("?")))
    got = detect(spark, df.where(F.col(text).isNotNull()), fitted, text, scanned).where(F.size("langs") > 0)
    case = named.isNull() | (F.size("langs") > 1) | (F.col("langs")[0]["lang"] != named)
    return got.where(case).withColumn("_l", F.explode("langs")).select(*[c for c in df.columns if c != lang], F.col("_l.lang").alias(lang), F.col("_l.sentences").alias("sentences"), F.col("_l.confidence").alias("confidence"))
