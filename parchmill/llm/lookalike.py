"""Problem 1: one form for texts that look the same but differ in characters.

Look-alike strings and code points are joined into transitive classes by union-find. Each
class gets the member that the corpus uses most as its representative, and a multi-pattern
automaton rewrites every other member, longest match first, on canonically decomposed
text, which is then composed again.

What is joined: wide, narrow and no-break forms, ligatures, leaders, hyphens, slashes,
blanks, invisible characters (with nothing), and letters of Latin, Cyrillic and Greek that
share a glyph. What is not: case, accents, raised figures, dashes, quotation marks.

Defined results: null stays null; an empty text stays empty; a text of blank and
invisible characters only becomes blanks; repeated rows get equal forms.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Letters of other scripts that print as the Latin letter before them.
SAME_GLYPH = """
A АΑ  B ВΒ  C СϹ  E ЕΕ  H НΗ  I ІΙӀ  J ЈͿ  K КΚ  M МΜ  N Ν  O ОΟ  P РΡ  S Ѕ  T ТΤ  X ХΧ  Y ҮΥ  Z Ζ
a а  c сϲ  d ԁ  e е  h һհ  i і  j јϳ  l ӏ  o оοօ  p р  q ԛ  s ѕ  u ս  v ѵν  w ԝ  x х  y уү
A Ꭺ  B Ᏼ  C Ꮯ  E Ꭼ  H Ꮋ  J Ꭻ  K Ꮶ  L Ꮮ  M Ꮇ  P Ꮲ  S Ꮪ  T Ꭲ  V Ꮩ  W Ꮃ  Z Ꮓ
""".split()
#: Strings that print as one another.
SAME_STRING = [("-", "‐", "‑"), ("/", "⁄", "∕"), (";", ";"), ("·", "·"), ("...", "…"), ("ஔ", "ஒள"), ("ௌ", "ெள"), ("आ", "अा"), ("ओ", "अो"), ("औ", "अौ"), ("ऐ", "एे"), ("ำ", "ํา"), ("แ", "เเ")]
#: Ranges of compatibility characters that print as their decomposition.
SAME_COMPAT = [(0xFB00, 0xFB06), (0x2024, 0x2026), (0x2160, 0x217F), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2F00, 0x2FD5)]
BLANKS = "\t\x0b\x0c\x85"
LINES = ("\r\n", "\r", " ", " ")


class UnionFind:
    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def invisible(c: str) -> bool:
    """Format characters but the Arabic signs, variation selectors, joiners and fillers."""
    return unicodedata.category(c) == "Cf" and not 0x0600 <= ord(c) <= 0x08FF or "︀" <= c <= "️" or c in "͏ᅟᅠㅤﾠ឴឵"


def _invisible_class() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0x80, 0x3200), *range(0xFE00, 0x10000), *range(0x110BD, 0x110CE), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0001, 0xE0080)) if invisible(chr(c))) + "]")


INVISIBLE = _invisible_class()


@functools.lru_cache(maxsize=1)
def classes() -> list[list[str]]:
    """All classes of more than one member; their number does not depend on the corpus."""
    uf = UnionFind()
    nfd = functools.partial(unicodedata.normalize, "NFD")
    for code in chain(range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x17000), range(0x18D00, 0x20000)):
        c = chr(code)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if invisible(c):
            uf.union("", c)
        elif unicodedata.category(c) == "Zs" or c in BLANKS:
            uf.union(" ", c)
        elif kind in ("<wide>", "<narrow>") or kind == "<noBreak>" and c != "\u2011" or kind == "<compat>" and any(a <= code <= b for a, b in SAME_COMPAT):
            uf.union(c, nfd("".join(chr(int(x, 16)) for x in rest.split())))
    for c in BLANKS:
        uf.union(" ", c)
    for c in LINES:
        uf.union("\n", c)
    for latin, others in zip(SAME_GLYPH[::2], SAME_GLYPH[1::2]):
        for c in others:
            uf.union(latin, c)
    for first, *others in SAME_STRING:
        for c in others:
            uf.union(nfd(first), nfd(c))
    groups: dict[str, list[str]] = {}
    for x in sorted(uf.up):
        groups.setdefault(uf.find(x), []).append(x)
    return [g for g in groups.values() if len(g) > 1]


@functools.lru_cache(maxsize=1)
def members() -> frozenset[str]:
    return frozenset(m for group in classes() for m in group if len(m) == 1)


def member_counts(text: str) -> Counter:
    """How often each member of one character is used. Strings need no counts, as they
    always represent their class."""
    n = Counter(text if text.isascii() else unicodedata.normalize("NFD", text))
    return Counter({c: n[c] for c in n.keys() & members()})


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Each member that is not its class's representative, with that representative: the
    most frequent member, then the one of lowest code points. Nothing represents the
    invisible ones, and the plain blank and line feed represent theirs. A class with a
    string of several characters is represented by the string, each character by its own
    representative, so that strings that overlap (ff, fi, ffi) are rewritten alike."""
    out, strings = {}, []
    for group in classes():
        fixed = [m for m in ("", " ", "\n") if m in group]
        long = [m for m in group if len(m) > 1 and m != "\r\n"]
        if long and not fixed:
            strings.append((group, min(long)))
            continue
        best = fixed[0] if fixed else min(group, key=lambda m: (-counts.get(m, 0), m))
        out |= {m: best for m in group if m != best}
    for group, text in strings:
        best = "".join(out.get(c, c) for c in text)
        out |= {m: best for m in group if m != best and len(m) == 1}
    return out


#: Code points that canonical decomposition may change.
_COMPOSED = (*range(0xC0, 0x3400), *range(0xF900, 0xFB50))


class Rewriter:
    def __init__(self, mapping: dict[str, str]):
        self.auto = ahocorasick.Automaton()
        for m, best in mapping.items():
            self.auto.add_word(m, (len(m), best))
        self.auto.make_automaton()
        # Characters that are members, or are composed of one; texts without any keep theirs.
        single = {m for m in mapping if len(m) == 1}
        composed = [c for c in map(chr, _COMPOSED) if not single.isdisjoint(unicodedata.normalize("NFD", c))]
        self.some = re.compile("[" + "".join(map(re.escape, sorted({*single, *composed}))) + "]" + "".join("|" + re.escape(m) for m in sorted(mapping) if len(m) > 1) if mapping else "(?!)")

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        if not self.some.search(text):
            return text if text.isascii() else unicodedata.normalize("NFC", text)
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (size, best) in self.auto.iter_long(text):
            start = end + 1 - size
            if text[end] == "\u200d" and start and unicodedata.category(text[start - 1]) in ("So", "Sk"):
                continue  # joins the parts of one picture
            out += (text[at:start], best)
            at = end + 1
        return unicodedata.normalize("NFC", "".join((*out, text[at:])))


@functools.lru_cache(maxsize=4)
def _rewriter(items: tuple) -> Rewriter:
    return Rewriter(dict(items))


def corpus_counts(df: DataFrame, column: str) -> DataFrame:
    """(member, n) over the whole column, at most one row per member; counted per batch
    before the shuffle."""

    def count(batches):
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf.iloc[:, 0].dropna():
                total.update(member_counts(t))
        yield pd.DataFrame({"member": list(total), "n": list(total.values())})

    return df.select(F.col(column)).mapInPandas(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def same_form(spark: SparkSession, df: DataFrame, column: str = "text", counts: dict[str, int] | None = None, out: str = "form") -> DataFrame:
    """Add ``out``. ``counts`` are those of corpus_counts; the collected table has at most
    as many rows as there are members in ``classes()``."""
    if counts is None:
        counts = {r["member"]: r["n"] for r in corpus_counts(df, column).collect()}
    shared = spark.sparkContext.broadcast(tuple(sorted(representatives(counts).items())))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        f = _rewriter(shared.value)
        return pd.Series([f(t) if t is not None else None for t in texts], dtype=object)

    return df.withColumn(out, rewrite(F.col(column)))


def look_alike_pairs(df: DataFrame, key: str, text: str = "text", form: str = "form", part: str = "tbl") -> DataFrame:
    """Pairs (rec_a < rec_b) of different keys in one part with equal forms and different
    code points. Groups without a second spelling are dropped before the join, which sees
    fingerprints, not texts."""
    rows = df.where(F.regexp_replace(form, r"\s+", "") != "").select(part, F.col(key).alias("rec"), F.md5(F.col(form).cast("binary")).alias("f"), F.md5(F.col(text).cast("binary")).alias("t")).distinct().transform(cut)
    mixed = rows.groupBy(part, "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select(part, "f")
    rows = rows.join(mixed, [part, "f"], "left_semi")
    a, b = rows.select(part, "f", F.col("rec").alias("rec_a"), F.col("t").alias("ta")), rows.select(part, "f", F.col("rec").alias("rec_b"), F.col("t").alias("tb"))
    return a.join(b, [part, "f"]).where("rec_a < rec_b and ta <> tb").select(part, "rec_a", "rec_b")
