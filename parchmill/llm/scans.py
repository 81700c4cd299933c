"""Problem 3: noise in the text of scanned pages.

An averaged perceptron edits characters. At every site where a known confusion could have
happened it predicts one operation: keep, replace, delete, insert (a confusion of two
characters with one is a replacement with a deletion or an insertion), and at a line's end
join or keep. Its features are the characters around the site, the kind of confusion, the
shape of the word, and how often the corpus has the word as read and as repaired. All
words that confusions can turn into one another fold to one form, so that the repairs the
corpus knows are the words of the same form: one row a word, any number of confusions, and no
list of variants. Of these the one is looked at that is most frequent for the confusions it
takes; where there is none, every mark inside letters is a site with its own options. The
perceptron is trained on words of pages that are not scanned, with confusions and line breaks
put in: a bounded, hash-chosen sample of ``TRAIN_WORDS`` words.

Running headers and footers are lines at a page's edge that recur at the edges of the file's
other pages; lines that occur once are judged by a second perceptron on their words and
place, trained on ``TRAIN_LINES`` lines of files with enough pages to tell. A line with
nothing but the page's own number, in figures, Roman figures or misread, is a page number.

Whether a page is scanned is read off its hard line breaks; ``is_ocr`` and ``confidence``
only decide where these leave it open. Defined results: null and blank pages have no noisy
lines; repeated deliveries count once; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .sentences import _HEAD

TRAIN_WORDS, TRAIN_LINES, EDGE = 9000, 6000, 3
#: What is printed, and what is read for it.
CONFUSIONS = """
e c  c e  a @  t +  o 0  i !  l !  l 1  i 1  l |  i |  I l  I |  I 1  l I  g 9  q 9  S 5  s 5  B 8  b 6  f ſ  O 0  Z 2  z 2  s $
n ri  m rn  d cl  u ii  h li  w vv  li h  cl d  rn m  ri n  ii u  vv w  h b  । |  ॥ ||
1 l  0 O  1 I  1 !  1 |
""".split()
PAIRS = sorted(set(zip(CONFUSIONS[::2], CONFUSIONS[1::2])))
HYPHENS = "-‐‑¬­"
_TOKEN = re.compile(r"\S+")
_OUTER = "“”‘’\"'«»()[]{}„¿¡,;:.?…"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_FIGURE = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "o": "0", "O": "0", "S": "5", "s": "5", "g": "9", "q": "9", "B": "8", "Z": "2", "z": "2"})
_PAGE = re.compile(r"^\W*(?:(?:p[a@]ge|p[g9]|p)\b\.?\W*)?([\dlI|!ioOSsgqBZz]{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*[\dlIoO]{1,5})?(?:\s*\|\s*p\s*[a@]\s*[g9]\s*[ec])?\W*$", re.I)
_FOLD = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h")]
_FOLD1 = str.maketrans({"0": "o", "1": "i", "|": "i", "!": "i", "l": "i", "@": "a", "+": "t", "9": "g", "c": "e", "5": "s", "8": "b", "ſ": "f", "$": "s"})


def roman(s: str) -> int:
    v = [_ROMAN[c] for c in s.lower()]
    return sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0]))


def page_figure(line: str, page: int | None) -> bool:
    """Whether a line is nothing but the number of this page."""
    m = _PAGE.match(line)
    if not m or page is None or not any(c.isalnum() for c in line):
        return False
    s = m[1]
    if s.translate(_FIGURE).isdigit() and int(s.translate(_FIGURE)) == page:
        return True
    return all(c in _ROMAN for c in s.lower()) and roman(s) == page


def skeleton(line: str, page: int | None) -> str:
    """The line without its page number, folded so that misreadings fall together."""
    s = re.sub(r"(?:\s{2,}|\s*[|•·–—-]\s*)([\dlI|!oO]{1,5})\s*$", lambda m: "" if page is not None and m[1].translate(_FIGURE) == str(page) else m.group(), line.strip())
    s = s.casefold()
    for a, b in _FOLD:
        s = s.replace(a, b)
    return re.sub(r"[\W_]+", "", s.translate(_FOLD1))


def ends_unit(line: str) -> bool:
    return bool(re.search(r"[.!?…।॥。！？|][\"'”’“»」)\]]*$", line.rstrip()))


def is_scanned(lines: list[str], is_ocr, confidence) -> bool:
    wraps = 0
    for a, b in zip(lines, lines[1:]):
        if a.strip() and b.strip() and not ends_unit(a) and not _HEAD.match(a):
            wraps += 1
    if wraps >= 2:
        return True
    rated = confidence is not None and confidence == confidence
    return rated or wraps == 1 and is_ocr is not None and bool(is_ocr)


def full_lines(text: str) -> list[tuple[int, str, int]]:
    """(line number, line, distance from the page's edge) of each line that is not blank."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, lines[i], min(k, len(full) - 1 - k)) for k, i in enumerate(full)]


def stray(line: str) -> bool:
    """Nothing but marks, and not a rule drawn on purpose."""
    s = line.strip()
    return bool(s) and len(s) <= 8 and not any(c.isalnum() for c in s) and not re.fullmatch(r"([-=_*.~])\1{3,}", s) and not any("ऀ" <= c <= "෿" for c in s)


def strip_outer(token: str) -> tuple[str, int]:
    left = len(token) - len(token.lstrip(_OUTER))
    return token.strip(_OUTER), left


# ---- the editor -------------------------------------------------------------------------


def sites(word: str) -> list[tuple[int, str, str]]:
    """(place, read, printed) of every confusion that could have made this word."""
    out = []
    for printed, read in PAIRS:
        at = word.find(read)
        while at >= 0:
            out.append((at, read, printed))
            at = word.find(read, at + 1)
    return out


_FORM = {
    **dict.fromkeys("ec", "e"), **dict.fromkeys("a@", "a"), **dict.fromkeys("t+", "t"), **dict.fromkeys("o0", "o"), **dict.fromkeys("il!1|।", "i"), **dict.fromkeys("g9q", "g"), **dict.fromkeys("s5$", "s"),
    **dict.fromkeys("b86hu॥", "ii"), **dict.fromkeys("fſ", "f"), **dict.fromkeys("z2", "z"), "n": "ri", "m": "rri", "d": "ei", "w": "vv",
}
_FORMS = str.maketrans(_FORM)


def form(key: str) -> str:
    """The form that a key shares with every key that confusions make of it: each character
    by itself becomes a string, and both sides of every confusion become the same one."""
    return key.translate(_FORMS)


def word_form(word: str) -> str:
    return form(_key(word.replace("ſ", "f")))


_READ: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
for _printed, _seen in PAIRS:
    _READ[_seen[0]].append((_seen, _printed, _printed.casefold()))


def path(word: str, key: str) -> tuple | None:
    """The fewest confusions (place in ``word``, read, printed) that make ``word``, but for case
    and closing marks, of ``key``; None if none do. Figures and marks without a letter beside
    them are no confusions, and a letter by itself is an initial as well as a figure."""
    if len(word.rstrip(_CLOSING)) < 2 or not any(c.isalpha() for c in word):
        return None
    return _path(word, key, len(word)) or _path(word, key, len(word.rstrip(_CLOSING)))


def _path(word: str, key: str, end: int) -> tuple | None:
    best: dict[tuple[int, int], tuple[int, tuple]] = {(0, 0): (0, ())}
    for i in range(end):
        for (a, j), (n, edits) in [x for x in best.items() if x[0][0] == i]:
            c = word[i].casefold()
            steps = [(i + 1, j + len(c), n, edits)] if key.startswith(c, j) else []
            steps += [(i + len(read), j + len(low), n + 1, (*edits, (i, read, printed))) for read, printed, low in _READ.get(word[i], ()) if key.startswith(low, j) and word.startswith(read, i) and i + len(read) <= end]
            for x, y, m, e in steps:
                if (x, y) not in best or (m, e) < best[x, y]:
                    best[x, y] = (m, e)
    got = best.get((end, len(key)))
    return got[1] if got else None


def mark_sites(word: str) -> dict[int, list[tuple]]:
    """Place -> options, of marks and figures inside a word with letters."""
    out: dict[int, list[tuple]] = {}
    if any(c.isalpha() for c in word):
        for at, read, printed in sites(word):
            if not read.isalpha() or read == "ſ":
                out.setdefault(at, []).append((at, read, printed))
    return out


def operation(read: str, printed: str) -> str:
    return "replace" if len(read) == len(printed) else "delete" if len(read) > len(printed) else "insert"


def _bucket(n: float) -> int:
    return int(np.log2(n + 1) * 1.0)


def edit_features(word: str, edits: tuple, own: int, other: int, site: tuple) -> list[str]:
    """Features of one of the edits that make a repair."""
    if all(e[1:] in (("|", "।"), ("||", "॥")) for e in edits):
        own = 0  # words are counted without their closing mark
    common = own * 8 > other
    f = [f"common{common}", f"common{common} {'mark' if any(not r.isalpha() for _, r, _ in edits) else 'soft'}", f"own{min(_bucket(own), 8)}", f"other{min(_bucket(other), 10)}", f"ratio{max(-8, min(12, round(np.log2((other + 0.5) / (own + 0.5)))))}", f"n{len(edits)}", f"seen{own > 1}{other > 0}"]
    shape = ("D" if any(c.isdigit() for c in word) else "") + ("a" if any(c.isalpha() for c in word) else "") + ("U" if word.isupper() else "C" if word[:1].isupper() else "l")
    at, read, printed = site
    kind = "mark" if not read.isalpha() else "soft"
    before, after = word[max(0, at - 2) : at], word[at + len(read) : at + len(read) + 2]
    inside = bool(before[-1:].isalpha()) + 2 * bool(after[:1].isalpha())
    return [*f, f"{read}>{printed}", f"{read}>{printed} {inside}{shape}", f"{kind}{inside}{shape}", f"{read}>{printed} {before[-1:]}_{after[:1]}", f"{read}>{printed} o{other > 0} w{min(own, 3)}", f"{kind} o{min(_bucket(other), 5)} w{min(_bucket(own), 5)}", f"{read} L{before}", f"{read} R{after}"]


def join_features(left: str, mark: str, right: str, joined: int, hyphened: int) -> list[str]:
    r = max(-8, min(8, round(np.log2((joined + 0.5) / (hyphened + 0.5)))))
    kind = "soft" if mark in "¬­" else "hyphen"
    case = ("d" if left[-1:].isdigit() else "U" if left[-1:].isupper() else "l") + ("d" if right[:1].isdigit() else "U" if right[:1].isupper() else "l" if right[:1].isalpha() else "x")
    return [f"r{r} {kind}", f"j{min(_bucket(joined), 6)} h{min(_bucket(hyphened), 6)}", kind, f"{case} {kind}", case, f"len{min(len(left), 4)}{min(len(right), 4)}", f"pre{left.casefold()}", f"any{joined > 0}{hyphened > 0} {kind}"]


class Perceptron:
    """Averaged, many classes; ``legal`` limits the classes of an example."""

    def __init__(self, weights: dict | None = None):
        self.w = {} if weights is None else weights

    def scores(self, features: list[str], legal: tuple[str, ...]) -> dict[str, float]:
        return {k: sum(self.w.get((f, k), 0.0) for f in features) for k in legal}

    def best(self, features: list[str], legal: tuple[str, ...]) -> str:
        s = self.scores(features, legal)
        return max(legal, key=lambda k: (s[k], k == legal[0]))

    @classmethod
    def train(cls, data: list[tuple[list[str], tuple[str, ...], str]], epochs: int = 8) -> Perceptron:
        p, total, step, rng = cls(), defaultdict(float), 1, random.Random(2)
        data = list(data)
        for _ in range(epochs):
            rng.shuffle(data)
            for f, legal, gold in data:
                got = p.best(f, legal)
                if got != gold:
                    for x in f:
                        for k, d in ((gold, 1.0), (got, -1.0)):
                            p.w[x, k] = p.w.get((x, k), 0.0) + d
                            total[x, k] += d * step
                step += 1
        return cls({k: v - total[k] / step for k, v in p.w.items() if v - total[k] / step})


# ---- tables -----------------------------------------------------------------------------


def _continuation(lines: list[tuple[int, str, int]], k: int) -> tuple[int, str, int] | None:
    """The line that goes on after line k of the lines that aren't blank: the next, or after
    a word broken off, the next with a letter in it."""
    broken = lines[k][1].rstrip()
    word = len(broken) > 1 and broken[-1] in HYPHENS and broken[-2].isalpha()
    for x in lines[k + 1 : k + 4]:
        if any(c.isalpha() for c in x[1]) or not word:
            return x if word or x[0] == lines[k][0] + 1 else None
    return None


_PAGE_COLS = ["page_id", "doc_id", "page_number", "text", "is_ocr", "confidence"]


def _scanned(pages: DataFrame) -> DataFrame:
    """The scanned pages: (page_id, doc_id, page_number, text)."""

    @F.pandas_udf("boolean")
    def scanned(text: pd.Series, ocr: pd.Series, conf: pd.Series) -> pd.Series:
        return pd.Series([bool(t.strip()) and is_scanned(t.split("\n"), o, c) for t, o, c in zip(text, ocr, conf)], dtype=bool)

    return pages.where("text is not null").where(scanned("text", "is_ocr", "confidence")).select("page_id", "doc_id", "page_number", "text")


def _number(page) -> int | None:
    return None if page is None or page != page else int(page)


def _edges(scanned: DataFrame) -> DataFrame:
    """The lines at the edges of scanned pages that are not page numbers."""

    def run(batches):
        for pdf in batches:
            rows = []
            for pid, doc, page, text in pdf.itertuples(index=False):
                page, got = _number(page), full_lines(text)
                for i, line, edge in got:
                    if edge < EDGE and not page_figure(line, page):
                        rows.append((pid, doc, page, i, line, edge, skeleton(line, page), len(got)))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "doc_id", "page_number", "line_no", "line", "edge", "skeleton", "n_lines"]).astype({"page_number": "Int32"})

    return scanned.mapInPandas(run, "page_id long, doc_id long, page_number int, line_no int, line string, edge int, skeleton string, n_lines int")


def line_features(line: str, page, edge: int, n_lines: int) -> list[str]:
    s = line.strip()
    words = [w.strip(_OUTER + "/|") for w in s.split()]
    letters = [w for w in words if w[:1].isalpha()]
    cap = sum(w[0].isupper() for w in letters)
    number = bool(re.search(r"\s{2,}\d{1,4}$", line.rstrip())) and s.split()[-1] == str(page)
    f = [f"edge{edge}", f"end{ends_unit(s)}", f"cap{round(4 * cap / max(1, len(letters)))}", f"len{min(12, len(s) // 6)}", f"words{min(9, len(words))}", f"num{number}", f"upper{s.upper() == s}", f"first{s[:1].isupper()}{s[:1].isdigit()}", f"edge{edge} end{ends_unit(s)} cap{round(2 * cap / max(1, len(letters)))}"]
    f += [f"w:{w.casefold()}" for w in words if w.isalpha()]
    f += [f"w2:{a.casefold()} {b.casefold()}" for a, b in zip(words, words[1:]) if a.isalpha() and b.isalpha()]
    return f


def _header_lines(spark: SparkSession, edge: DataFrame) -> DataFrame:
    """(page_id, line_no) of running headers and footers."""
    seen = edge.where(F.length("skeleton") >= 6).groupBy("doc_id", "skeleton").agg(F.count_distinct("page_id").alias("on"))
    facts = edge.join(seen, ["doc_id", "skeleton"], "left").withColumn("on", F.coalesce("on", F.lit(1)))
    open_end = ~F.rtrim("line").rlike("[.!?…।॥。！？|,;][\"'”’“»」)\\]]*$")
    facts = facts.withColumn("open_end", open_end).withColumn("h", F.xxhash64("page_id", "line_no"))
    # Lines that recur are headers; lines that don't, in files of many pages, are not.
    yes = facts.where("on >= 3 and open_end").orderBy("h").limit(TRAIN_LINES // 2)
    pages = edge.groupBy("doc_id").agg(F.count_distinct("page_id").alias("pages")).where("pages >= 6")
    no = facts.where("on = 1").orderBy("h").limit(4 * TRAIN_LINES).join(pages, "doc_id", "left_semi").orderBy("h").limit(TRAIN_LINES)
    cols = ["line", "page_number", "edge", "n_lines"]
    rows = [(r, "header") for r in yes.select(*cols).collect()] + [(r, "other") for r in no.select(*cols).collect()]
    model = Perceptron.train([(line_features(r["line"], r["page_number"], r["edge"], r["n_lines"]), ("other", "header"), y) for r, y in rows], 6)
    shared = spark.sparkContext.broadcast(model.w)

    @F.pandas_udf("boolean")
    def judged(line: pd.Series, page: pd.Series, edge: pd.Series, n: pd.Series) -> pd.Series:
        p = Perceptron(shared.value)
        return pd.Series([p.best(line_features(a, None if b is None or b != b else int(b), c, d), ("other", "header")) == "header" for a, b, c, d in zip(line, page, edge, n)], dtype=bool)

    return facts.where("open_end").withColumn("judged", judged("line", "page_number", "edge", "n_lines")).where((F.col("on") >= 2) & (F.length("skeleton") >= 8) & F.col("judged") | (F.col("on") >= 4) & (F.length("skeleton") >= 6) | F.col("judged")).select("page_id", "line_no")


_EDITS = "array<struct<at:int,read:string,printed:string>>"


def body_of(text: str, page: int | None, drop: set[int]):
    """(line number, line, following line or None, its number, whether it begins with the rest of
    a broken word) of the lines that are neither dropped nor page numbers."""
    got = full_lines(text)
    keep = [k for k, (i, line, edge) in enumerate(got) if i not in drop and not (edge < EDGE and page_figure(line, page))]
    kept = {got[k][0] for k in keep}
    rest = set()
    out = []
    for k in keep:
        i, line, _ = got[k]
        nxt = _continuation(got, k)
        if nxt and _BROKEN.search(line.rstrip()):
            rest.add(nxt[0])
        out.append((i, line, nxt[1] if nxt and nxt[0] in kept else None, nxt[0] if nxt and nxt[0] in kept else None))
    return [(*x, x[0] in rest) for x in out]


_BROKEN = re.compile(f"[^\\W_][{HYPHENS}]$")


def tokens_of(line: str, nxt: str | None, continues: bool) -> tuple[list[tuple[str, int]], tuple | None]:
    """The words of a running line, and of its last, if broken off, (first part, rest, mark)."""
    toks = [(m.group(), m.start()) for m in _TOKEN.finditer(line)]
    if continues and toks:
        toks = toks[1:]
    broken, tail = line.rstrip(), None
    if nxt and len(broken) > 1 and broken[-1] in HYPHENS and broken[-2].isalnum() and toks:
        last = toks.pop()[0]
        head = strip_outer(last)[0].rstrip(HYPHENS)
        rest = strip_outer(nxt.split()[0])[0] if nxt.split() else ""
        if head and rest:
            tail = (head, rest, broken[-1])
    words = []
    for t, at in toks:
        w, left = strip_outer(t)
        if w:
            words.append((w, at + left))
    return words, tail


def broken_words(head: str, rest: str, mark: str) -> list[tuple[str, int]]:
    """Words that a broken one may be, with the length of the part on the first line."""
    return [(head + rest, len(head)), *([(f"{head}-{rest}", len(head) + 1)] if mark in "-‐‑" else [])]


_MARKS = "page_id long, line_no int, kind string, next_no int, head string, rest string, mark string"


def _marks(scanned: DataFrame) -> DataFrame:
    """Page numbers, stray marks and broken words of scanned pages without their headers."""

    def run(batches):
        for pdf in batches:
            rows = []
            for pid, page, text, drop in pdf.itertuples(index=False):
                page = _number(page)
                drop = set() if drop is None else {int(x) for x in drop}
                rows += [(pid, i, "pageno", None, None, None, None) for i, line, edge in full_lines(text) if edge < EDGE and page_figure(line, page)]
                for i, line, nxt, no, continues in body_of(text, page, drop):
                    if stray(line):
                        rows.append((pid, i, "stray", None, None, None, None))
                    tail = tokens_of(line, nxt, continues)[1]
                    if tail:
                        rows.append((pid, i, "broken", no, *tail))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "line_no", "kind", "next_no", "head", "rest", "mark"]).astype({"next_no": "Int32"})

    return scanned.select("page_id", "page_number", "text", "drop").mapInPandas(run, _MARKS)


#: Bits of the filter that tokens pass before the join with misread words; of fixed size, it
#: lets more pass as there are more of these, and never holds one back.
FILTER_BITS = 1 << 23


def _bit(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % FILTER_BITS for w in words), np.int64)


def _filter_of(words: DataFrame) -> np.ndarray:
    """The filter of all words: bitmaps of 32,768 bits are put together by the executors, at
    most FILTER_BITS in all."""

    @F.pandas_udf("long")
    def bit(w: pd.Series) -> pd.Series:
        return pd.Series(_bit(w))

    b = words.select(bit("word").alias("b"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for n, m in b.groupBy(F.floor(F.col("b") / 32768).alias("n")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("m")).collect():
        bits[n * 4096 : (n + 1) * 4096] = np.frombuffer(m, np.uint8)
    return np.unpackbits(bits, bitorder="little").astype(bool)


def _words_of(spark: SparkSession, scanned: DataFrame, misread: DataFrame) -> DataFrame:
    """(page_id, line_no, next_no, word, split) of the words of running lines that the filter of
    misread words lets pass. A broken word is one row, with the length of its first part."""
    shared = spark.sparkContext.broadcast(np.packbits(_filter_of(misread), bitorder="little"))

    def run(batches):
        bits = np.unpackbits(shared.value, bitorder="little").astype(bool)
        known: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            if len(known) > 500_000:
                known.clear()
            for pid, page, text, drop in pdf.itertuples(index=False):
                drop = set() if drop is None else {int(x) for x in drop}
                for i, line, nxt, no, continues in body_of(text, _number(page), drop):
                    words, tail = tokens_of(line, nxt, continues)
                    found = [(w, None, None) for w, _ in words] + ([(w, no, k) for w, k in broken_words(*tail)] if tail else [])
                    for w, n, k in found:
                        if w not in known:
                            known[w] = bool(bits[xxhash.xxh3_64_intdigest(w) % FILTER_BITS])
                        if known[w]:
                            rows.append((pid, i, n, w, k))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "line_no", "next_no", "word", "split"]).astype({"split": "Int32", "next_no": "Int32"})

    return scanned.select("page_id", "page_number", "text", "drop").mapInPandas(run, "page_id long, line_no int, next_no int, word string, split int")


_CLOSING = ".,;:!?|।॥"


def _key(word: str) -> str:
    """The form under which words are counted: case folded, closing marks off."""
    return word.casefold().rstrip(_CLOSING) or word.casefold()


def _page_words(pages: DataFrame) -> DataFrame:
    """(word, key, n, clean): words of all pages with counts; clean counts pages not scanned."""

    def run(batches):
        for pdf in batches:
            n: dict = defaultdict(lambda: [0, 0])
            for text, ocr, conf in pdf.itertuples(index=False):
                if text is None:
                    continue
                clean = not is_scanned(text.split("\n"), ocr, conf)
                for t in text.split():
                    w = strip_outer(t)[0]
                    if w:
                        c = n[w]
                        c[0] += 1
                        c[1] += clean
            yield pd.DataFrame([(k, _key(k), a, b) for k, (a, b) in n.items()], columns=["word", "key", "n", "clean"])

    return pages.select("text", "is_ocr", "confidence").mapInPandas(run, "word string, key string, n long, clean long").groupBy("word", "key").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def _groups(counts: DataFrame) -> DataFrame:
    """(form, group): the keys of each form with their counts."""

    @F.pandas_udf("string")
    def to_form(keys: pd.Series) -> pd.Series:
        return pd.Series([form(k) for k in keys], dtype=object)

    return counts.groupBy(to_form("key").alias("form")).agg(F.collect_list(F.struct("n", "key")).alias("group"))


def _evidence(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, marks, group): distinct words with the counted keys of their form, without and with
    their closing marks."""

    @F.pandas_udf("string")
    def to_form(w: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([form(x.replace("ſ", "f").casefold()) if m else word_form(x) for x, m in zip(w, marks)], dtype=object)

    one = words.select("word").distinct()
    # A closing bar or exclamation mark may be a letter: such words are looked up with it, too.
    whole = one.where(F.col("word").rlike(r"\p{L}[|!]+$")).select("word", F.lit(True).alias("marks"))
    both = one.select("word", F.lit(False).alias("marks")).union(whole).withColumn("form", to_form("word", "marks"))
    return both.join(groups, "form", "left").select("word", "marks", "group")


def legal(e: tuple) -> tuple[str, str]:
    """What may be done at a site: nothing, or the operation that its confusion takes back."""
    return "keep", operation(*e[1:])


def candidate(word: str, group: list[tuple[int, str]]) -> tuple[int, int, tuple]:
    """(own count, the repair's count, its edits). The repair is the key of the group that has the
    highest count, a quarter for each confusion it takes, and no lower count than the word;
    a closing bar in a script with dandas is one, of the word itself. No edits: none."""
    key = _key(word)
    own = next((n for n, k in group if k == key), 0)
    best: tuple = (0.0, 0, ())
    for n, k in sorted(group, reverse=True):
        if n < own or n / 4 < best[0]:
            break  # at least one confusion
        if k != key and (edits := path(word, k)):
            value = n / 4 ** len(edits)
            if value > best[0] or value == best[0] and len(edits) < len(best[2]):
                best = (value, n, edits)
    bars = len(word) - len(word.rstrip("|"))
    if 0 < bars <= 2 and "ऀ" <= word[: -bars][-1:] <= "ॿ" and own / 4 >= best[0]:
        best = (own / 4, own, ((len(word) - bars, "|" * bars, "।" if bars == 1 else "॥"),))
    return own, best[1], best[2]


def edit(p: Perceptron, word: str, group: list[tuple[int, str]], marks: bool = False) -> tuple:
    """The edits that the perceptron predicts, site by site. ``marks``: the group is that of the
    word with its closing marks."""
    own, other, edits = candidate(word, group)
    if edits or marks:
        return tuple(e for e in edits if p.best(edit_features(word, edits, own, other, e), legal(e)) != "keep")
    out, end = [], 0
    marks = mark_sites(word)
    for at in sorted(marks):
        if at < end:
            continue
        found = []
        for e in marks[at]:
            s = p.scores(edit_features(word, (e,), own, 0, e), legal(e))
            gain = s[legal(e)[1]] - s["keep"]
            if gain > 0:
                found.append((gain, e))
        if found:
            e = max(found)[1]
            out.append(e)
            end = at + len(e[1])
    return tuple(out)


def spoil(word: str, rng: random.Random) -> tuple[str, tuple] | None:
    """A clean word with a confusion put in, and the edits that undo it."""
    options = [(word.find(p), r, p) for p, r in PAIRS if p in word]
    if not options:
        return None
    at, read, printed = rng.choice(options)
    places = [i for i in range(len(word)) if word.startswith(printed, i)]
    at = rng.choice(places)
    return word[:at] + read + word[at + len(printed) :], ((at, read, printed),)


def _train_editor(spark: SparkSession, groups: DataFrame, raw: DataFrame) -> dict:
    sample = [(r["word"], r["clean"]) for r in raw.where("clean > 0").withColumn("h", F.xxhash64("word")).orderBy("h").limit(TRAIN_WORDS).select("word", "clean").collect()]
    rng = random.Random(4)
    bad = {}
    for w, _ in sample:
        if (s := spoil(w, rng)) and len(w) > 2:
            bad[s[0]] = (w, s[1])
    clean = {w for w, _ in sample}
    words = spark.createDataFrame([(w,) for w in sorted(clean | set(bad))], "word string") if sample else None
    data = []
    for r in [] if words is None else sorted(_evidence(words, groups).collect(), key=lambda r: (r["word"], r["marks"])):
        w, group = r["word"], [(x["n"], x["key"]) for x in r["group"] or ()]
        if r["marks"] and not (edits := candidate(w, group)[2]):
            continue
        if w in bad and w not in clean:
            orig, edits = bad[w]
            n = next((n for n, k in group if k == _key(orig)), 0)
            own = min(next((n for n, k in group if k == _key(w)), 0), 1 + n // 200)  # the mistake itself is rare
            data.append((edit_features(w, edits, own, n, edits[0]), legal(edits[0]), operation(*edits[0][1:])))
            if edits[0][0] in mark_sites(w) and rng.random() < 0.3:  # words that the corpus has nowhere else
                data.append((edit_features(w, edits, own, 0, edits[0]), legal(edits[0]), operation(*edits[0][1:])))
            continue
        own, n, edits = candidate(w, group)
        options = edits or [e for es in mark_sites(w).values() for e in es]
        data += [(edit_features(w, edits or (e,), own, n, e), legal(e), "keep") for e in options]
    joins, own = [], []
    hyphened = raw.where("clean > 0").where(F.col("word").rlike(r"^[\p{L}\d]+(-[\p{L}\d]+)+$")).withColumn("h", F.xxhash64("word")).orderBy("h").limit(TRAIN_WORDS // 3).select("word", "clean").collect()
    for w, n in sorted((r["word"], r["clean"]) for r in hyphened):
        for i, c in enumerate(w):
            if c == "-":
                for known in (n, n, 0):  # a misread half hides the count
                    own.append((join_features(w[:i], "-", w[i + 1 :], 0, known), ("keep", "join"), "keep"))
    for w, n in sample:
        if len(w) >= 4 and w.isalpha():
            i = rng.randint(1, len(w) - 2)
            joins.append((join_features(w[:i], rng.choice("---‐¬­"), w[i:], n if rng.random() < 0.7 else 0, 0), ("keep", "join"), "join"))
    for n in range(300):
        a, b = rng.randint(1, 31), rng.randint(1, 2020)
        own.append((join_features(str(a), "-", f"{b}", 0, 0), ("keep", "join"), "keep"))
    joins += own * max(1, len(joins) // (4 * len(own)))  # hyphens of the word's own are few
    return {"edit": Perceptron.train(data).w, "join": Perceptron.train(joins).w}


class Findings:
    """Tables of one run: headers, marks of other lines, and the misread words with their edits."""

    def __init__(self, spark: SparkSession, pages: DataFrame):
        pages = pages.select(*_PAGE_COLS).dropDuplicates(["page_id"])
        raw = cut(_page_words(pages))
        counts = raw.groupBy("key").agg(F.sum("n").alias("n"))
        groups = cut(_groups(counts))
        scanned = cut(_scanned(pages))
        self.headers = cut(_header_lines(spark, cut(_edges(scanned))))
        drop = self.headers.groupBy("page_id").agg(F.collect_list("line_no").alias("drop"))
        self.scanned = cut(scanned.join(drop, "page_id", "left").select("page_id", "page_number", "text", "drop"))
        self.marks = cut(_marks(self.scanned))
        trained = _train_editor(spark, groups, raw)
        weights = spark.sparkContext.broadcast(trained)

        @F.pandas_udf(_EDITS)
        def edits(word: pd.Series, group: pd.Series, marks: pd.Series) -> pd.Series:
            p = Perceptron(weights.value["edit"])
            found = (edit(p, w, [] if g is None else [(x["n"], x["key"]) for x in g], m) for w, g, m in zip(word, group, marks))
            return pd.Series([[{"at": a, "read": r, "printed": q} for a, r, q in es] for es in found], dtype=object)

        broken = self.marks.where("kind = 'broken'")
        joined = F.concat("head", "rest").alias("word")
        words = raw.select("word").union(broken.select(joined)).union(broken.where(F.col("mark").isin("-", "‐", "‑")).select(F.concat_ws("-", "head", "rest")))
        open_ = (F.size("group") > 1) | F.col("marks") & (F.size("group") > 0) | ~F.col("marks") & F.col("word").rlike(r"[|!@+$ſ\d]")  # others have no repair
        judged = cut(_evidence(words, groups).where(open_).withColumn("edits", edits("word", "group", "marks")).where(F.size("edits") > 0).groupBy("word").agg(F.max_by("edits", "marks").alias("edits")))
        self.edits = _words_of(spark, self.scanned, judged).join(judged, "word")

        n_of = lambda c: counts.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"))
        broken = broken.withColumn("joined", _key_udf(joined)).withColumn("hyphened", _key_udf(F.concat_ws("-", "head", "rest")))
        broken = broken.join(n_of("joined"), "joined", "left").join(n_of("hyphened"), "hyphened", "left")

        @F.pandas_udf("boolean")
        def join(left: pd.Series, mark: pd.Series, right: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            p = Perceptron(weights.value["join"])
            return pd.Series([p.best(join_features(x, m, y, u, v), ("keep", "join")) == "join" for x, m, y, u, v in zip(left, mark, right, a, b)], dtype=bool)

        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        self.joins = broken.where(join("head", "mark", "rest", zero("n_joined"), zero("n_hyphened"))).select("page_id", "line_no").distinct()


@F.pandas_udf(T.StringType())
def _key_udf(words: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else _key(w) for w in words], dtype=object)


def noisy_lines(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind), one row per kind of noise in a line."""
    f = Findings(spark, pages)
    header = f.headers.select("page_id", "line_no", F.lit("header").alias("kind"))
    marks = f.marks.where("kind <> 'broken'").select("page_id", "line_no", F.when(F.col("kind") == "stray", "misread").otherwise(F.col("kind")).alias("kind"))
    where = F.explode("edits").alias("e")
    wrong = f.edits.select("page_id", "line_no", "next_no", "split", where).select("page_id", F.when(F.col("split").isNotNull() & (F.col("e.at") >= F.col("split")), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"))
    hyphen = f.joins.select("page_id", "line_no", F.lit("hyphen").alias("kind"))
    return header.unionByName(marks).unionByName(wrong).unionByName(hyphen).distinct()


def repair_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, repaired): running paragraphs, without furniture and stray marks, with
    words joined and characters put right. Pages that are not scanned keep their text."""
    f = Findings(spark, pages)
    noisy = f.headers.select("page_id", "line_no").union(f.marks.where("kind <> 'broken'").select("page_id", "line_no")).distinct()
    drop = noisy.groupBy("page_id").agg(F.collect_list("line_no").alias("drop"))
    join = f.joins.groupBy("page_id").agg(F.collect_list("line_no").alias("join"))
    edits = f.edits.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "next_no", "word", "split", "edits")).alias("fix"))
    scanned = f.scanned.select("page_id").withColumn("scanned", F.lit(True))
    one = pages.select("page_id", "text").dropDuplicates(["page_id"])
    for t in (scanned, drop, join, edits):
        one = one.join(t, "page_id", "left")

    @F.pandas_udf("string")
    def mend(text: pd.Series, scanned: pd.Series, drop: pd.Series, join: pd.Series, fix: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is not True and not (s == True) else mend_page(t, d, j, x) for t, s, d, j, x in zip(text, scanned, drop, join, fix)], dtype=object)  # noqa: E712

    return one.select("page_id", mend("text", "scanned", "drop", "join", "fix").alias("repaired"))


def mend_page(text: str, drop, join, fix) -> str:
    as_set = lambda x: set() if x is None else {int(i) for i in x}
    drop, join = as_set(drop), as_set(join)
    lines: list = text.split("\n")
    for e in [] if fix is None else sorted(fix, key=lambda e: (e["line_no"], e["word"])):
        no, w, k = e["line_no"], e["word"], e["split"]
        k = None if k is None or k != k else int(k)
        for at, read, printed in sorted(((x["at"], x["read"], x["printed"]) for x in e["edits"]), reverse=True):
            first = k is None or at < k
            part, row, place = (w if k is None else w[:k], no, at) if first else (w[k:], int(e["next_no"]), at - k)
            base = lines[row].find(part) if k is None or not first else lines[row].rfind(part)
            if base >= 0 and lines[row].startswith(read, base + place):
                lines[row] = lines[row][: base + place] + printed + lines[row][base + place + len(read) :]
    out: list[str] = []
    glue = False
    for i, line in enumerate(lines):
        if i in drop:
            continue
        s = line.strip()
        if not s:
            if not glue and out and out[-1] and ends_unit(out[-1]):
                out.append("")
            continue
        if glue:
            out[-1] = out[-1][:-1] + s
        elif out and out[-1] and not _HEAD.match(out[-1]) and not _HEAD.match(s):
            out[-1] += " " + s
        else:
            out.append(s)
        glue = i in join and out[-1][-1] in HYPHENS
    return re.sub(r"\n{2,}", "\n\n", "\n\n".join(x for x in out if x))
