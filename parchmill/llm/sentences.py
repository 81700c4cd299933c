"""Problem 5: sentence units in many languages, by a linear-chain tagger.

Every character is tagged as inside or as the last of a unit. Only characters before a
terminator's gap, a line end or a space between letters of a script without terminators can
be last; in a line of Chinese, Japanese or Thai that has none of these, every character can.
Viterbi decoding chooses among these under the chain's transition weights. The
weights come from an averaged structured perceptron, trained on documents put together from
single sentences (the labelled samples and the seeds below), with abbreviations, quotations,
headings and table rows, and on the sentences of these three languages run together with
their punctuation and blanks stripped.

Defined results: null and blank texts have no units; a text without any terminator is one
unit; repeated rows give the same units; other columns pass through.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Abbreviations that a word or number must follow.
BEFORE = """
mr mrs ms dr prof st rev hon gen col capt lt sgt messrs m/s no nos sec art vol fig figs eq p pp ch cl para ref approx ca vs v viz i.e e.g cf rs re sr smt shri
g.o g.o.ms rt jan feb mar apr jun jul aug sep sept oct nov dec mt ft inc.no w.e.f u/s govt dept al ed eds
nr hr fr abs bd bzw z z.b d.h u.a s.o vgl str tel mio mrd evtl ggf inkl
m mme mlle mm l’art art.no av bd.no env
sra srta dra d dña núm pág ud uds
ст г-н г-жа ул им т т.е тыс млн млрд руб.no п рис стр проф д
डॉ रु सं क्र श्री श्रीमती पृ प्रा कु
திரு ரூ எண் திருமதி பேரா
co
""".split()
#: Abbreviations that may also end a sentence.
EITHER = "etc ltd jr inc co a.m p.m km cm mm kg bros corp usw etc.a руб коп г гг p.a u.s b.c a.d esq ave blvd".split()
#: Sentences of the maintainers' own, to train on; units of a document are
#: parted by " ¶ " and a line end within the document is written as it is.
SEEDS = """
Mr. A. B. Carter met Dr. Lee at 5 p.m. on Monday. ¶ They spoke for an hour.
The firm of Hill & Co. Ltd. paid Rs. 4,500 to M/s. Brown Bros. of Leeds. ¶ See Sec. 4(2) and Art. 9, Vol. 3, p. 17, for terms.
We bought pens, paper, ink, etc. ¶ Then we left. ¶ It rained (cf. fig. 7) all day.
The parcel (viz. two books, a map, etc.) was sent by Messrs. Gray. ¶ E-mail followed.
Ms. King, i.e. the new head, starts w.e.f. 01.02.2020. ¶ e-tickets are valid too.
Approx. 12.50 km. of road is closed. ¶ Govt. of X vs. Y was heard on 3.4.1999. ¶ Was it fair?
“Who did this?” asked the teacher. ¶ Nobody spoke.
“Is it late? Go home at once,” said the guard. ¶ He shut the door!
She replied: “We have none left.” ¶ The shop closed.
The sign reads “open ... to all” on its front. ¶ (Nobody was there.) ¶ How odd!!
How odd!! ¶ e-filing began on 2.3.2004. ¶ tenants who paid may go.
Do not wait. ¶ 14 boats left at 6 a.m. and returned. ¶ Under Rule 4.2, members may vote.
It was paid in full.¶The rest is due. ¶ With reference to G.O. Ms. No. 44, the clerk left.
See No. 7, St. Mary Road (see fig. 2). ¶ L. M. Stone Jr. of York came; he sat down.
Section 4.1 General rules ⏎ ¶ The rules apply to all. ¶ Members may vote.
12. Minor repairs ⏎ ¶ If the roof leaks, call us.
(3) Fees ⏎ ¶ 20 rupees are due.
CHAPTER II THE BOARD ⏎ ¶ “Why?” asked the chair, and all fell silent.
G.O. Ms. 12 Revised list ⏎ ¶ e-filing began on 2.3.2004.
SCHEDULE IV Old list ⏎ ¶ 1 | Works | new road | 42 ⏎ ¶ 2 | Parks | old wall | 77 ⏎ ¶ 3 | Health | clinic | 9
The list is below. ⏎⏎ ¶ No. | Item | Sum ⏎ ¶ 14 | desks | 300 ⏎⏎ ¶ Payment is due.
AB-1234/CD-9876/EF-5555 ⏎⏎ ¶ The code is above.
The code is below. ⏎⏎ ¶ QX93-ALPHA-77120 ⏎⏎ ¶ Copies go to all.
A hall was built. ⏎ ¶ Rent is Rs. 5/- a day. ⏎⏎ ¶ Approx. ten came.
It rose by 5. ¶ The rate fell on 4.5.1990. ¶ Dr. Low saw it.
Die Leute zahlten z. B. 40 Euro. ¶ Dr. Kern fragte: „Wer kam?“ ¶ Gemäß § 3 Abs. 4 ging er.
Ca. 5 Prozent kamen, d. h. wenige. ¶ Am 3. Mai ging Herr Nr. 7. ¶ Hat er, u. a. wegen Eis, gewartet?
Er ging am 12. März 1990 heim. ¶ Bis zum 1. Juni war Ruhe, usw. ¶ Dann kam Regen.
M. Roux et Mme P. Blanc sont venus. ¶ Selon l’art. 5, le prix monte. ¶ « Il faut partir », dit-il à M. Petit.
Est-ce que tu viens ? ¶ À Lyon, il pleut. ¶ « Partez ! » ¶ Il sortit.
El Sr. Gil y la Dra. Paz hablaron. ¶ ¿Por qué vino? ¶ ¡Que nadie salga! ¶ Según el art. 4, vale.
«No hay pan», dijo el Sr. Gil. ¶ Uds. no vinieron. ¶ La Sra. Ruiz pagó 5 pesos.
Г-н A. Смит пришёл. ¶ Согласно ст. 5, это стоит 4.50 тыс. руб. до лета. ¶ Почему?
«Верните книгу», — сказал он. ¶ 5.6.1990 г. директор закрыл дом, т. е. ушёл. ¶ Это № 7.
Цена 40 руб. ¶ Потом он ушёл в 1990 г. ¶ Дом пуст.
डॉ. राम ने कहा, “यह घर है।” ¶ रु. 40 की राशि तय हुई। ¶ क्या वह आएगा?
आदेश सं. 5 के अनुसार काम हुआ॥ ¶ K. L. Rao आए। ¶ 40 में से 5 लोग गए।
आदेश क्र. 7 नुसार काम झाले. ¶ डॉ. जोशी आले आहे. ¶ रु. 5 दिले होते.
திரு. குமார் வந்தார். ¶ ரூ. 40 கொடுத்தார். ¶ அரசாணை எண். 5 படி நடந்தது. ¶ வருவாரா?
“இது பழைய வீடு,” என்று அவர் கூறினார். ¶ 5 பேர் வந்தனர்.
“这本书有误。”他对老师说。¶为什么没有来？¶请回来！¶价格为4.50元。
他来了；她走了。¶“好。”老师说。¶今天下雨。
「本はまだですか。」と彼は尋ねました。¶第5条により、値段は4.50円です。¶出してください！
なぜ来ないのですか？¶雨です。¶彼は「はい」と言いました。
Kya tum aaoge? ¶ Munshi ne likh kar diya. ¶ Agar paisa ho to 5 din mein aana.
ตามข้อ 5 ผู้เช่าต้องจ่ายเงินก่อนฤดูฝน ¶ ครูส่งคืนหนังสือจำนวน 12 เล่ม ¶ เหตุใดเขาจึงไม่มา
เขามีบ้าน 2 หลัง ¶ ราคา 4.50 บาท ¶ เจ้าหน้าที่แจ้งว่าบ้านมีมูลค่า 9.75 บาท ¶ คนงานกลับบ้านแล้ว
""".strip().splitlines()

TERMINATORS, CLOSERS = ".!?…।॥。！？｡", "\"'”’»」』)]）】"
_CAND = re.compile(rf"(?P<t>[{TERMINATORS}]+)(?P<c>(?:[   ]?»|[{re.escape(CLOSERS)}“])*)(?P<g>\s*)|(?P<n>[^\S\n]*\n\s*)|(?<=[฀-๿\d.])(?P<s>[  ]+)(?=[฀-๿]|\d|[A-Za-z])")
#: The same for texts without Thai letters; it starts with one class of characters, so that a
#: search passes over all others at once. Blanks before a line end are not in the match.
_PLAIN = re.compile(rf"[{TERMINATORS}\n](?:(?<=\n)\s*|[{TERMINATORS}]*(?P<c>(?:[\u0020\u00a0\u202f]?»|[{re.escape(CLOSERS)}“])*)(?P<g>\s*))")
_ASCII = re.compile(r"[.!?\n](?:(?<=\n)\s*|[.!?]*(?P<c>[\"')\]]*)(?P<g>\s*))")
_PREV = re.compile(r"[^\s(“„«「\[\"‘]*$")
_HEAD = re.compile(r"\s*(?:[A-Z][A-Z]{3,}|Section|Chapter|Part|Article|Clause|Rule|Schedule|Annexure|Appendix|Form|GO|Notification|Circular)\b|\s*G\.O\.|\s*(?:\d{1,3}[.)]|\((?:\d{1,3}|[ivxlc]{1,5}|[a-z])\))\s")
_BEFORE, _EITHER = frozenset(BEFORE), frozenset(EITHER)


@functools.lru_cache(maxsize=65_536)
def _class(c: str) -> str:
    if not c:
        return "end"
    o = ord(c)
    if c.isdigit():
        return "digit"
    if o < 0x250 or 0x370 <= o < 0x530:
        return "lower" if c.islower() else "upper" if c.isupper() else "open" if c in "“„«¿¡(['\"‘" else "mark"
    if 0x0E00 <= o < 0x0E80:
        return "thai"
    if 0x0900 <= o < 0x0E00:
        return "indic"
    if 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o:
        return "cjk"
    return "open" if c in "“„«「『（" else "mark" if not c.isalpha() else "other"


_QUOTE = re.compile("[“”„«»「」]|\n\n")
_QUOTES = re.compile("[“”„«»「」]")


class _Depth:
    """Open quotations at a place of a text; a blank line closes all."""

    def __init__(self, text: str):
        # Without a quotation mark nothing is ever open.
        self.marks = [] if text.isascii() or not _QUOTES.search(text) else [(m.start(), m.group()) for m in _QUOTE.finditer(text)]
        self.next = self.depth = self.low = 0

    def at(self, place: int) -> int:
        marks = self.marks
        while self.next < len(marks) and marks[self.next][0] < place:
            c = marks[self.next][1]
            self.next += 1
            if c == "\n\n":
                self.depth = self.low = 0
            elif c == "„":
                self.depth, self.low = self.depth + 1, self.low + 1
            elif c == "“" and self.low:
                self.depth, self.low = max(0, self.depth - 1), self.low - 1
            elif c in "“«「":
                self.depth += 1
            else:
                self.depth = max(0, self.depth - 1)
        return self.depth


#: Letters in a row, of a script without spaces between words, from which a line without any
#: mark may hold several sentences.
RUN = 12
_RUN = re.compile(rf"[぀-ヿ㐀-鿿豈-﫿]{{{RUN},}}|[฀-๿]{{{RUN},}}")
#: One class that holds all of the above, for a quick no.
_FAR = re.compile(r"[\u0e00-\u0e7f\u3040-\ufaff]")
_MARKED = re.compile(rf"[{TERMINATORS}|  ]")


def unmarked(text: str) -> list[tuple[int, tuple]]:
    """(end of unit, key) of every character within lines of such a script without marks."""
    out, seen, marked = [], -1, False
    for m in _RUN.finditer(text):
        a = text.rfind("\n", 0, m.start()) + 1
        if a != seen:
            b = text.find("\n", m.end())
            line = text[a : b if b >= 0 else len(text)].strip()
            seen, marked = a, _MARKED.search(line) is not None or _HEAD.match(line) is not None
        if not marked:
            t = m.group()
            out += [(m.start() + k, ("u", t[k - 3 : k] if k > 2 else t[:k], t[k : k + 3])) for k in range(2, len(t) - 1)]
    return out


@functools.lru_cache(maxsize=65_536)
def shape(token: str) -> tuple[str, int]:
    """Kind of the word before a full stop, and its length in small letters."""
    last = _PREV.search(token).group()
    w = last.lower()
    n = len(w)
    if w in _BEFORE:
        return "before", n
    if w in _EITHER:
        return "either", n
    if n == 1 and w.isalpha():
        return "initial" if last.isupper() else "one", n
    if w[:1].isdigit() and w.translate(_NUMBER).isdigit():
        return "num", n
    return "dotted" if "." in w else "word", n


def candidates(text: str) -> list[tuple[int, tuple]]:
    """(end of unit, key) of every character that can be last; features() expands keys."""
    plain = text.isascii()
    out = unmarked(text) if not plain and _FAR.search(text) else []
    several = bool(out)
    depth = _Depth(text)
    size, line_start = len(text), 0
    thai = not plain and _THAI.search(text) is not None
    for m in (_ASCII if plain else _CAND if thai else _PLAIN).finditer(text):
        a, stop = m.span()
        kind_of = m.lastgroup
        if kind_of is None:
            kind_of = "n"
            while a and text[a - 1].isspace():
                a -= 1
        if stop >= size and kind_of in ("n", "s"):
            continue
        nxt = text[stop : stop + 1]
        if kind_of == "g":
            c, g = m.group("c", "g")
            t = text[a : m.start("c")]
            low = depth.marks and depth.at(a) and depth.low
            if "“" in c and not low:  # an opening mark
                c, g, nxt = c[: c.index("“")], "", "“"
            end = a + len(t) + len(c)
            last = t[-1]
            kind = "." if last == "." else "cjk" if last in "。！？｡" else "danda" if last in "।॥" else "…" if last == "…" else "!"
            nc = _class(nxt)
            if not g and kind != "cjk" and nc in ("lower", "digit", "mark"):
                continue
            if t.startswith("..."):
                kind = "…"
            gap = "none" if not g else "blank" if g.count("\n") > 1 else "line" if "\n" in g else "space"
            sh, month = "-", ""
            if kind == ".":
                near = text[a - 30 if a > 30 else 0 : a]
                broken = near[-1:] == "\n"  # the word may end the line before
                if broken:
                    near = near[:-1]
                sh, n = shape(near.rsplit(None, 1)[-1]) if near and not near[-1].isspace() else ("word", 0)
                if broken and sh == "initial":
                    sh = "one"
                if sh == "num":
                    line_start = text.rfind("\n", line_start, a) + 1 or line_start
                    sh = "list" if not text[line_start : a - n].strip() else "ordinal" if n <= 2 else "num"
                    month = "month" if sh == "ordinal" and nc == "upper" and _MONTH.match(text, stop) else ""
            q = "in" if depth.marks and not c and depth.at(a) else "closed" if c else "out"
            out.append((end, ("k", kind, sh, gap, nc, month, q, c[-1:])))
        elif kind_of == "n":
            line_start = text.rfind("\n", line_start, a) + 1 or line_start
            line = text[line_start:a]
            gap = "blank" if text.count("\n", a, stop) > 1 else "line"
            head = "head" if _HEAD.match(line) else "bar" if "|" in line else "code" if " " not in line.strip() else "long" if len(line) > 38 else "short"
            out.append((a, ("n", gap, head, _class(nxt), _class(text[a - 1 : a]), "in" if depth.marks and depth.at(a) else "out")))
        else:
            pc, nc = _class(text[a - 1 : a]), _class(nxt)
            if "thai" not in (pc, nc) and not _THAI.search(text, max(0, a - 12), stop + 12):
                continue
            out.append((a, ("t", pc, nc, text[max(0, a - 3) : a], text[stop : stop + 3])))
    return sorted(out) if several else out


def features(key: tuple) -> tuple:
    if key[0] == "k":
        _, kind, sh, gap, nc, month, q, c = key
        return (("k", kind, sh, gap, nc, month), ("q", kind, q, nc, gap), ("w", kind, sh, nc), ("g", gap, nc, q), ("c", c, nc, gap), ("s", kind, sh))
    if key[0] == "n":
        _, gap, head, nc, pc, q = key
        return (("n", gap, head, nc), ("p", gap, pc, nc), ("h", gap, head, pc), ("l", gap, head), ("m", gap, q))
    if key[0] == "u":
        _, left, right = key
        return (("u",), ("u1", left[-1:]), ("u2", left[-2:]), ("u3", left), ("v1", right[:1]), ("v2", right[:2]), ("v3", right), ("uv", left[-1:], right[:1]))
    _, pc, nc, left, right = key
    return (("t", pc, nc), ("tl", left), ("tr", right, pc), ("tb", pc, right[:2]), ("te", left[-2:], nc))


_NUMBER = str.maketrans("", "", ",./-")
_MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Absatz|Kapitel|Jahrhundert)\b")
_THAI = re.compile(r"[฀-๿]")


class Tagger:
    def __init__(self, weights: dict | None = None, chain: np.ndarray | None = None):
        self.w = {} if weights is None else weights
        self.chain = np.zeros((2, 2)) if chain is None else chain
        self.cache: dict = {}

    def emission(self, key: tuple) -> float:
        s = self.cache.get(key)
        if s is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            w = self.w
            self.cache[key] = s = sum(w.get(x, 0.0) for x in features(key))
        return s

    def decode(self, emissions: list[float]) -> list[int]:
        """Viterbi over inside (0) and last (1); the emission of inside is zero."""
        if not emissions:
            return []
        (ii, ib), (bi, bb) = self.chain.tolist()
        inside, last, to_inside, to_last = 0.0, emissions[0], [0], [0]
        for e in emissions[1:]:
            p, q, r, t = inside + ii, inside + ib, last + bi, last + bb
            to_inside.append(1 if r > p else 0)
            to_last.append(1 if t > q else 0)
            inside, last = (r if r > p else p), (t if t > q else q) + e
        tags = [0] * len(emissions)
        tag = 1 if last > inside else 0
        for k in range(len(emissions) - 1, -1, -1):
            tags[k] = tag
            tag = to_last[k] if tag else to_inside[k]
        return tags

    def ends(self, text: str | None) -> list[int]:
        if not text or not text.strip():
            return []
        cand = candidates(text)
        known, emission = self.cache.get, self.emission
        score = [emission(f) if (s := known(f)) is None else s for _, f in cand]
        out = [e for (e, _), t in zip(cand, self.decode(score)) if t]
        final = len(text.rstrip())
        first = len(text) - len(text.lstrip())
        out = [e for e in out if first < e < final]
        return out + [final]


def seed_documents() -> list[tuple[str, set[int]]]:
    return [_put_together(s.replace("⏎⏎ ¶ ", "¶\n\n").replace("⏎ ¶ ", "¶\n").split("¶")) for s in SEEDS]


def _put_together(units: list[str]) -> tuple[str, set[int]]:
    text, ends = "", set()
    for u in units:
        text += u
        ends.add(len(text.rstrip()))
    return text, ends


def sample_documents(samples: list[tuple[str, str]], n: int = 700, seed: int = 5) -> list[tuple[str, set[int]]]:
    """Documents of known units from labelled single sentences."""
    rng = random.Random(seed)
    by: dict[str, list[str]] = {}
    for lang, s in samples:
        if s and s.strip():
            by.setdefault(lang, []).append(s.strip())
    heads = ["Section 4.1 Minor works in Ashby", "CHAPTER IX OLD WALLS IN ASHBY", "(7) Late fees in Ashby", "31. New roof in Ashby", "Rule 12 Water in Ashby", "SCHEDULE II Lamps in Ashby"]
    out = []
    for _ in range(n if by else 0):
        text, ends = "", set()
        if rng.random() < 0.35:
            text = rng.choice(heads)
            ends.add(len(text))
            text += "\n"
        lang = rng.choice(sorted(by))
        for _ in range(rng.randint(2, 7)):
            s = rng.choice(by[lang if rng.random() < 0.85 else rng.choice(sorted(by))])
            text += s
            ends.add(len(text))
            text += "" if s[-1] in "。！？" and rng.random() < 0.7 else rng.choice([" ", " ", " ", "\n\n", "\n", "  "])
        out.append((text, ends))
    return out


def stripped_documents(sentences: list[str], n: int = 120, seed: int = 17) -> list[tuple[str, set[int]]]:
    """Sentences of one script without spaces, run together without a mark between them."""
    rng, out = random.Random(seed), []
    bare = [t for s in sentences if len(t := "".join(c for c in s if c.isalpha() or c in _THAI_MARKS)) >= 4]
    for _ in range(n if bare else 0):
        text, ends = "", set()
        for _ in range(rng.randint(1, 5)):
            text += rng.choice(bare)
            ends.add(len(text))
        out.append((text, ends))
    return out


_THAI_MARKS = frozenset(map(chr, (0x0E31, *range(0x0E34, 0x0E3B), *range(0x0E47, 0x0E4F))))


def training_documents(samples: list[tuple[str, str]]) -> list[tuple[str, set[int]]]:
    """The seeds as written, the seeds' and samples' sentences in random order, and those of
    scripts without spaces stripped of all marks."""
    loose = [("seed", u.strip()) for line in SEEDS for u in line.replace("⏎", "¶").split("¶") if u.strip()[-1:] and u.strip()[-1] in TERMINATORS + CLOSERS and not _THAI.search(u)]
    far: dict[str, list[str]] = {}
    for lang, t in samples:
        if t and _RUN.search("".join(c for c in t if c.isalpha() or c in _THAI_MARKS)):
            far.setdefault(lang, []).append(t)
    bare = [d for k in sorted(far) for d in stripped_documents(far[k])]
    return seed_documents() * 6 + sample_documents(list(samples)) + sample_documents(loose, 700, 9) + sample_documents([("all", t) for _, t in (*samples, *loose) if t and not _THAI.search(t)], 500, 13) + bare


def train(documents: list[tuple[str, set[int]]], epochs: int = 14) -> Tagger:
    """Averaged structured perceptron."""
    w: dict = {}
    total: dict = {}
    chain, chain_total, step = np.zeros((2, 2)), np.zeros((2, 2)), 1
    tagger = Tagger(w, chain)
    data = []
    for text, ends in documents:
        cand = candidates(text)
        final = len(text.rstrip())
        if cand:
            data.append(([f for _, f in cand], [int(e in ends or e == final) for e, _ in cand]))
    rng = random.Random(11)
    for _ in range(epochs):
        rng.shuffle(data)
        for fs, gold in data:
            tagger.cache.clear()
            got = tagger.decode([tagger.emission(f) for f in fs])
            if got != gold:
                for f, g, y in zip(fs, got, gold):
                    if g != y:
                        for x in features(f):
                            w[x] = w.get(x, 0.0) + (y - g)
                            total[x] = total.get(x, 0.0) + step * (y - g)
                for seq, sign in ((gold, 1.0), (got, -1.0)):
                    for a, b in zip(seq, seq[1:]):
                        chain[a, b] += 0.2 * sign
                        chain_total[a, b] += 0.2 * sign * step
            step += 1
    return Tagger({k: v - total[k] / step for k, v in w.items()}, chain - chain_total / step)


def fit(samples: DataFrame | None) -> Tagger:
    """From the seeds and the labelled samples, a table of fixed size."""
    return train(training_documents([] if samples is None else labelled(samples)))


#: Labelled samples that are learnt from; of a larger table those with the lowest hashes.
SAMPLES = 20_000


def labelled(samples: DataFrame) -> list[tuple[str, str]]:
    rows = samples.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("lang", "text").alias("h")).orderBy("h").limit(SAMPLES)
    return sorted((r["lang"], r["text"]) for r in rows.collect())


@functools.lru_cache(maxsize=2)
def _tagger(items: tuple, chain: tuple) -> Tagger:
    return Tagger(dict(items), np.array(chain))


def pack(t: Tagger) -> tuple[tuple, tuple]:
    return tuple(sorted(t.w.items(), key=repr)), tuple(map(tuple, t.chain.tolist()))


def once(f):
    """The function for the planner to leave where it is: an explode or a filter of its result
    would otherwise be a second run of it, over all rows, below the first."""
    return f.asNondeterministic()


def unit_ends(spark: SparkSession, df: DataFrame, tagger: Tagger, text: str = "text", out: str = "ends") -> DataFrame:
    shared = spark.sparkContext.broadcast(pack(tagger))

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        t = _tagger(*shared.value)
        return pd.Series([t.ends(x) for x in texts], dtype=object)

    return df.withColumn(out, once(ends)(F.col(text)))
