"""Problem 9: abusive, hateful or sexual content, by weak supervision.

Posts are cut into units (sentences; long ones into overlapping windows of words), and
spelling tricks are undone: look-alike letters, digits for letters, spaced, stretched and
starred words. Every distinct word is looked up once in an automaton of all lexicons; only
units with a hit are put to the voters, each a lexicon or a general pattern. The raters of
labelled posts are voters too, on whole posts. A generative label model estimates the
raters' accuracy from posts that two of them judged, each voter's from triples of voters
that fire together (the agreement rates of all units, a matrix of fixed size, summed before
it is collected) and from the labelled posts it fires on, and the correlation left between
pairs; it gives every unit and every labelled post a posterior. A linear classifier on word
n-grams learns from a bounded sample of posteriors (``TRAIN_EACH`` units of either side and
the units of ``LABELLED`` posts, both by lowest hash) and scores every unit; a post's score is
its highest unit's. Of an abusive post, the unit that scores highest so far is learnt.

Defined results: null, empty and blank texts score 0; repeated rows score alike; without
labels the voters decide alone; a null source is a source of its own; other columns pass
through.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .lookalike import INVISIBLE, Rewriter, representatives

TRAIN_EACH, LABELLED = 6000, 20_000
BITS, ROUNDS = 18, 3
#: Log odds from which a labelled post is taken for abusive or harmless.
CLEAR = 1.0
WINDOW, STEP = 26, 10

#: Words that insult a person, by language.
INSULTS = """
idiot moron imbecile cretin halfwit dimwit scumbag dirtbag bastard jackass jerk loser maggot pig swine twat wanker arsehole asshole
bitch slut whore cunt dickhead douche douchebag prick dumbass retard retarded fool clown coward lard garbage cow pathetic worthless scum trash filth
lowlife degenerate creep pervert weasel rat rats dog dogs donkey dunce buffoon simpleton nitwit numbskull blockhead
trottel depp arschloch hurensohn wichser fresse verpiss schlampe drecksau schwein missgeburt spast penner vollidiot dummkopf erbärmlicher dummer
connard connasse crétin gueule salope pute enculé débile abruti ordure imbécile bouffon salaud pourriture minable
idiota inútil asco imbécil puta cabrón gilipollas mierda estúpido pendejo gusano basura maldito cállate
заткнись урод идиот мразь тварь сука дебил ублюдок придурок козёл гнида дурак кретин скотина тупой
बेवकूफ निकम्मे निकम्मा कमीने कमीना कुत्ते कुत्ता हरामी हरामखोर साला गधे गधा मूर्ख नालायक दफ़ा दफा मूर्खा नालायका हलकट गाढवा
அயோக்கியன் முட்டாள் நாயே பொறுக்கி செத்துப் கழுதை தறுதலை மடையன் அயோக்கியனே முட்டாளே
bewakoof bevkoof kamine kamina kutte kutta harami haramkhor saala gadhe nikamma nikamme nalayak chutiya dafa
白痴 傻逼 混蛋 滚蛋 去死 垃圾 废物 蠢货 馬鹿 バカ 死ね クズ 間抜け 消えろ くたばれ โง่ ไอ้ เลว ควาย สารเลว ไปตาย
""".split()
#: Words that deny people their humanity, or call for their removal.
DEHUMAN = "vermin parasites parasite subhuman filth scum animals rats cockroaches insects disease plague infestation trash pests garbage savages ungeziefer abschaum parasiten vermine racaille alimañas escoria паразиты отбросы нелюди".split()
#: Sexual words.
SEXUAL = """
nude nudes naked tits tit boobs breasts breast nipples nipple cock dick pussy cunt cum horny sex sexy arse ass fuck fucking
undress blowjob porn porno orgasm erotic panties penis vagina masturbate striptease
nackt titten ficken muschi schwanz geil nue seins baiser bite chatte desnuda tetas follar polla coño голая сиськи трахать член नंगी चूची निर्वाण நிர்வாண 裸 性交 セックス 裸体 เปลือย
""".split()
#: Words for the person spoken to, by language.
YOU = "you your yours yourself ya u du dich dir dein deine tu toi te ton ta eres tú ti tus ты тебя тебе твой तुम तू तेरा तेरी तुम्हें तुझे तुला நீ உன் உன்னை உன்னைப் tum tu tera tumhe 你 お前 おまえ てめえ มึง แก".split()
#: Stems of violence against a person.
VIOLENCE = "kill hurt beat stab shoot burn drown hang die dead dies cancer smash strangle suffer bleed kys töte verrecke stirb crève crever tuer muere matar сдохни убью मर मार சாக சாவு".split()
#: Words that only bring a unit before the patterns.
CUES = "breed breathe exist vote deport deported rid belong belongs back threatens threaten gueule maul klappe fresse foutre coller hijo vete odian ненавидят hate".split()
#: Phrases, as patterns over the repaired text. INSULT, DEHUMAN and SEXUAL
#: stand for any word of theirs.
PATTERNS = {
    "you_are_insult": r"\b(?:you|u|ya) (?:(?:are|re|r) )?(?:\w+ ){0,3}?INSULT\b|\bINSULT (?:like )?(?:you|u)\b",
    "your_insult": r"\b(?:your|ur|yo) (?:\w+ ){0,2}?INSULT\b|\bwhat an? (?:\w+ )?INSULT\b|\bonly an? (?:\w+ )?INSULT\b",
    "kill_yourself": r"\b(?:kill|hang|drown|shoot|hurt|cut) (?:yourself|urself|yo self)\b|\bgo (?:and )?die\b|\bkys\b",
    "wish_harm": r"\b(?:hope|wish) (?:you|u|they|he|she) (?:\w+ ){0,3}?(?:die|dies|cancer|suffer|burn|bleed|drown)\b",
    "threat": r"\bi (?:will|ll|am going to|m going to|ma|d) (?:\w+ ){0,4}?(?:kill|beat|stab|smash|burn|hurt|strangle|shoot)\b.{0,30}?\b(?:you|your|u|ur)\b",
    "not_exist": r"\b(?:people|ones|types|creatures|they|you) (?:\w+ ){0,4}?(?:not|t|never) (?:\w+ ){0,3}?(?:breed|exist|vote|breathe)\b",
    "group_out": r"\b(?:get|getting) rid of (?:the|all|these|those|them)\b|\b(?:belongs?) in (?:a|the) (?:cage|kitchen|zoo|gutter|camps?)\b|\bgo back to (?:where|your)\b|\bdeport(?:ed)? (?:them|all|every)\b",
    "group_all": r"\b(?:they|these|those|them|women|men|migrants|people|all) (?:\w+ ){0,3}?(?:are|re|be|is) (?:\w+ ){0,3}?DEHUMAN\b|\ball DEHUMAN\b|\bthese (?:\w+ )?DEHUMAN\b",
    "sexual_ask": r"\b(?:send|show|see|grab|touch|lick|suck|kiss|squeeze|want)\b.{0,25}?\b(?:your|ur|me|my|naked)\b.{0,25}?SEXUAL\b|\bSEXUAL\b.{0,30}?\b(?:tonight|dm me|in bed)\b",
    "foreign_hostile": r"\b(?:du|ihr) (?:bist |seid )?(?:\w+ ){0,3}?INSULT|\bhalts? (?:die|dein) (?:fresse|maul|klappe)|\bverpiss|\bferme[zs]? (?:ta|vos?|la) gueule|\btu (?:n )?(?:es )?(?:\w+ ){0,4}?INSULT|\bva te faire|\beres (?:un|una) (?:\w+ )?INSULT|\bvete a la|\bзаткнись|\bты (?:\w+ )*?INSULT|\bfick dich|\bhijo de",
    "foreign_script": r"(?:तुम|तू|तुला|उन्हें)\b.{0,25}?INSULT|INSULT.{0,20}?(?:செத்து|போ)|செத்துப் போ|\b(?:tum|tu|abe|oye|saale|saala) .{0,25}?INSULT|(?:你|お前|มึง|ไอ้).{0,8}?INSULT",
}
#: Talk that uses the same words without harm, as patterns.
BENIGN = {
    "self": r"\bi (?:felt|feel|was|am|m|look|looked)(?: like)?(?: such)? (?:an?|so) (?:\w+ )?INSULT\b|\bmade me (?:feel|look)\b|\b(?:call|called) myself\b",
    "thing": r"\bINSULT (?:design|thing|idea|machine|update|form|website|software|car|phone|weather|rule|question)\b|\b(?:the|this|that|my|it) (?:\w+ ){0,3}?is (?:an? )?(?:stupid|INSULT)\b|\bkill(?:ing|ed)? (?:the|a) (?:process|lights?|engine|power|weeds?|job|time)\b",
    "talk": r"\bhate speech\b|\b(?:talk|article|lecture|report|policy|workshop|study|seminar|campaign) (?:on|about|against)\b|\bcalled (?:me|him|her|us) an?\b|\bcancer (?:research|screening|charity|ward)\b|\bsex (?:education|ratio)\b|\bbreast (?:cancer|feeding|screening|exam)\b|\bchicken breasts?\b|\bnaked eye\b",
}
_LEET = str.maketrans("013457$@!€", "oieastsaie")
_SENT = re.compile(r"[.!?।॥。！？][\"'”’»)\]]*\s+|[。！？]|\n+")
_WORDS = re.compile(r"[^\W_]+(?:[*̀-ͯऀ-෿ั-๎$@!€]+[^\W_]*)*|[$@][^\W_]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_SINGLES = re.compile(r" [^\W\d_] [^\W\d_] ")
_TAGS = re.compile(r"<[^<>\n]{0,200}>|\[/?\w+(?:=[^\]\n]{0,60})?\]")
_QUOTED = re.compile(r"\n[ \t]*(?:[>|]+[ \t]*)+")
_WRAP = re.compile(r"\n(?=[^\W\d_])(?!\n)")
_FAR = re.compile("[ऀ-￿]")

INSULT, DEHUMANISE, SEX, VIOLENT, ADDRESS, CUE, TRICK = (1 << k for k in range(7))


@functools.lru_cache(maxsize=1)
def _lexicon() -> tuple[dict[str, int], dict[int, list[str]], ahocorasick.Automaton]:
    """Word -> kinds, known words by length, and an automaton of the words of scripts that
    are written without spaces or with endings."""
    kinds: dict[str, int] = {}
    for bit, words in ((INSULT, INSULTS), (DEHUMANISE, DEHUMAN), (SEX, SEXUAL), (VIOLENT, VIOLENCE), (ADDRESS, YOU), (CUE, CUES)):
        for w in words:
            kinds[w] = kinds.get(w, 0) | bit
    by_len: dict[int, list[str]] = {}
    for w in sorted({*INSULTS, *DEHUMAN, *SEXUAL, "people", "women", "body", "kill", "yourself", "ugly", "hate"}):
        by_len.setdefault(len(w), []).append(w)
    far = ahocorasick.Automaton()
    for w, k in kinds.items():
        if _FAR.search(w) and len(w) > 1:
            far.add_word(w, k)
    far.make_automaton()
    return kinds, by_len, far


@functools.lru_cache(maxsize=1)
def _patterns() -> tuple[list[tuple[re.Pattern, int]], list[tuple[re.Pattern, int]]]:
    """Each pattern with the kind that it marks; words of the kind are read as one sign."""

    def build(p: str) -> tuple[re.Pattern, int]:
        kind = INSULT if "INSULT" in p else DEHUMANISE if "DEHUMAN" in p else SEX if "SEXUAL" in p else 0
        return re.compile(re.sub(r"(?:\\b)?(?:INSULT|DEHUMAN|SEXUAL)(?:\\b)?", "\x01", p)), kind

    return [build(p) for p in PATTERNS.values()], [build(p) for p in BENIGN.values()]


VOTERS = (*PATTERNS, *BENIGN, "insult_near_you", "insults_many", "dehuman_word", "sexual_many", "violence_near_you", "tricked_word", "plain")
HITS, _SCRIPT = len(PATTERNS), list(PATTERNS).index("foreign_script")


@functools.lru_cache(maxsize=1)
def _form() -> Rewriter:
    return Rewriter(representatives({c: 2 for c in map(chr, range(32, 127))}))


@functools.lru_cache(maxsize=100_000)
def repair_word(word: str) -> tuple[str, bool]:
    """The word in plain lower-case letters, and whether a spelling trick was undone.
    Digits at the end of a name are not letters, so only words with others inside change."""
    if word.isdigit():
        return "#", False
    if not word.isascii():
        plain = _form()(word)
        word = plain if plain.isascii() else word
    by_len = _lexicon()[1]
    w = word.casefold()
    if "*" in w:
        fits = [x for x in by_len.get(len(w), ()) if all(a in ("*", b) for a, b in zip(w, x))]
        return (fits[0], True) if fits and w.strip("*") else (w, False)
    tricked = False
    if re.search(r"[0-9$@!€]", w):
        core = w.rstrip("!")
        plain = core.translate(_LEET)
        forms = {plain, core.replace("1", "l").translate(_LEET)}
        known = next((x for x in sorted(forms) if x in by_len.get(len(x), ())), None)
        if known:
            w, tricked = known, True
        elif re.search(r"[^\W\d_].*[0-9$@€]+[^\W\d_]", core) and core.translate(_LEET).isalpha():
            w, tricked = plain, True
        else:
            w = re.sub(r"\d+", "#", core)
    if re.search(r"([^\W\d_])\1\1", w) and w.isascii():
        w, tricked = re.sub(r"(.)\1{2,}", r"\1", w), True
    return w, tricked


class Words(dict):
    """Token as written -> its place in ``word`` (repaired), ``code`` (its hash) and ``kind``."""

    MOST = 200_000

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.word: list[str] = []
        self.code, self.kind = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)

    def __missing__(self, token: str) -> int:
        word, tricked = repair_word(token)
        kinds, _, far = _lexicon()
        k = kinds.get(word, 0) | TRICK * tricked
        if _FAR.search(word):
            for _, hit in far.iter(word):
                k |= hit
        i = len(self.word)
        if i == len(self.code):
            self.code, self.kind = np.concatenate((self.code, np.zeros_like(self.code))), np.concatenate((self.kind, np.zeros_like(self.kind)))
        self.word.append(word)
        self.code[i], self.kind[i] = xxhash.xxh3_64_intdigest(word), k
        self[token] = i
        return i


def sentences_of(text: str | None) -> list[list[str]]:
    """The units of a post, as lists of tokens as written."""
    if not text or not text.strip():
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t or "[" in t:
        t = _TAGS.sub("\n", t)
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if ">" in t or "|" in t:
        t = _QUOTED.sub("\n", "\n" + t)
    if not t.isascii():
        t = INVISIBLE.sub("", t)
    if "\n" in t:
        t = _WRAP.sub(lambda m: " " if t[m.end() : m.end() + 1].islower() or t[m.start() - 1 : m.start()] not in ".!?।…:;*~_" else "\n", t)
    if _SINGLES.search(t):
        t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    out = []
    for s in _SENT.split(t):
        words = _WORDS.findall(s) if s else None
        if not words:
            continue
        if len(words) <= WINDOW:
            out.append(words)
        else:
            out += [words[k : k + WINDOW] for k in range(0, max(1, len(words) - WINDOW + STEP), STEP)]
    return out


class Batch:
    """The units of a batch of posts as arrays: hashes and kinds of all tokens, where each
    unit begins, and which post it is of."""

    def __init__(self, texts, words: Words):
        if len(words) > Words.MOST:
            words.forget()
        self.words, units, owner = words, [], []
        for i, t in enumerate(texts):
            us = sentences_of(t)
            units += us
            owner += [i] * len(us)
        self.owner = np.array(owner, np.int64)
        self.size = np.fromiter(map(len, units), np.int64, len(units))
        self.start = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        self.token = np.fromiter(map(words.__getitem__, chain.from_iterable(units)), np.int64, n)
        self.code, self.kinds = words.code[self.token], words.kind[self.token]
        self.kind = np.bitwise_or.reduceat(self.kinds, self.start) if n else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.size)

    def unit(self, i: int) -> tuple[list[str], list[int]]:
        a = slice(self.start[i], self.start[i] + self.size[i])
        return [self.words.word[t] for t in self.token[a]], self.kinds[a].tolist()

    def hashes(self) -> np.ndarray:
        """One hash a unit, by its words in order."""
        if not len(self.code):
            return np.zeros(0, np.int64)
        place = (np.arange(len(self.code)) - np.repeat(self.start, self.size)).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = _stir(self.code + place * np.uint64(0x9E3779B97F4A7C15))
            return np.add.reduceat(x, self.start).view(np.int64)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, slot) of every n-gram: words, pairs, triples, and pairs with a gap."""
        n = len(self.code)
        unit = np.repeat(np.arange(len(self)), self.size)
        c = self.code
        shift = np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            a, b, d = c * np.uint64(0xBF58476D1CE4E5B9), c * np.uint64(0x94D049BB133111EB), c * np.uint64(0xD6E8FEB86659FD93)
            two = np.flatnonzero(unit[:-1] == unit[1:]) if n > 1 else np.zeros(0, np.int64)
            three = np.flatnonzero(unit[:-2] == unit[2:]) if n > 2 else np.zeros(0, np.int64)
            parts = [_stir(c), _stir(a[two] + b[two + 1] + np.uint64(1)), _stir(a[three] + b[three + 1] + d[three + 2] + np.uint64(2)), _stir(a[three] + d[three + 2] + np.uint64(3))]
        return np.concatenate((unit, unit[two], unit[three], unit[three])), np.concatenate([p >> shift for p in parts]).astype(np.int64)


def _stir(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def units(text: str | None) -> list[tuple[list[str], int]]:
    """The units of a post: repaired words and the number of tricked ones."""
    b = Batch([text], Words())
    return [(w, sum(bool(k & TRICK) for k in ks)) for w, ks in map(b.unit, range(len(b)))]


def votes(words: list[str], kinds: list[int]) -> np.ndarray:
    """+1 abusive, -1 harmless, 0 abstains, in the order of VOTERS."""
    hit, benign = _patterns()
    line = {0: " ".join(words)}
    for bit in (INSULT, DEHUMANISE, SEX):
        line[bit] = " ".join("\x01" if k & bit else w for w, k in zip(words, kinds))
    v = [1.0 if p.search(line[k]) else 0.0 for p, k in hit]
    if any(k & INSULT and _FAR.search(w) for w, k in zip(words, kinds)):
        v[_SCRIPT] = 1.0  # a lexicon's word within a run of letters
    v += [-1.0 if p.search(line[k]) else 0.0 for p, k in benign]
    where = {b: [i for i, k in enumerate(kinds) if k & b] for b in (INSULT, DEHUMANISE, SEX, VIOLENT, ADDRESS)}
    near = lambda a, b, n: any(0 < abs(i - j) <= n for i in where[a] for j in where[b])
    v.append(1.0 if near(INSULT, ADDRESS, 5) else 0.0)
    v.append(1.0 if len({words[i] for i in where[INSULT]}) >= 2 else 0.0)
    v.append(1.0 if where[DEHUMANISE] else 0.0)
    v.append(1.0 if len({words[i] for i in where[SEX]}) >= 2 else 0.0)
    v.append(1.0 if near(VIOLENT, ADDRESS, 4) else 0.0)
    v.append(1.0 if any(k & TRICK for k in kinds) else 0.0)
    v.append(-1.0 if not any(where[b] for b in (INSULT, DEHUMANISE, SEX, VIOLENT)) and not any(v) else 0.0)
    return np.array(v)


_PLAIN = np.array([0.0] * (len(VOTERS) - 1) + [-1.0])


def batch_votes(b: Batch) -> np.ndarray:
    """Votes on all units of a batch; units without a lexicon's word are plain."""
    v = np.tile(_PLAIN, (len(b), 1))
    for i in np.flatnonzero(b.kind & ~ADDRESS):
        v[i] = votes(*b.unit(i))
    return v


#: Precision expected of a voter before its agreement with others is seen, by what it is: a
#: phrase, a lexicon's word or pair of words, a harmless use. Worth PRIOR triples or posts.
EXPECTED = {k: 0.8 for k in PATTERNS} | {k: 0.02 for k in BENIGN} | {"insult_near_you": 0.6, "insults_many": 0.5, "dehuman_word": 0.3, "sexual_many": 0.6, "violence_near_you": 0.2, "tricked_word": 0.1, "plain": 0.002}
PRIOR = 6


def rater_accuracy(agree: float, pairs: float) -> float:
    """Two raters that are right with rate a, independently, agree with a² + (1 - a)²."""
    share = (agree + 9) / (pairs + 10)
    return float(np.clip((1 + np.sqrt(max(2 * share - 1, 0.0))) / 2, 0.6, 0.99))


class LabelModel:
    """Precision of every voter, from the moments of firing and from labelled posts.

    With f voting or not, cov(f_i, f_j) = p (1 - p) d_i d_j for voters that are independent
    given the truth, where d is the rate among abusive units less that among harmless ones;
    triples of voters that fire together give each d, and so the share of a voter's firings
    that are right. Kinds of abuse exclude each other, so voters of different kinds seldom
    fire together; there the labelled posts count: ``posts`` and ``right`` are the number that
    a voter fires on and the sum of their posteriors under the raters alone. What a pair's
    covariance exceeds the above by is its correlation; correlated voters that fire together
    share their weight. ``any_rate`` is the share of units with a pattern's vote for abuse; it
    stands for p."""

    def __init__(self, n: float, first: np.ndarray, seen: np.ndarray, any_rate: float, posts: np.ndarray | None = None, right: np.ndarray | None = None):
        k, n = len(first), max(n, 1.0)
        posts = np.zeros(k) if posts is None else posts
        right = np.zeros(k) if right is None else right
        self.prior = p = float(np.clip(any_rate, 1e-3, 0.3))
        rate = np.diag(seen) / n
        cov = seen / n - np.outer(rate, rate)
        d, precision = np.zeros(k), np.zeros(k)
        for i in range(k):
            mates = [a for a in range(k) if a != i and seen[i, a] >= 5 and cov[i, a] > 0]
            got = [cov[i, a] * cov[i, b] / cov[a, b] for x, a in enumerate(mates) for b in mates[x + 1 :] if seen[a, b] >= 5 and cov[a, b] > 0]
            expected, worth = EXPECTED[VOTERS[i]], PRIOR
            total = worth * expected + right[i]
            worth += posts[i]
            if got and rate[i] > 0 and EXPECTED[VOTERS[i]] > p:
                d[i] = np.sqrt(np.median(got) / (p * (1 - p)))
                share = np.clip((rate[i] + (1 - p) * d[i]) * p / rate[i], p, 0.98)
                total, worth = total + len(got) * share, worth + len(got)
            precision[i] = total / worth
        self.precision = np.clip(precision, 5e-4, 0.98)
        self.weight = np.log(self.precision / (1 - self.precision)) - np.log(p / (1 - p))
        harmless = np.array([v in BENIGN or v == "plain" for v in VOTERS])
        self.weight = np.where(harmless, np.minimum(self.weight, 0), np.maximum(self.weight, 0))  # no vote counts against its own side
        sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        left = (cov - p * (1 - p) * np.outer(d, d)) / np.outer(sd, sd)
        np.fill_diagonal(left, 0)
        side = np.sign(self.weight)
        self.correlation = np.where(np.outer(side, side) > 0, np.clip(left, 0, 1), 0.0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(abusive) for rows of votes."""
        fired = (v != 0).astype(float)
        share = 1.0 / (1.0 + fired @ self.correlation)
        z = np.log(self.prior / (1 - self.prior)) + (fired * share) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train_linear(rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.35, batch: int = 128) -> np.ndarray:
    """Logistic regression by AdaGrad on small batches; the last weight is the bias. Slots
    that occur are numbered first, so that a batch's work is its own size."""
    size = np.array([len(r) + 1 for r in rows])
    names, flat = np.unique(np.concatenate([x for r in rows for x in (r, _BIAS)]), return_inverse=True)
    start = np.cumsum(size) - size
    own, g = np.zeros(len(names)), np.full(len(names), 1e-2)
    order, rng = np.arange(len(rows)), np.random.RandomState(3)
    batch = max(1, min(batch, len(rows) // 40))
    epochs = max(epochs, min(40, 3000 // len(rows)))  # few rows need more rounds
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            n = size[part]
            owner = np.repeat(np.arange(len(part)), n)
            slot = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[part], n)]
            s = 1 / np.sqrt(n)
            z = np.bincount(owner, own[slot], len(part)) * s
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * s
            grad = np.bincount(slot, d[owner], len(names)) if len(names) < 4 * len(slot) else None
            if grad is None:
                some, at = np.unique(slot, return_inverse=True)
                grad = np.bincount(at, d[owner])
            else:
                some = np.flatnonzero(grad)
                grad = grad[some]
            g[some] += grad * grad
            own[some] -= rate * grad / np.sqrt(g[some])
    out = np.zeros((1 << BITS) + 1)
    out[names] = own
    return out


_BIAS = np.array([1 << BITS])


def _score(w: np.ndarray, slots: np.ndarray) -> float:
    return (w[slots].sum() + w[-1]) / np.sqrt(len(slots) + 1)


def linear_scores(w: np.ndarray, n: int, unit: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Scores of n units, from their n-grams' slots."""
    z, size = np.bincount(unit, w[slot], n), np.bincount(unit, minlength=n)
    return 1 / (1 + np.exp(-np.clip((z + w[-1]) / np.sqrt(size + 1), -30, 30)))


def _examples(b: Batch, which) -> list[np.ndarray]:
    """The distinct slots of some units of a batch."""
    unit, slot = b.slots()
    order = np.argsort(unit, kind="stable")
    slot, edge = slot[order], np.searchsorted(unit[order], np.arange(len(b) + 1))
    return [np.unique(slot[edge[i] : edge[i + 1]]).astype(np.int32) for i in which]


_SAMPLE = "i int, x double, h long, v array<tinyint>, slots array<int>"


def _survey(df: DataFrame, text: str, train_each: int) -> DataFrame:
    """One pass over all units: rows (i, x) with the sums for the label model, and sampled
    units (h, v, slots): all with a vote for abuse, and of the others those with the lowest
    hashes of the task, which hold those with the lowest of all."""
    k = len(VOTERS)

    def vote(batches):
        words = Words()
        n, hits, first, seen = 0.0, 0.0, np.zeros(k), np.zeros((k, k))
        low: list = []  # a heap of the rest, highest hash first
        held: set = set()
        for pdf in batches:
            b = Batch(pdf.iloc[:, 0].dropna(), words)
            if not len(b):
                continue
            v = batch_votes(b)
            a = np.abs(v)
            n, hits, first, seen = n + len(v), hits + float((v[:, :HITS] > 0).any(1).sum()), first + v.sum(0), seen + a.T @ a
            h = b.hashes()
            some = (v > 0).any(1)
            _, one = np.unique(h, return_index=True)
            voted = one[some[one]]
            limit = -low[0][0] if len(low) >= train_each else 1 << 63
            rest = one[~some[one]]
            rest = [i for i in rest[np.argsort(h[rest], kind="stable")][:train_each] if h[i] < limit and int(h[i]) not in held]
            if len(voted):
                yield pd.DataFrame({"i": None, "x": None, "h": h[voted], "v": list(v[voted].astype(np.int8)), "slots": _examples(b, voted)})
            for i, s in zip(rest, _examples(b, rest)):
                if len(low) < train_each:
                    heapq.heappush(low, (-int(h[i]), v[i].astype(np.int8).tolist(), s.tolist()))
                elif int(h[i]) < -low[0][0]:
                    held.discard(-heapq.heappushpop(low, (-int(h[i]), v[i].astype(np.int8).tolist(), s.tolist()))[0])
                else:
                    continue
                held.add(int(h[i]))
        if low:
            yield pd.DataFrame({"i": None, "x": None, "h": [-x[0] for x in low], "v": [x[1] for x in low], "slots": [x[2] for x in low]})
        sums = np.concatenate(([n, hits], first, seen.ravel()))
        yield pd.DataFrame({"i": np.arange(len(sums)), "x": sums, "h": None, "v": None, "slots": None})

    return cut(df.select(text).mapInPandas(vote, _SAMPLE))


def _labelled(df: DataFrame, labels: DataFrame, text: str, key: str, most: int) -> list:
    """(votes, slots, yes, no) of the units of at most ``most`` labelled posts."""
    who = labels.where(F.col("abusive").isin(0, 1) & F.col(key).isNotNull()).select(key, "rater", "abusive").distinct()
    who = who.groupBy(key).agg(F.sum("abusive").cast("int").alias("yes"), F.sum(F.lit(1) - F.col("abusive")).cast("int").alias("no"))
    who = who.withColumn("_h", F.xxhash64(key)).orderBy("_h").limit(most).drop("_h")
    posts = df.select(key, F.col(text).alias("text")).join(F.broadcast(who), key).groupBy(key).agg(F.first("text").alias("text"), F.first("yes").alias("yes"), F.first("no").alias("no"))

    def run(batches):
        words = Words()
        for pdf in batches:
            b = Batch(pdf["text"], words)
            if not len(b):
                continue
            own = b.owner
            yield pd.DataFrame({key: pdf[key].to_numpy()[own], "yes": pdf["yes"].to_numpy()[own], "no": pdf["no"].to_numpy()[own], "v": list(batch_votes(b).astype(np.int8)), "slots": _examples(b, range(len(b)))})

    out: dict = {}
    got = posts.mapInPandas(run, f"{key} long, yes int, no int, v array<tinyint>, slots array<int>")
    for who, yes, no, v, slots in _arrow(got).itertuples(index=False):
        post = out.setdefault(who, (yes, no, [], []))
        post[2].append(v)
        post[3].append(slots.astype(np.int64))
    return [out[k] for k in sorted(out)]


def _arrow(df: DataFrame) -> pd.DataFrame:
    """A bounded table, to the driver."""
    return df.toArrow().to_pandas()


def _logit(p):
    return np.log(p / (1 - p))


def fit(df: DataFrame, text: str = "text", train_each: int = TRAIN_EACH, labels: DataFrame | None = None, key: str = "doc_id", labelled: int = LABELLED) -> tuple[LabelModel, np.ndarray]:
    """The label model from all units and the raters, the classifier from bounded samples."""
    k = len(VOTERS)
    voted = _survey(df, text, train_each)
    x = np.zeros(2 + k + k * k)
    for r in voted.where("i is not null").groupBy("i").agg(F.sum("x").alias("x")).collect():
        x[r["i"]] = r["x"]
    posts = [] if labels is None else _labelled(df, labels, text, key, labelled)
    two = [(y, n) for y, n, _, _ in posts if y + n == 2]
    accuracy = rater_accuracy(sum(y != n for y, n in two), len(two))
    base = np.clip((sum(y / (y + n) for y, n, _, _ in posts) + 1) / (len(posts) + 4), 0.02, 0.9)
    rated = np.array([_logit(base) + (y - n) * _logit(accuracy) for y, n, _, _ in posts])  # log odds under the raters alone
    fires, right = np.zeros(k), np.zeros(k)
    for (_, _, v, _), z in zip(posts, rated):
        v = np.array(v)
        # A harmless unit says nothing of the rest of its post: it counts where nothing else does.
        f = (v > 0).any(0) if (v > 0).any() else (v < 0).any(0)
        fires += f
        right += f / (1 + np.exp(-z))
    side = np.array([0 if n == "plain" else 1 for n in VOTERS])
    model = LabelModel(x[0], x[2 : 2 + k], x[2 + k :].reshape(k, k), x[1] / max(x[0], 1.0), fires * side, right * side)

    @F.pandas_udf("double")
    def posterior(v: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(np.array(v.to_list(), dtype=float)) if len(v) else [], dtype=float)

    units = voted.where("i is null").groupBy("h").agg(F.first(F.struct("v", "slots")).alias("u")).select("h", "u.*").withColumn("p", posterior("v"))
    sides = [_arrow(units.where(side).orderBy("h").limit(train_each).select("slots", "p")) for side in ("p > 0.7", "p < 0.1")]
    data, target = [np.asarray(x, np.int64) for t in sides for x in t["slots"]], [p for t in sides for p in t["p"]]
    # A labelled post's odds: its raters', and what the voters say by their rates on such posts.
    best = [model.posterior(np.array(v, float)) for _, _, v, _ in posts]
    hit = np.array([p.max() >= 0.5 for p in best], float)
    q = 1 / (1 + np.exp(-rated))
    hit_yes, hit_no = ((q * hit).sum() + 1) / (q.sum() + 2), (((1 - q) * hit).sum() + 1) / ((1 - q).sum() + 2)
    odds = rated + np.where(hit > 0, np.log(hit_yes / hit_no), np.log((1 - hit_yes) / (1 - hit_no)))
    for i in np.flatnonzero(odds < -CLEAR):
        data += posts[i][3]
        target += [1 / (1 + np.exp(-odds[i]))] * len(posts[i][3])
    yes = [i for i in np.flatnonzero(odds > CLEAR)]
    if not yes and not any(t > 0.7 for t in target):
        return model, np.append(np.zeros(1 << BITS), -4.0)
    # Of an abusive post one unit is learnt: first that of the voters, then the highest so far.
    pick = {i: int(best[i].argmax()) for i in yes if hit[i]}
    rounds = ROUNDS if yes else 1
    for k in range(rounds):
        w = train_linear(data + [posts[i][3][u] for i, u in pick.items()], np.array(target + [1 / (1 + np.exp(-odds[i])) for i in pick]), 6 if k + 1 == rounds else 4)
        pick = {i: int(np.argmax([_score(w, s) for s in posts[i][3]])) for i in yes}
    return model, w


def score_posts(spark: SparkSession, df: DataFrame, text: str = "text", fitted: tuple[LabelModel, np.ndarray] | None = None, out: str = "score", labels: DataFrame | None = None) -> DataFrame:
    shared = spark.sparkContext.broadcast((fitted or fit(df, text, labels=labels))[1])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, w = Words(), shared.value
        for texts in batches:
            b = Batch(texts, words)
            top = np.zeros(len(texts))
            if len(b):
                unit, slot = b.slots()
                np.maximum.at(top, b.owner, linear_scores(w, len(b), unit, slot))
            yield pd.Series(top)

    return df.withColumn(out, score(F.col(text)))


def rates(scored: DataFrame, source: str = "source", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Posts, abusive posts and their rate per source."""
    return scored.groupBy(source).agg(F.count("*").alias("n_posts"), F.sum((F.col(score) >= threshold).cast("long")).alias("n_abusive"), F.avg((F.col(score) >= threshold).cast("double")).alias("rate"))
