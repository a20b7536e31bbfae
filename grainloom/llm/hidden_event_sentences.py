"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model (problem 8).

Between any two tokens of a text stands a hidden event: a sentence ends, or it goes on. Only at some gaps can one end: a
closing mark, a line break, in scripts written without blanks also a blank. At these gaps the model weighs, in log odds,

    P(end | last two tokens) P(next token | end)   against   P(on | last two tokens) P(next token | last token, on)

over token classes, and over the word itself where it ends in a dot, with back-off to coarser contexts. In stretches of
scripts without blanks that have neither marks nor blanks an event is open between any two characters, and the same odds
are taken of characters: P(end | last two characters) with back-off, P(next | end), P(next | last). A forward and a
backward pass along the gaps of a stretch adds what the neighbouring events say (sentences of one short token are rare),
and a boundary is set where the posterior exceeds one half.

The counts are trained here, without labels, over all documents: a narrow stage counts the kinds of gaps of every whole
text (words in hash slots, so the table has a fixed size), events that are plain (line ends, a dot before a small letter)
start the expectation maximisation over these counts, the rest follow.

Layout comes first: lines are stretches of their own unless a document's lines are merely wrapped to a width.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainloom.llm.common import map_batches, small_batches

#: Rounds of training; hash slots of words before a dot, and of characters and pairs of characters.
ROUNDS, WORD_SLOTS, CHAR_SLOTS = 4, 1 << 15, 1 << 16

#: Characters that are looked up together, and probabilities that are kept.
CHARS_AT_ONCE, PAIRS_KEPT = 1 << 18, 1 << 16

#: Characters of an unpunctuated stretch from which its gaps are open, and those in a short sentence.
UNPUNCTUATED, SHORT = 40, 6

#: Widest line of a wrapped paragraph.
WIDEST = 132

_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_KANA = "぀-ヿ"
_THAI = "฀-๿"
_NOBLANK = f"{_HAN}{_KANA}{_THAI}຀-໿ក-៿"
_MARKS = ".!?…。！？．｡।॥؟۔‼⁇⁈⁉"
_CLOSE = "\"'”’»」』）)\\]】〉》〕*_"
#: Patterns that are searched begin with a class of characters: to these the engine skips.
_BREAK = re.compile(r"[\n\r\v\f\x85  ](?:(?<=\r)\n)?")
_BULLET = re.compile(r"[ \t]*(?:[-*+•·●○◦‣▪■–—]\s|#{1,6}\s|>\s|\(?\d{1,3}[.)、）]\s?|\(?[a-zA-Z][.)]\s|[一二三四五六七八九十百]{1,3}、|（[一二三四五六七八九十\d]{1,3}）|第[一二三四五六七八九十百\d]{1,4}[章节回篇部卷]\s?|\|)")
#: What follows a match: white space, and the character behind it.
_AHEAD = r"(?=(\s*)(\S?))"
_MARK_TAIL = f"[{_MARKS}]*(?:[ \xa0\u202f](?=[»]))?[{_CLOSE}]*"
_BLANKS = " \t\u3000\xa0"
_GAP = re.compile(
    f"[{_MARKS}{_BLANKS}](?:(?<=[{_MARKS}]){_MARK_TAIL}"
    f"|(?<=[{_NOBLANK}”」』）》][{_BLANKS}])[{_BLANKS}]*(?=[{_NOBLANK}“「『（《])){_AHEAD}"
)
#: The same of a text in ASCII, where no blank is a gap.
_ASCII_GAP = re.compile(f"[{_MARKS}]{_MARK_TAIL}{_AHEAD}")
_WORD = re.compile(r"\S+")
_NUMBER = re.compile(r"[$€£¥]?\d[\d.,:/]*%?$")
_INITIAL = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]$")
_REPORT = re.compile(r"(?:說|说|道|问|問|答|喊|叫|称|稱|嚷|回答|कहा|पूछा|चिल्लाया|बोला|बोली)")
_DASH = "-–—―"
_COMMA = ",;:，；：、،؛"
_OPENING, _LEADING = "\"'“„‘«「『(（[《¿¡", "(（[\"'“„‘«「『¿¡—–-"
_FOLLOWING = re.compile(f"\\s*([{re.escape(_OPENING)}]*)(\\S?)")
_BEHIND_DOT = re.compile(f"[{_HAN}{_KANA}“「《]")
_ADDRESS = re.compile(r"(?:https?:|www\.|/)\S*$")
_CLOSING = re.compile(r"[。！？．｡!?]|\.(?!\w)")
_MARK = re.compile(f"[{_MARKS}]")
_PARTICLE = re.compile("[とっ]")
_HAN_OR_KANA = re.compile(f"[{_HAN}{_KANA}]")

#: Abbreviations by what follows them. Titles stand before names, references before numbers, inner ones
#: inside a sentence; the rest may also end one.
TITLES = frozenset("dr prof mr mrs ms mx st sr sra srta dra don dña m mm mme mlle me hr fr frl hrn rev hon gen col lt sgt capt cmdr gov sen rep pres sgt maj mt ft г г-н г-жа ул пл пр пер д им проф акад о डॉ श्री श्रीमती د أ".split())
REFERENCES = frozenset("fig figs sec secs no nos nr núm num art abs kap chap ch vol vols p pp pag pág eq eqs thm lem def prop cor ex tab app ref refs vers v ver bd s cap estr рис табл гл стр с см ст п №".split())
INNER = frozenset("e.g i.e eg ie cf viz vs approx ca circa bzw z.b d.h u.a z zb dh ggf evtl sog env p.ex par.ex av apr aprox p.ej ej ок т.е т.д т.п т др пр напр тыс млн resp incl excl esp usu al b h".split())
ENDING = frozenset("etc inc ltd corp co jr sr p.m a.m pm am u.s u.k ph.d b.a m.a bros plc llc gmbh ag usw u.s.w dept est ff et.al шт руб коп км г.г ac d.c b.c a.d c.a".split())

#: Words before an ordinal or a numbered thing whose dot is no end.
ORDINAL = frozenset("am im der den dem des das die zum beim vom bis ab seit zur in ins und".split())


def _word_class(token: str, upper: bool) -> str:
    """Class of a word before a single dot; ``upper`` tells whether its last letter is a capital."""
    if _NUMBER.match(token):
        return "number"
    for name, words in (("title", TITLES), ("reference", REFERENCES), ("inner", INNER), ("ending", ENDING)):
        if token in words:
            return name
    if _INITIAL.match(token):
        if len(token) < 8 and upper:
            return "initial"
        if "." in token:
            return "ending"
    return "word"


@lru_cache(maxsize=1 << 16)
def _token(word: str, upper: bool) -> tuple[str, str, int]:
    """Class of a word before a single dot, the word without opening signs, in lower case, and its slot."""
    token = word.lstrip(_LEADING).lower()
    return (_word_class(token, upper), token, word_slot(token)) if token else ("none", "", -1)


def _left(text: str, start: int, mark_at: int, mark: str) -> tuple[str, str, str, int]:
    """Class of the mark, class of the token before it, and where the mark is a dot the token and its slot."""
    kind, single = _mark_kind(mark)
    if not single and kind[0] != ".":
        last = text[mark_at - 1] if mark_at > start else " "
        if last not in _LEADING and not last.isspace():
            return kind, "other", "", -1
    words = text[max(start, mark_at - 40) : mark_at].rsplit(None, 1)
    left, token, slot = _token(words[-1], text[mark_at - 1].isupper()) if words else ("none", "", -1)
    return kind, left if single or not token else "other", token, slot if kind[0] == "." else -1


@lru_cache(maxsize=1 << 14)
def _char_class(c: str, quoted: bool) -> str:
    """Class of what begins with the character, behind opening signs or without."""
    if c in _COMMA or not quoted and c in ")）]」』”»":
        return "comma"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "quote-upper" if quoted else "upper"
    if c.isalpha() or "ऀ" <= c <= "࿿":
        return "quote-uncased" if quoted else "uncased"
    return "sign"


def _right(text: str, at: int, end: int) -> str:
    """Class of what follows the gap."""
    m = _FOLLOWING.match(text, at, end)
    opening, c = m.groups()
    if not opening and not c:
        return "nothing"
    if c and c in _DASH:
        word = _WORD.match(text, m.start(1), end)
        if not opening and word.end() > m.end() and text[m.end()].isupper():
            return "upper"
        rest = text[word.end() : word.end() + 3].lstrip()
        return "dash-lower" if not rest or not rest[0].isupper() else "dash-upper"
    return _char_class(c or opening[0], bool(opening))


def _follows(text: str, at: int, end: int, c: str) -> str:
    """`_right`, if the first character behind the white space is known."""
    return _right(text, at, end) if c in _OPENING or c in _DASH else _char_class(c, False)


@dataclass(slots=True)
class Gap:
    """A place where a sentence may end: before `end` (exclusive); the next one begins at or after `next`."""

    end: int
    next: int
    mark: str
    left: str
    token: str
    before: str
    right: str
    words: int = 0
    forced: int = 0  # 1: an end, -1: none
    quote: int = -1  # index of the bracketed stretch it lies in
    key: tuple = ()
    slot: int = -1  # of the token before a dot


def _mark_class(mark: str) -> str:
    core = mark.rstrip(_CLOSE + "   ")
    closed = "q" if core != mark else ""
    if not core.strip():
        return "blank"
    if core.startswith("…") or core.startswith("..") or core == "。。。":
        return "dots" + closed
    if core[0] in ".．｡" and len(core) == 1:
        return ("." if core == "." else "。") + closed
    if core[0] in ".．":
        return "strong" + closed
    return ("。" if core[0] in "。।॥۔" else "strong") + closed


@lru_cache(maxsize=4096)
def _mark_kind(mark: str) -> tuple[str, bool]:
    """Class of a mark, and whether it is a single dot, by which the word before it counts."""
    return _mark_class(mark), mark[0] in ".．｡" and len(mark.rstrip(_CLOSE)) <= 1


_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "【": "】", "[": "]", "〈": "〉"}
_SIGNS = re.compile("[\"“”„«»「」『』（）()《》【】\\[\\]〈〉]")


def _spans(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Matched outermost quotations and brackets of a stretch."""
    out: list[tuple[int, int, str]] = []
    if not _SIGNS.search(text, start, end):
        return out
    stack: list[tuple[str, int]] = []
    inner: list[tuple[int, int, str]] = []
    waiting: Counter = Counter()  # closing signs that something open waits for
    for m in _SIGNS.finditer(text, start, end):
        c, at = m.group(), m.start()
        closed = None
        if waiting[c] > 0:
            while True:
                s, a = stack.pop()
                wanted = '"' if s == '"' else _PAIRS[s]
                for x in wanted:
                    waiting[x] -= 1
                if c in wanted:
                    break
            closed = (a, at + 1, s)
            if not stack:
                out.append(closed)
        elif c == '"' or c in _PAIRS:
            stack.append((c, at))
            for x in '"' if c == '"' else _PAIRS[c]:
                waiting[x] += 1
        if closed is not None and stack:
            inner.append(closed)
    if not stack:
        return out
    # the signs still open are without a partner: of the pairs behind them the outermost count
    last = stack[0][1]
    reach = -1
    for pair in sorted(x for x in inner if x[0] > last):
        if pair[0] >= reach:
            out.append(pair)
            reach = pair[1]
    return out


def find_gaps(text: str, start: int, end: int, layout: bool = False) -> list[Gap]:
    """The gaps of a stretch at which a sentence may end, with all that is certain about them decided."""
    gaps: list[Gap] = []
    body = -1
    closing = None
    for m in (_ASCII_GAP if text.isascii() else _GAP).finditer(text, start, end):
        a, b = m.span()
        mark, space, following = m.group(0, 1, 2)
        if not following:
            break
        if body < 0:
            marker = _BULLET.match(text, start, end)
            body = marker.end() if marker else start
        if b <= body:
            continue
        if mark.isspace():
            if closing is None:
                closing = bool(_CLOSING.search(text, start, end))
            if closing:
                continue
            right = _follows(text, b, end, following)
            gaps.append(Gap(a, b, mark, "uncased", text[a - 1], "", right, key=("blank", "uncased", right)))
            continue
        if not space:
            after = following
            if mark == "." or mark == "．":
                # a dot inside a word or number; a sentence may still begin right behind it
                before = text[a - 1] if a > start else " "
                joined = after.isupper() and (before.islower() or before.isdigit() or before in ")”’") or bool(_BEHIND_DOT.match(after)) and not before.isdigit() or before.isalnum() and after in "“«„¿¡—"
                if joined and before.isascii() and before.islower() and _ADDRESS.search(text[max(start, a - 60) : a]):
                    joined = False
                if not joined:
                    continue
            if mark[0] in "?!" and after.isascii() and (after.islower() or after.isdigit() or after in "=&/"):
                continue  # inside an address or a piece of code
        kind, left, token, slot = _left(text, start, a, mark)
        right = _follows(text, b, end, following)
        g = Gap(b, b, mark, left, token, _before(text, start, a, token) if left == "number" else "", right, key=(kind, left, right), slot=slot)
        # closing signs that open the next quotation belong to it
        if not space and mark[-1] == '"' and following.isalnum():
            g.end = g.next = b - 1
        gaps.append(g)
    if not gaps:
        return gaps
    spans = sorted(_spans(text, start, end))
    k, seen = 0, -1
    fresh = goes_on = False
    words_from = start
    for g in gaps:
        g.words = text.count(" ", words_from, g.end) + (g.end - words_from > 14)
        words_from = g.end
        while k < len(spans) and spans[k][1] < g.end:
            k += 1
        if k < len(spans) and spans[k][0] < g.end <= spans[k][1]:
            a, z, sign = spans[k]
            if seen < k:
                seen = k
                fresh, goes_on = _surroundings(text, start, end, body, spans[k])
            if sign in "《〈【[":
                g.forced = -1
            elif g.end < z:
                g.forced = -1 if not fresh or goes_on or sign in "(（" else 0
            elif not fresh and sign in "(（" or goes_on:
                g.forced = -1
        if g.forced == 0:
            g.forced = _certain(g)
    return gaps


def _before(text: str, start: int, mark_at: int, token: str) -> str:
    """The word before the token at a mark, in lower case."""
    previous = text[max(start, mark_at - len(token) - 20) : mark_at - len(token)].split()
    return previous[-1].lower() if previous else ""


def _surroundings(text: str, start: int, end: int, body: int, span: tuple[int, int, str]) -> tuple[bool, bool]:
    """Whether a quotation or bracket begins afresh, and whether the sentence goes on behind it."""
    a, z, sign = span
    lead = text[max(start, a - 30) : a].rstrip()
    fresh = not lead or a <= body or lead[-1] in _MARKS + _CLOSE
    tail = _right(text, z, end)
    goes_on = tail in ("lower", "comma", "dash-lower")
    told = bool(lead) and lead[-1] in ":："
    if tail == "uncased" and sign not in "(（[" and not told:
        stop = _MARK.search(text, z, end)
        clause = text[z : stop.start() if stop else end]
        goes_on = len(clause) <= 12 or bool(_REPORT.search(clause)) or bool(_PARTICLE.match(clause)) or sign in "《〈"
    return fresh, goes_on


def _certain(g: Gap) -> int:
    """What needs no model: continuations in small letters, references before numbers, titles before names."""
    kind, left, right = g.key
    single = left == "initial" and len(g.token) == 1
    ordinal = left == "number" and g.before.strip("(") in ORDINAL and bool(re.fullmatch(r"\d{1,2}", g.token))
    return _decided(kind, left, right, single, ordinal, "(" in g.mark)


@lru_cache(maxsize=4096)
def _decided(kind: str, left: str, right: str, single: bool, ordinal: bool, opens: bool) -> int:
    if right == "comma" or right == "lower" and kind[0] in ".d":
        return -1
    if right in ("lower", "dash-lower") and kind.endswith("q"):
        return -1
    if kind in (".", ".q"):
        if left == "title" and right in ("upper", "digit", "lower"):
            return -1
        if single and right == "upper":
            return -1
        if left in ("reference", "inner") and right in ("digit", "sign", "lower"):
            return -1
        if left == "reference" and right == "quote-upper" and opens:
            return -1
        if ordinal and right == "upper":
            return -1
    if kind in ("strong", "。", "strongq", "。q") and right in ("upper", "quote-upper", "uncased", "quote-uncased", "digit"):
        return 1
    if kind == "dots" and right == "uncased":
        return -1
    return 0


def word_slot(token: str) -> int:
    return xxhash.xxh32_intdigest(token) % WORD_SLOTS


def _char_slots(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Hash slots of characters, or of pairs of them."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if second is not None:
        mixed = (mixed ^ (mixed >> np.uint64(31))) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    """Event counts by context, from the most special to the most general; all are log odds when read."""

    lexical: dict = field(default_factory=dict)
    context: dict = field(default_factory=dict)
    mark: dict = field(default_factory=dict)
    short: float = -2.0  # log odds that a sentence has a single short token
    #: of characters without blanks, by slot: met, ended a sentence, began one (the last two rows are of pairs)
    chars: np.ndarray = field(default_factory=lambda: np.zeros((len(CHAR_TABLES), CHAR_SLOTS)))
    #: what `pair` has worked out of the finished counts
    pairs: dict = field(default_factory=dict, repr=False, compare=False)

    def odds(self, g: Gap) -> float:
        """Log odds of an end at the gap, by its own context."""
        ends, n = self.mark.get(g.key[0], (0.5, 1.0))
        p = (ends + 0.5) / (n + 1.0)
        ends, n = self.context.get(g.key, (0.0, 0.0))
        p = (ends + 4.0 * p) / (n + 4.0)
        if g.slot >= 0:
            ends, n = self.lexical.get((g.slot, g.right), (0.0, 0.0))
            p = (ends + 6.0 * p) / (n + 6.0)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def pair(self, g: Gap) -> tuple[float, float]:
        """Probabilities of an end at the gap and of none, by its own context."""
        at = (g.key, g.slot)
        found = self.pairs.get(at)
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            found = self.pairs[at] = _pair(self.odds(g))
        return found

    def char_odds(self, points: np.ndarray) -> np.ndarray:
        """Log odds of an end between each two neighbours of an unpunctuated stretch, by its characters."""
        met, ended, began, pair_met, pair_ended = self.chars
        n_met, n_ended = met.sum() + 1.0, began.sum()
        if n_ended < 1 or len(points) < 3:
            return np.full(max(0, len(points) - 1), -20.0)
        last, following = _char_slots(points[:-1]), _char_slots(points[1:])
        before = np.concatenate([points[:1], points[:-2]])
        two = _char_slots(before, points[:-1])
        p = (ended[last] + 8.0 * n_ended / n_met) / (met[last] + 8.0)
        p = (pair_ended[two] + 4.0 * p) / (pair_met[two] + 4.0)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        after = (began[following] + 8.0 * met[following] / n_met) / (n_ended + 8.0)
        # a pair met across the gap speaks for going on
        across = _char_slots(points[:-1], points[1:])
        on = (pair_met[across] + 4.0 * met[following] / n_met) / (met[last] + 4.0)
        return np.log(p / (1 - p)) + np.log(np.maximum(after, 1e-9)) - np.log(np.maximum(on, 1e-9))


def posteriors(gaps: list[Gap], model: Model, odds: list[float] | None = None) -> list[float]:
    """P(end) at each gap, by a forward and a backward pass over the chain of events.

    Two ends with at most one short token between them are tied by the model's odds of such a sentence.
    """
    n = len(gaps)
    own = [(1e-9, 1.0) if g.forced < 0 else (1.0, 1e-9) if g.forced > 0 else _pair(odds[i]) if odds else model.pair(g) for i, g in enumerate(gaps)]
    short = math.exp(model.short)
    tie = [short if i and g.words <= 1 and g.key[0] != "blank" and not g.forced else 1.0 for i, g in enumerate(gaps)]
    ahead: list[tuple[float, float]] = []
    e, o = 1.0, 1.0
    for i in range(n):
        pe, po = own[i]
        e, o = (pe * (e * tie[i] + o), po * (e + o)) if i else (pe, po)
        s = e + o
        e, o = e / s, o / s
        ahead.append((e, o))
    out = [0.0] * n
    be, bo = 1.0, 1.0
    for i in range(n - 1, -1, -1):
        e, o = ahead[i]
        out[i] = e * be / (e * be + o * bo)
        pe, po = own[i]
        be, bo = pe * be * tie[i] + po * bo, pe * be + po * bo
        s = be + bo
        be, bo = be / s, bo / s
    return out


def _pair(odds: float) -> tuple[float, float]:
    p = 1.0 / (1.0 + math.exp(-odds))
    return p, 1.0 - p


CHAR_TABLES = ("met", "ended", "began", "pair met", "pair ended")

_MARKED = re.compile(f"[{_MARKS}][{_MARKS}]*(?:[ ](?=[»]))?[{_CLOSE}]*{_AHEAD}")


def event_counts(text: str, kinds: Counter | None = None, ended: Counter | None = None) -> tuple[Counter, Counter]:
    """The kinds of gaps at the marks of a text, ``(mark, left, right, slot)``, but for certain ones; and the slots of the
    words behind which a line ends with a mark. Both are added to what is given."""
    kinds = Counter() if kinds is None else kinds
    ended = Counter() if ended is None else ended
    for m in _MARKED.finditer(text):
        mark, space, following = m.group(0, 1, 2)
        if mark in ".．" and not space and following:
            continue
        a, b = m.span()
        kind, left, token, slot = _left(text, 0, a, mark)
        if not following or "\n" in space or "\r" in space:
            ended[slot] += 1
            continue
        right = _follows(text, b, len(text), following)
        g = Gap(b, b, mark, left, token, _before(text, 0, a, token) if left == "number" else "", right, key=(kind, left, right))
        if not _certain(g):
            kinds[(kind, left, right, slot)] += 1
    return kinds, ended


def char_counts(texts: list[str], tables: np.ndarray) -> None:
    """Add the characters of scripts without blanks, and where sentences end among them, to the tables of slots."""
    size, some = 0, []
    for text in texts:
        if not text.isascii():
            some.append(text)
            size += len(text)
            if size > CHARS_AT_ONCE:
                _count_chars(some, tables)
                size, some = 0, []
    if some:
        _count_chars(some, tables)


def _count_chars(texts: list[str], tables: np.ndarray) -> None:
    # a sign of no class between the texts, so that none meets the next
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _POINT_CLASSES[points]
    inside, breaks = classes == 1, classes == 2
    here = np.flatnonzero(inside)
    # a sentence ends before a mark, a line's end or, where there are no marks, a blank; the next begins behind it
    last = here[breaks[here + 1]]
    first = here[(here > 0) & breaks[here - 1]]
    pairs = here[inside[here + 1]]
    two = last[(last > 0)]
    two = two[inside[two - 1]]
    for k, slots in enumerate((_char_slots(points[here]), _char_slots(points[last]), _char_slots(points[first]), _char_slots(points[pairs], points[pairs + 1]), _char_slots(points[two - 1], points[two]))):
        tables[k] += np.bincount(slots, minlength=CHAR_SLOTS)


_NOBLANK_RANGES = [(ord(x[0]), ord(x[2])) for x in re.findall(r".-.", _NOBLANK)]
_ENDING_POINTS = np.array(sorted({ord(c) for c in _MARKS + "\n\r"} | {0x20, 0x3000}), dtype=np.uint32)
#: Of each code point: 1 in a script without blanks, 2 where a sentence may end before it.
_POINT_CLASSES = np.zeros(0x110000, dtype=np.uint8)
_POINT_CLASSES[_ENDING_POINTS] = 2
for _low, _high in _NOBLANK_RANGES:
    _POINT_CLASSES[_low : _high + 1] = 1


def fit(kinds: dict[tuple, int], ended: dict[int, int], chars: np.ndarray | None = None, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over counts of kinds of gaps: what closes a line is an end, what `_certain` decides is
    decided, and the posterior of every other kind is the sum of what its counts say at each level of back-off."""
    model = Model() if chars is None else Model(chars=chars)
    # before any round: closing marks end more often than not, dots after abbreviations seldom
    prior = {"title": 0.02, "reference": 0.05, "inner": 0.03, "initial": 0.08, "ending": 0.45, "number": 0.75, "word": 0.95, "other": 0.9, "none": 0.5, "uncased": 0.85}
    strength = 6.0
    for kind, left, right in {k[:3] for k in kinds}:
        p = prior.get(left, 0.5)
        if kind.startswith("dots"):
            p = 0.85 if "upper" in right else 0.1
        if right == "digit" and left in ("word", "number"):
            p = min(p, 0.6)
        model.context[(kind, left, right)] = (strength * p, strength)
    model.context[("blank", "uncased", "uncased")] = (strength * 0.9, strength)
    base = dict(model.context)
    for _ in range(rounds):
        context: dict = {}
        lexical: dict = {}
        mark: dict = {}
        for (kind, left, right, slot), n in kinds.items():
            key = (kind, left, right)
            p = _probability(model, key, slot)
            for table, at in ((context, key), (mark, kind), (lexical, (slot, right) if slot >= 0 else None)):
                if at is not None:
                    e, m = table.get(at, (0.0, 0.0))
                    table[at] = (e + n * p, m + n)
        model.context = {k: (e + base.get(k, (0, 0))[0], n + base.get(k, (0, 0))[1]) for k, (e, n) in (base | context).items()}
        model.mark = mark
        # a word that is often met before a dot but never closes a line is an abbreviation, and the other way round
        model.lexical = {}
        for (slot, right), (e, n) in lexical.items():
            if n >= 3:
                closing = min(ended.get(slot, 0), n)
                model.lexical[(slot, right)] = (e + closing, n + closing)
    return model


def _probability(model: Model, key: tuple, slot: int) -> float:
    ends, n = model.mark.get(key[0], (0.5, 1.0))
    p = (ends + 0.5) / (n + 1.0)
    ends, n = model.context.get(key, (0.0, 0.0))
    p = (ends + 4.0 * p) / (n + 4.0)
    if slot >= 0:
        ends, n = model.lexical.get((slot, key[2]), (0.0, 0.0))
        p = (ends + 6.0 * p) / (n + 6.0)
    return min(max(p, 1e-6), 1 - 1e-6)


def train(texts: list[str], rounds: int = ROUNDS) -> Model:
    """The model of a few texts; `trained_model` counts those of a table."""
    kinds: Counter = Counter()
    ended: Counter = Counter()
    chars = np.zeros((len(CHAR_TABLES), CHAR_SLOTS))
    for text in texts:
        event_counts(text, kinds, ended)
    char_counts(texts, chars)
    return fit(kinds, ended, chars, rounds)


def trained_model(plain: DataFrame) -> Model:
    """The model of all texts of ``plain``: counts of every whole text, added up in each partition before they are moved.

    What reaches the driver is bounded by the slots: `WORD_SLOTS` times the few classes of neighbours, and five tables of
    `CHAR_SLOTS` numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: Counter = Counter()
        ended: Counter = Counter()
        chars = np.zeros((len(CHAR_TABLES), CHAR_SLOTS), dtype=np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for text in texts:
                event_counts(text, kinds, ended)
            char_counts(texts, chars)
        rows = [("gap", *k, n) for k, n in kinds.items()] + [("ended", "", "", "", k, n) for k, n in ended.items()]
        table, slot = np.nonzero(chars)
        rows += [("char", CHAR_TABLES[t], "", "", k, n) for t, k, n in zip(table.tolist(), slot.tolist(), chars[table, slot].tolist())]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()] * 2)], ["what", "mark", "before", "after", "slot", "n"])

    schema = "what string, mark string, before string, after string, slot bigint, n bigint"
    rows = plain.mapInArrow(count, schema).groupBy("what", "mark", "before", "after", "slot").agg(F.sum("n").alias("n")).toPandas()
    gaps, ended, chars = (rows[rows["what"] == w] for w in ("gap", "ended", "char"))
    tables = np.zeros((len(CHAR_TABLES), CHAR_SLOTS))
    tables[chars["mark"].map(CHAR_TABLES.index).to_numpy(dtype=np.int64), chars["slot"].to_numpy(dtype=np.int64)] = chars["n"].to_numpy(dtype=np.float64)
    kinds = dict(sorted(zip(zip(gaps["mark"], gaps["before"], gaps["after"], gaps["slot"]), gaps["n"])))
    return fit(kinds, dict(zip(ended["slot"], ended["n"])), tables)


def unpunctuated_ends(text: str, start: int, end: int, model: Model) -> list[int]:
    """Where sentences end in a stretch of a script without blanks that has no marks and no blanks either."""
    if end - start < UNPUNCTUATED or not _BARE_RUN.fullmatch(text, start, end):
        return []
    odds = model.char_odds(np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32))
    open_ = np.flatnonzero(odds > -4.0)
    gaps = [Gap(start + k + 1, start + k + 1, "", "uncased", "", "", "uncased", key=("bare", "uncased", "uncased")) for k in open_.tolist()]
    at = start
    for g in gaps:
        g.words = 2 if g.end - at > SHORT else 1
        at = g.end
    return [g.end for g, p in zip(gaps, posteriors(gaps, model, odds[open_].tolist())) if p > 0.5 and min(g.end - start, end - g.end) > SHORT]


_BARE_RUN = re.compile(f"[{_NOBLANK}]+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text between which sentences surely end: lines, or paragraphs where lines are wrapped to a width."""
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    if len(lines) == 1:
        return lines
    paragraphs: list[list[tuple[int, int]]] = [[]]
    for a, b in lines:
        if text[a:b].isspace() or a == b:
            paragraphs.append([])
        else:
            if _BULLET.match(text, a, b):
                paragraphs.append([])
            paragraphs[-1].append((a, b))
    paragraphs = [p for p in paragraphs if p]
    wrapped = any(len(p) > 1 for p in paragraphs) and _wrapped(text, paragraphs)
    out: list[tuple[int, int]] = []
    for p in paragraphs:
        out += [(p[0][0], p[-1][1])] if wrapped and len(p) > 1 else p
    return out


def _wrapped(text: str, paragraphs: list[list[tuple[int, int]]]) -> bool:
    """Whether the lines are as full as the first word of the next one allows, at a width that nearly all breaks fit.

    A break fits the widths from its line's length up to where the next word would have had room. Of one or two breaks
    only small letters after an unfinished line are proof enough.
    """
    fits: list[tuple[int, int]] = []
    flowing = cased = 0
    for p in paragraphs:
        for (a, b), (c, d) in zip(p, p[1:]):
            line = text[a:b].rstrip()
            word = _WORD.search(text, c, d).group()
            room = 1 if _HAN_OR_KANA.match(word) else 1 + len(word)
            fits.append((len(line), len(line) + room))
            unfinished = line[-1] not in _MARKS + "\"”」』»"
            flowing += unfinished and word[0].islower()
            cased += unfinished and word[0].isupper()
    steps = sorted([(low, 1) for low, _ in fits] + [(high, -1) for _, high in fits])
    best = now = width = 0
    for at, step in steps:
        now += step
        if now > best:
            best, width = now, at
    if width > WIDEST:
        return False
    if len(fits) < 4:
        return flowing > 0 and (best == len(fits) or flowing > cased)
    return best >= 0.75 * len(fits) or best >= 0.5 * len(fits) and flowing > 0.25 * len(fits)


def split_sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text, in code points, the end exclusive, without white space at either end."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    for start, end in stretches(text):
        gaps = find_gaps(text, start, end)
        at = start
        if gaps:
            open_ = [g.forced == 0 for g in gaps]
            chance = posteriors(gaps, model) if any(open_) else [float(g.forced > 0) for g in gaps]
            for g, p in zip(gaps, chance):
                if p > 0.5 and g.end > at:
                    _add(text, at, g.end, out)
                    at = g.end
        else:
            for stop in unpunctuated_ends(text, start, end, model):
                _add(text, at, stop, out)
                at = stop
        _add(text, at, end, out)
    return out


def _add(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((start, end))


def sentence_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """One row ``(doc_id, sent_start, sent_end)`` for each sentence.

    Documents whose source is code, however it is spelled, and null, empty or blank texts have none. Null ids stay null
    and repeated rows stay repeated. The model is trained on all of the documents; every document is split whole. Extra
    columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    plain = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.col(source) if source else F.lit("")).alias("source"))
    plain = plain.where("text IS NOT NULL AND lower(trim(coalesce(source, ''))) <> 'code'").select("doc_id", "text")
    model = spark.sparkContext.broadcast(trained_model(plain))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [split_sentences(t, model.value) for t in batch.column(1).to_pylist()]
        flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
        rows = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["doc_id", "sent_start", "sent_end"])

    return map_batches(plain, split, "doc_id bigint, sent_start bigint, sent_end bigint")
