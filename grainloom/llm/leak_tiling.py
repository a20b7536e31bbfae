"""Evaluation texts leaking into training text, by greedy string tiling (problem 1).

1. Items and documents become sequences of units: words, and single Han characters of half a word's weight.
2. Seeds are runs as long as an item's shortest tile. A bitmap of fixed size holds the items' seeds; a narrow stage keeps
   of each document only the windows in which enough of its units lie in seeds, so no document text is ever shuffled.
3. Slices of the distinct windows meet blocks of the items, both of bounded size; a block's inverted index joins the seeds
   of a window to its items, and a pair is tiled when its longest common runs can be linked as the tiles of a passage are
   and span and cover as much (`_stretches`; a bound from the acceptance rule that loses no passage).
4. Each pair is tiled: a running Karp-Rabin scan finds common runs of a search length, the longest are marked first, the
   length shrinks until the least tile is reached. Tiles in the item's order with at most single altered units between
   them form a passage; a passage of thirteen words of the item that does not consist of generic fragments is a leak
   (`leaked_items`). What long tiles cover of an item in any order is thresholded by itself (`item_coverage`).
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainloom.llm.common import map_batches, shared_checkpoint, small_batches

#: Words in a leaked passage; words in a run that surely matches; bits of the seed filter (8 MB whatever the number of items).
PASSAGE, SEED, FILTER_BITS = 13.0, 3.0, 26

#: Units of a document kept on each side of a stretch that seeds cover.
MARGIN = 26

#: A window is cut into blocks of so many units that overlap by so many; any thirteen words lie whole in one of them.
BLOCK, OVERLAP = 1500, 300

#: Units that may be altered between two tiles.
ALTERED = 3

#: Units of the shortest tile of an item of words and of one of Han characters; letters of a word that may have a slip.
TILES, SLIP = (2, 3), 4

#: Share of a passage that must match letter for letter after normalisation, and words of it outside generic fragments.
MATCHED, SPECIFIC = 0.75, 4.0

HAN = "㐀-䶿一-鿿豈-﫿"
_UNIT = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_IS_HAN = re.compile(f"[{HAN}]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]+")
#: A tag of some length must consist of attributes with values, else it is text between two signs of comparison.
_REST = r"(?:[^<>]{0,200}|(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))+\s*/?)>"
_INLINE_TAG = re.compile(rf"</?(?:a|b|i|u|s|em|strong|span|font|code|mark|small|sup|sub|tt)\b{_REST}", re.I)
_TAG = re.compile(rf"</?[a-z][\w:-]*{_REST}", re.I)
_NOTE = re.compile(r"\[\^?\d{1,4}\]|\]\([^()\s]*\)")
_MARK = re.compile(r"[̀-ͯ]")
_ACCENTED = re.compile("[À-ɏ̀-ͯḀ-ỿ]")
_FOREIGN_LETTER = re.compile("[Ͱ-ϿЀ-ӿԀ-ԯա-ևıɡ]")

#: Letters of other alphabets that look like Latin ones, each above its Latin form.
_LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝкмтвнгαορνικυχτցոսıɡ",
    "aeopcyxijshdqwkmtbhraopvikyxtgnuig",
)

#: Frequent traditional characters, each above its simplified form.
_SIMPLIFIED = str.maketrans(
    "與為應對實驗組樣產結間質響歸約學將後無氣準關減長種個從來這說時國過書會話語讀車門問開東電視線記證計設許調識議譯負費資責貨賬購輕轉輪運達選還進遠連適邊鎖鏡閱隨險雜難離頭題類風飛體點龍條權極構業樂標機檢歷決況測溫濕濾燈爐熱獲現環畫當發監確礎積筆節範簡簽級細終經統綠維網編練縣總織繼續聯聲聽臟舉萬葉處號補裝製複見規觀論變辦遞釋鋅陽階際雙靜項順預額顯餘齡劑動區協單參員圓圖執報場壓導層屬師帶帳幣庫廣張強彈戶換損擇擊據數於",
    "与为应对实验组样产结间质响归约学将后无气准关减长种个从来这说时国过书会话语读车门问开东电视线记证计设许调识议译负费资责货账购轻转轮运达选还进远连适边锁镜阅随险杂难离头题类风飞体点龙条权极构业乐标机检历决况测温湿滤灯炉热获现环画当发监确础积笔节范简签级细终经统绿维网编练县总织继续联声听脏举万叶处号补装制复见规观论变办递释锌阳阶际双静项顺预额显余龄剂动区协单参员圆图执报场压导层属师带账币库广张强弹户换损择击据数于",
)
_TRADITIONAL = re.compile("[" + "".join(map(chr, _SIMPLIFIED)) + "]")


def _without_comments(text: str) -> str:
    """Without markup comments of any length, in one pass."""
    kept, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        kept.append(text[at:start])
        at = stop + 3
    return " ".join([*kept, text[at:]])


def normalise(text: str) -> str:
    """Letter forms, invisible characters, markup and accents away; lower case. Layout stays, units ignore it."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", _without_comments(text)))
    if "[" in text:
        text = _NOTE.sub(" ", text)
    if not text.isascii():
        if _FOREIGN_LETTER.search(text):
            text = text.translate(_LOOKALIKES)
        if _TRADITIONAL.search(text):
            text = text.translate(_SIMPLIFIED)
        if _ACCENTED.search(text):
            text = unicodedata.normalize("NFC", _MARK.sub("", unicodedata.normalize("NFD", text)))
    return text


def units(text: str | None) -> list[str]:
    """The units of a text; a null text has none."""
    return _UNIT.findall(normalise(text)) if text else []


class Hasher:
    """64-bit values of units, remembered; the same in every process. The last bit tells a Han character from a word."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        memo = self._memo
        if len(memo) > 1_000_000:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        except KeyError:
            for w in set(tokens) - memo.keys():
                memo[w] = xxhash.xxh64_intdigest(w) & ~1 | (len(w) == 1 and bool(_IS_HAN.match(w)))
            return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_HASH = Hasher()
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def weights(tokens: list[str]) -> np.ndarray:
    """A word weighs one, a Han character half."""
    return 1.0 - 0.5 * (_HASH(tokens) & np.uint64(1)).astype(np.float64)


def seeds(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the shortest run of weight `SEED` from each unit on."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = _HASH(tokens)
    cum = np.zeros(n + 1)
    np.cumsum(1.0 - 0.5 * (value & np.uint64(1)), out=cum[1:])
    end = np.searchsorted(cum, cum[:-1] + (SEED - 1e-6))
    start = np.flatnonzero(end <= n)
    end = end[start]
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int((end - start).max(initial=0))):
            inside = slice(None) if j < SEED else np.flatnonzero(start + j < end)
            mixed = (out[inside] ^ value[start[inside] + j]) * _MULTIPLIER
            out[inside] = mixed ^ (mixed >> np.uint64(29))
    return start, end, out


def tile_seeds(tokens: list[str], n: int) -> np.ndarray:
    """Hash of the run of ``n`` units from each unit on."""
    value = _HASH(tokens)
    out = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n if len(out) else 0):
            mixed = (out ^ value[j : j + len(out)]) * _MULTIPLIER
            out = mixed ^ (mixed >> np.uint64(29))
    return out


def document_windows(texts: list[str | None], bitmap: np.ndarray, least: float = 0.0) -> list[tuple[int, str]]:
    """The stretches of the texts, as units joined by blanks, that may hold a passage, each with its text's index.

    Seeds of the bitmap with no more units between them than between two tiles must cover ``least`` words.
    """
    split = [units(t) for t in texts]
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    tokens = list(chain.from_iterable(split))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.repeat(bounds[1:], sizes)
    mask = np.zeros(len(tokens), dtype=bool)
    for n in TILES:
        hashes = tile_seeds(tokens, n)
        slot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        hit = np.flatnonzero((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        hit = hit[hit + n <= stops[hit]]
        for j in range(n):
            mask[hit + j] = True
    covered = np.flatnonzero(mask)
    if not len(covered):
        return []
    cum = np.concatenate([[0.0], np.cumsum(weights(tokens) * mask)])
    cut = np.flatnonzero((np.diff(covered) > ALTERED + 2) | (np.diff(stops[covered]) > 0))
    first, last = covered[np.concatenate([[0], cut + 1])], covered[np.concatenate([cut, [len(covered) - 1]])] + 1
    enough = cum[last] - cum[first] >= least - 1e-6
    first, last = first[enough], last[enough]
    owner = np.searchsorted(bounds, first, side="right") - 1
    out: list[tuple[int, str]] = []
    spans: list[list[int]] = []
    for f, e, mine in zip(first.tolist(), last.tolist(), owner.tolist()):
        a, b = max(int(bounds[mine]), f - MARGIN), min(int(bounds[mine + 1]), e + MARGIN)
        if spans and spans[-1][2] == mine and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b, mine])
    for a, b, mine in spans:
        for x in range(a, max(a + 1, b - OVERLAP), BLOCK - OVERLAP):
            out.append((mine, " ".join(tokens[x : min(b, x + BLOCK)])))
    return out


# -- greedy string tiling -------------------------------------------------------------------------------------------

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _prefix_hashes(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append((out[-1] * _BASE + v) % _PRIME)
    return out


@lru_cache(maxsize=4096)
def _power(n: int) -> int:
    return pow(_BASE, n, _PRIME)


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: non-overlapping common runs ``(pattern start, text start, length)``, longest first.

    A running Karp-Rabin scan looks for runs of the search length among the unmarked units; a run far longer than the
    search length raises it, otherwise what was found is marked by falling length and the search length halves.
    """
    taken_p, taken_t = [False] * len(pattern), [False] * len(text)
    hp, ht = _prefix_hashes(pattern), _prefix_hashes(text)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), len(text), 16))
    while True:
        power, where = _power(size), {}
        blocked = -1
        for t in range(len(text) - size, -1, -1):
            if t == len(text) - size:
                blocked = next((x for x in range(t, len(text)) if taken_t[x]), len(text) + size)
            elif taken_t[t]:
                blocked = t
            if blocked >= t + size:
                where.setdefault((ht[t + size] - ht[t] * power) % _PRIME, []).append(t)
        found: list[tuple[int, int, int]] = []
        longest = 0
        if where:
            for p in range(len(pattern) - size + 1):
                if taken_p[p] or taken_p[p + size - 1]:
                    continue
                for t in where.get((hp[p + size] - hp[p] * power) % _PRIME, ()):
                    n = 0
                    while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not taken_p[p + n] and not taken_t[t + n]:
                        n += 1
                    if n >= size:
                        found.append((n, p, t))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        for n, p, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            # what an earlier mark left of the run
            k = 0
            while k < n and not taken_p[p + k] and not taken_t[t + k]:
                k += 1
            if k < size:
                continue
            for x in range(k):
                taken_p[p + x] = taken_t[t + x] = True
            out.append((p, t, k))
        if size <= least:
            return out
        size = max(least, size // 2)


def _alike(a: str, b: str) -> bool:
    """Whether one word is the other with a slip of the pen."""
    if a == b:
        return True
    if min(len(a), len(b)) < SLIP or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or (ra[2:] == rb[2:] and ra[:2] == rb[:2][::-1])


@dataclass
class Passage:
    """A chain of tiles in the item's order: words of the item it spans, matched words, matched words outside fragments,
    and the units of the window that match."""

    span: float
    matched: float
    specific: float
    units: tuple[int, ...] = ()

    def holds(self) -> bool:
        """Whether it is long, close and specific enough to be a leak."""
        return self.span >= PASSAGE - 1e-6 and self.matched >= MATCHED * self.span and self.specific >= SPECIFIC


def least_tile(item: list[str]) -> int:
    """Units of the shortest tile: two words, or three characters of a text that is mostly Han."""
    return TILES[0] if sum(len(x) > 1 for x in item) > 0.5 * len(item) else TILES[1]


def least_covered(item: list[str], w: np.ndarray) -> float:
    """Words that the tiles of any passage of the item that `Passage.holds` accepts cover.

    Between two tiles are at most ``ALTERED - 1`` words of the item; they may all match by slips of the pen, in an item
    that has words long enough for slips.
    """
    if not any(len(x) >= SLIP for x in item):
        return MATCHED * PASSAGE
    n = least_tile(item)
    tile = float(np.convolve(w, np.ones(n), "valid").min()) if len(w) >= n else n / 2
    return min(max(k * tile, PASSAGE - (ALTERED - 1) * (k - 1)) for k in range(1, 14))


def passages(item: list[str], window: list[str], generic: np.ndarray) -> tuple[list[int], list[Passage]]:
    """The units of the window in the chain with most matched words, and all chains and parts of chains that hold, one
    for each first and last tile. ``generic`` flags units in fragments."""
    names: dict[str, int] = {}
    p_ids = [names.setdefault(w, len(names) + 1) for w in item]
    t_ids = [names.setdefault(w, len(names) + 1) for w in window]
    w = weights(item)
    found = sorted(tiles(p_ids, t_ids, least_tile(item)))
    cum = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)]).tolist()
    own = np.concatenate([[0.0], np.cumsum(w * ~generic, dtype=np.float64)]).tolist()
    links: list[list[tuple[int, float, float, tuple[int, ...]]]] = []  # tile before, words matched by slips, specific ones
    for j, (p, t, _) in enumerate(found):
        links.append([])
        for i in range(j - 1, -1, -1):
            pi, ti, ni = found[i]
            gap_p, gap_t = p - pi - ni, t - ti - ni
            if not 0 <= gap_t <= ALTERED + 1 or gap_p < 0 or cum[p] - cum[pi + ni] > ALTERED - 0.9:
                continue
            slips: tuple[int, ...] = ()
            slip = special = 0.0
            if gap_p and gap_t:
                for x in range(pi + ni, p):
                    y = next((y for y in range(ti + ni, t) if y not in slips and _alike(item[x], window[y])), -1)
                    if y >= 0:
                        slips, slip, special = (*slips, y), slip + float(w[x]), special + own[x + 1] - own[x]
            links[j].append((i, slip, special, slips))
    top: tuple[float, list[int]] = (0.0, [])
    out: list[Passage] = []
    # what is best by matched words may lack specific ones, and the other way round
    for order in (0, 1) if generic.any() else (0,):
        for first in range(len(found)):
            best: dict[int, tuple[float, float, int, tuple[int, ...]]] = {}  # matched, specific, tile before, slips
            for j in range(first, len(found)):
                p, t, n = found[j]
                matched, specific = cum[p + n] - cum[p], own[p + n] - own[p]
                if j == first:
                    best[j] = (matched, specific, -1, ())
                    state = best[j]
                else:
                    ways = [(best[i][0] + matched + slip, best[i][1] + specific + special, i, slips) for i, slip, special, slips in links[j] if i in best]
                    if not ways:
                        continue
                    state = best[j] = max(ways, key=lambda x: (x[order], x[1 - order]))
                span = cum[p + n] - cum[found[first][0]]
                held = Passage(span, state[0], state[1])
                if state[0] <= top[0] and not held.holds():
                    continue
                used: list[int] = []
                at = j
                while at >= 0:
                    _, start, size = found[at]
                    used += [*range(start, start + size), *best[at][3]]
                    at = best[at][2]
                if state[0] > top[0]:
                    top = (state[0], used)
                if held.holds():
                    held.units = tuple(sorted(used))
                    out.append(held)
    return top[1], out


def holds_exactly(item: list[str], window: list[str], generic: np.ndarray) -> bool:
    """Whether the window has a run of the item, letter for letter, that is long and specific enough."""
    where: dict[tuple[str, ...], list[int]] = {}
    own = np.concatenate([[0.0], np.cumsum(weights(item) * ~generic)])

    def runs(tokens: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        cum = np.concatenate([[0.0], np.cumsum(weights(tokens))])
        ends = np.searchsorted(cum, cum[:-1] + (PASSAGE - 1e-6)).tolist()
        return [(i, tuple(tokens[i:e])) for i, e in enumerate(ends) if e <= len(tokens)]

    for i, run in runs(item):
        where.setdefault(run, []).append(i)
    for t, run in runs(window):
        for p in where.get(run, ()):
            n = len(run)
            while p + n < len(item) and t + n < len(window) and item[p + n] == window[t + n]:
                n += 1
            if own[p + n] - own[p] >= SPECIFIC:
                return True
    return False


@dataclass
class Item:
    """An item prepared for tiling; sums before each unit of the words, and of the words outside fragments."""

    tokens: list[str]
    generic: np.ndarray
    w: np.ndarray = field(init=False)
    least: float = field(init=False)
    cum: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.w = weights(self.tokens)
        self.least = least_covered(self.tokens, self.w)
        self.cum = np.concatenate([[0.0], np.cumsum(self.w)])
        self.own = np.concatenate([[0.0], np.cumsum(self.w * ~self.generic)])


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and the range that each is of."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(owner)), owner


class ItemIndex:
    """Inverted index of a block of items: where each run of the least tile's length, and each seed, stands."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.tile = np.array([least_tile(x.tokens) for x in items], dtype=np.int64)
        self.least = np.array([x.least for x in items])
        self._runs = {}
        for n in TILES:
            rows = np.flatnonzero(self.tile == n)
            hashes = [tile_seeds(items[r].tokens, n) for r in rows]
            self._runs[n] = self._sorted(hashes, rows)
        found = [seeds(x.tokens) for x in items]
        # seeds inside fragments show nothing
        kept = [h[[not x.generic[a:b].all() for a, b in zip(s, e)]] if len(h) else h for x, (s, e, h) in zip(items, found)]
        self._seeds = self._sorted(kept, np.arange(len(items)))

    @staticmethod
    def _sorted(hashes: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        row = np.repeat(rows, [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        return flat[order], row[order], place[order]

    @staticmethod
    def _find(index: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, owner = _spread(np.searchsorted(index[0], hashes, "left"), np.searchsorted(index[0], hashes, "right"))
        return index[1][at], owner, index[2][at]

    def segments(self, window: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the window, place in the item and length of every longest common run, by item."""
        parts = []
        for n in TILES:
            row, t, p = self._find(self._runs[n], tile_seeds(window, n))
            order = np.lexsort((t, t - p, row))
            row, t, p = row[order], t[order], p[order]
            if len(row):
                new = np.flatnonzero(np.concatenate([[True], (np.diff(row) > 0) | (np.diff(t - p) != 0) | (np.diff(t) != 1)]))
                parts.append((row[new], t[new], p[new], np.diff(np.append(new, len(t))) + n - 1))
        out = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)

    def surely(self, window: list[str], w: np.ndarray) -> np.ndarray:
        """Words of the window that surely match each item: those in a seed that the item has outside fragments."""
        start, end, hashes = seeds(window)
        row, k, _ = self._find(self._seeds, hashes)
        step = np.zeros((len(self.items), len(window) + 1), np.int32)
        np.add.at(step, (row, start[k]), 1)
        np.add.at(step, (row, end[k]), -1)
        return (np.cumsum(step[:, :-1], axis=1) > 0) * w


#: Common runs of an item and a window beyond which their chains are not looked at before tiling.
MOST_SEGMENTS = 400


def _stretches(index: ItemIndex, window: list[str], w: np.ndarray) -> dict[int, tuple[int, int]]:
    """The items that may hold a passage, each with the part of the window where it may stand.

    The tiles of a passage are parts of longest common runs that follow each other as tiles do, so together these must
    span and cover what a passage does. No passage is lost here.
    """
    row, t, p, n = index.segments(window)
    ahead = np.concatenate([[0.0], np.cumsum(w)])
    size = ahead[t + n] - ahead[t]
    enough = (np.bincount(row, size, minlength=len(index.items)) >= index.least - 1e-6)[row]
    row, t, p, n, size = row[enough], t[enough], p[enough], n[enough], size[enough]
    if not len(row):
        return {}
    first, last = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    many = last - first > MOST_SEGMENTS
    b, a = _spread(first, np.where(many, first, last))
    wide = np.where(index.tile[row[a]] == TILES[0], ALTERED - 1, 2 * ALTERED - 1)
    link = (t[b] > t[a]) & (p[b] > p[a]) & (t[b] - t[a] - n[a] <= ALTERED + 1) & (p[b] - p[a] - n[a] <= wide)
    a, b = a[link], b[link]
    label = np.where(many, first, np.arange(len(row)))
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    order = np.argsort(label, kind="stable")
    row, t, p, n, size, label = row[order], t[order], p[order], n[order], size[order], label[order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(label) > 0]))
    stop = np.append(new[1:], len(label))
    lows = (np.minimum.reduceat(t, new), np.minimum.reduceat(p, new))
    highs = (np.maximum.reduceat(t + n, new), np.maximum.reduceat(p + n, new))
    out: dict[int, tuple[int, int]] = {}
    for k in np.flatnonzero(np.add.reduceat(size, new) >= index.least[row[new]] - 1e-6).tolist():
        item = index.items[row[new[k]]]
        (t0, p0), (t1, p1) = (x[k] for x in lows), (x[k] for x in highs)
        if item.cum[p1] - item.cum[p0] < PASSAGE - 1e-6 or item.own[p1] - item.own[p0] < SPECIFIC - 1e-6:
            continue
        mine, here = np.zeros(p1 - p0, dtype=bool), np.zeros(t1 - t0, dtype=bool)
        for q in range(new[k], stop[k]):
            mine[p[q] - p0 : p[q] - p0 + n[q]] = here[t[q] - t0 : t[q] - t0 + n[q]] = True
        words, special = item.w[p0:p1], ~item.generic[p0:p1]
        if min(words[mine].sum(), w[t0:t1][here].sum()) < item.least - 1e-6:
            continue
        slips = sum(len(item.tokens[x]) >= SLIP for x in np.flatnonzero(special & ~mine) + p0)
        if words[mine & special].sum() + slips < SPECIFIC - 1e-6:
            continue
        low, high = out.get(int(row[new[k]]), (len(window), 0))
        out[int(row[new[k]])] = (min(low, int(t0)), max(high, int(t1)))
    return out


@dataclass
class Finding:
    """What a window shows of an item: an exact passage, or the units and words of altered ones that rivals may explain."""

    item: int
    exact: bool
    altered: list[tuple[int, int, float]]


def examine(window: list[str], index: ItemIndex, masks: bool = False) -> tuple[list[Finding], np.ndarray]:
    """The items of the index with a passage in the window, and the words of the window that each item surely matches
    (where an altered passage needs them, or ``masks`` are asked for).

    Every item that may hold a passage is tiled, and every part of a chain of tiles is a passage of its own.
    """
    w = weights(window)
    out: list[Finding] = []
    marked: list[tuple[int, np.ndarray]] = []
    for i, (a, b) in _stretches(index, window, w).items():
        low, high = max(0, a - 2), min(len(window), b + 2)
        item = index.items[i]
        best, found = passages(item.tokens, window[low:high], item.generic)
        marked.append((i, low + np.array(sorted({*best, *chain.from_iterable(p.units for p in found)}), dtype=np.int64)))
        if found:
            exact = holds_exactly(item.tokens, window[low:high], item.generic)
            spans = {(low + p.units[0], low + p.units[-1] + 1, float(w[low + np.array(p.units)].sum())) for p in found}
            out.append(Finding(i, exact, [] if exact else sorted(spans)))
    if not masks and not any(x.altered for x in out):
        return out, np.zeros((0, len(window)))
    sure = index.surely(window, w)
    for i, at in marked:
        sure[i, at] = w[at]
    return out, sure


def leaking(window: list[str], index: ItemIndex) -> list[int]:
    """The items of the index that a window leaks.

    An exact run of thirteen words counts whatever else matches. An altered passage counts for the item that explains
    its stretch of the window best, or for each that does equally well: items made from one template agree in most words
    of a stretch that was copied from one of them only.
    """
    found, sure = examine(window, index)
    out = [x.item for x in found if x.exact]
    for x in found:
        for a, b, mine in x.altered:
            rivals = sure[:, a:b].sum(axis=1)
            rivals[x.item] = 0.0
            if not len(rivals) or rivals.max() <= mine + 0.4:
                out.append(x.item)
                break
    return out


# -- the operator ---------------------------------------------------------------------------------------------------


def _generic_flags(tokens: list[str], w: np.ndarray, fragments: frozenset[str]) -> np.ndarray:
    """Which units of an item lie in a generic fragment (a run of thirteen words' weight)."""
    flags = np.zeros(len(tokens), dtype=bool)
    cum = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
    ends = np.searchsorted(cum, cum[:-1] + PASSAGE - 1e-6)
    for i, e in enumerate(ends):
        if e <= len(tokens) and " ".join(tokens[i:e]) in fragments:
            flags[i:e] = True
    return flags


#: Fragments that may be listed; the list is a curated parameter of the operator, far below this bound.
MOST_FRAGMENTS = 1_000_000

#: Units of the items in a block, which a task indexes in memory; windows that a task puts to a block.
BLOCK_UNITS, SLICE = 4_000_000, 500

#: Units of the shortest tile of a reordered item, in words, and the share of its words that such tiles must cover.
REORDERED_TILE, COVERED = 8, 0.6


def _prepared_items(items: DataFrame, fragments: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """``key, units, generic, slots, least``: each distinct long enough item text once; and ``key, item_id``."""
    spark = items.sparkSession
    rows = fragments.where(F.col("ngram").isNotNull()).select("ngram").distinct().limit(MOST_FRAGMENTS + 1).collect()
    if len(rows) > MOST_FRAGMENTS:
        raise ValueError(f"more than {MOST_FRAGMENTS} generic fragments")
    generic = spark.sparkContext.broadcast(frozenset(" ".join(units(r[0])) for r in rows))

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = units(raw)
            w = weights(tokens)
            if float(w.sum()) < PASSAGE - 1e-6:
                continue
            flags = _generic_flags(tokens, w, generic.value)
            slots = np.unique(tile_seeds(tokens, least_tile(tokens)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            out.append((i, " ".join(tokens), flags.astype(np.uint8).tobytes(), slots, least_covered(tokens, w)))
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["item_id", "units", "generic", "slots", "least"])

    plain = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    every = shared_checkpoint(map_batches(plain, prepare, "item_id bigint, units string, generic binary, slots array<bigint>, least double").withColumn("key", F.md5("units")))
    texts = every.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("units", "generic", "slots", "least")])
    return shared_checkpoint(texts), every.select("key", "item_id").distinct()


def _held_windows(docs: DataFrame, texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, window_id, window``: the stretches of documents in which runs of items lie close enough together."""
    spark = docs.sparkSession
    lowest = texts.agg(F.min("least")).first()[0] or 0.0
    # the filter: at most 2^FILTER_BITS slots reach the driver, packed into 64-bit words
    slots = texts.select(F.explode("slots").alias("slot")).distinct()
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    packed = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    packed[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    bitmap = spark.sparkContext.broadcast(packed.view(np.uint8))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        found = document_windows(batch.column(1).to_pylist(), bitmap.value, lowest)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], ["doc_id", "window"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return shared_checkpoint(map_batches(source, windows, "doc_id bigint, window string").withColumn("window_id", F.md5("window")))


def _against_items(held: DataFrame, texts: DataFrame, blocks: int, look, schema: str) -> DataFrame:
    """``look(windows, index, keys)`` of every slice of the distinct windows and every block of the items.

    A slice and a block are bounded, so no frequent run of words and no hot window ever meets all items in one task.
    """
    distinct = held.groupBy("window_id").agg(F.any_value("window").alias("window"))
    n = distinct.count()
    slices = max(1, -(-n // SLICE), min(held.sparkSession.sparkContext.defaultParallelism, -(-n // 50)))
    deal = lambda c, k: F.expr(f"cast(pmod(xxhash64({c}), {k}) as int)")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = distinct.select("window_id", "window", deal("window_id", slices).alias("slice"), every(blocks).alias("block"))
    right = texts.select("key", "units", "generic", deal("key", blocks).alias("block"), every(slices).alias("slice"))

    def run(windows: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if windows.empty or items.empty:
            return look(windows.iloc[:0], None, [])
        index = ItemIndex([Item(u.split(" "), np.frombuffer(g, np.uint8).astype(bool)) for u, g in zip(items["units"], items["generic"])])
        return look(windows, index, items["key"].tolist())

    # a partition of its own for nearly every group: the data are small, the work on them is not
    tasks = 4 * slices * blocks
    parts = [x.repartition(tasks, "block", "slice").groupBy("block", "slice") for x in (left, right)]
    return parts[0].cogroup(parts[1]).applyInPandas(run, schema)


def leaked_items(docs: DataFrame, items: DataFrame, fragments: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row ``(doc_id, item_id)`` for each document and item of which it holds a passage.

    A passage is a run of at least thirteen consecutive words of the item, in its order, where single words may be
    altered, dropped or put in, and letter forms, layout and markup do not matter. Null, empty and short texts and items
    match nothing; null ids are left out; items that occur under several ids count under each, repeated rows once. Empty
    tables give an empty result. Extra columns are not read.

    Items beyond ``block_units`` are looked at in blocks; whether an item of another block explains an altered passage
    better is then decided in a step of its own, with the same outcome.
    """
    small_batches(docs.sparkSession)
    texts, ids = _prepared_items(items, fragments, item_id, item_text)
    held = _held_windows(docs, texts, doc_id, text)
    size = texts.agg(F.sum(F.length("units") - F.length(F.replace("units", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_units))
    if blocks == 1:

        def whole(windows: pd.DataFrame, index: ItemIndex, keys: list[str]) -> pd.DataFrame:
            rows = [(i, keys[k]) for i, window in zip(windows["window_id"], windows["window"]) for k in leaking(window.split(" "), index)]
            return pd.DataFrame(rows, columns=["window_id", "key"])

        leaks = _against_items(held, texts, 1, whole, "window_id string, key string")
    else:
        leaks = _without_rivals(_against_items(held, texts, blocks, _findings, _FINDINGS))
    return held.select("doc_id", "window_id").join(leaks, "window_id").select("doc_id", "key").distinct().join(ids, "key").select("doc_id", "item_id").distinct()


_FINDINGS = "window_id string, key string, exact boolean, a int, b int, mine double, mask binary, owners int"


def _findings(windows: pd.DataFrame, index: ItemIndex, keys: list[str]) -> pd.DataFrame:
    """Passages, and masks (half words that surely match, unit by unit) with the number of items that share each."""
    rows: list[tuple] = []
    for i, window in zip(windows["window_id"], windows["window"]):
        found, sure = examine(window.split(" "), index, masks=True)
        for x in found:
            rows += [(i, keys[x.item], True, None, None, None, None, None)] if x.exact else [(i, keys[x.item], False, int(a), int(b), mine, None, None) for a, b, mine in x.altered]
        shown = (2 * sure).astype(np.uint8)
        owners: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(shown.any(axis=1)).tolist():
            owners.setdefault(shown[k].tobytes(), []).append(k)
        rows += [(i, keys[k[0]], None, None, None, None, mask, len(k)) for mask, k in owners.items()]
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _FINDINGS.split(", ")]).astype({"exact": "object", "a": "Int32", "b": "Int32", "owners": "Int32"})


def _without_rivals(findings: DataFrame) -> DataFrame:
    """``window_id, key`` of exact passages, and of altered ones that no other item, of any block, explains better."""
    findings = shared_checkpoint(findings)
    altered = findings.where("NOT exact").select("window_id", "key", "a", "b", "mine")
    masks = findings.where("mask IS NOT NULL").select("window_id", "mask", F.col("key").alias("owner"), "owners")
    met = altered.join(masks, "window_id").where("key <> owner OR owners > 1").select("window_id", "key", "a", "b", "mine", F.expr("substring(mask, a + 1, b - a)").alias("part"))
    # the half words of a byte are 0, 1 or 2, so counting the hexadecimal digits adds them up
    digits = F.hex("part")
    half = F.regexp_count(digits, F.lit("01")) + 2 * F.regexp_count(digits, F.lit("02"))
    beaten = met.where(half / 2 > F.col("mine") + 0.4).select("window_id", "key", "a", "b", "mine").distinct()
    left = altered.join(beaten, ["window_id", "key", "a", "b", "mine"], "left_anti").select("window_id", "key")
    return findings.where("exact").select("window_id", "key").unionByName(left).distinct()


def item_coverage(docs: DataFrame, items: DataFrame, fragments: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", covered: float = COVERED) -> DataFrame:
    """``doc_id, item_id, coverage``: items of which tiles cover at least the share ``covered`` of the words, in any order.

    This finds items whose passages were reordered or scattered: tiles have eight words at least (`REORDERED_TILE`) and may
    stand anywhere in the document; what lies in generic fragments is taken out of both sides of the share. Nulls, short
    items, repeated rows and empty tables are treated as in `leaked_items`.
    """
    small_batches(docs.sparkSession)
    texts, ids = _prepared_items(items, fragments, item_id, item_text)
    held = _held_windows(docs, texts, doc_id, text)
    size = texts.agg(F.sum(F.length("units") - F.length(F.replace("units", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0

    def tiled(windows: pd.DataFrame, index: ItemIndex, keys: list[str]) -> pd.DataFrame:
        rows: list[tuple] = []
        for i, window in zip(windows["window_id"], windows["window"]):
            tokens = window.split(" ")
            ahead = np.concatenate([[0.0], np.cumsum(weights(tokens))])
            row, t, _, n = index.segments(tokens)
            for k in np.unique(row[ahead[t + n] - ahead[t] >= REORDERED_TILE - 1e-6]).tolist():
                item, names = index.items[k], {}
                p_ids, t_ids = ([names.setdefault(x, len(names) + 1) for x in y] for y in (item.tokens, tokens))
                least = REORDERED_TILE if index.tile[k] == TILES[0] else 2 * REORDERED_TILE
                mine = np.zeros(len(item.tokens), dtype=bool)
                for p, _, m in tiles(p_ids, t_ids, least):
                    mine[p : p + m] = True
                mine &= ~item.generic
                if mine.any():
                    rows.append((i, keys[k], np.flatnonzero(mine).tolist(), float(item.own[-1])))
        return pd.DataFrame(rows, columns=["window_id", "key", "at", "words"])

    parts = _against_items(held, texts, max(1, -(-size // BLOCK_UNITS)), tiled, "window_id string, key string, at array<int>, words double")
    # units of a word weigh one, those of a Han character half
    places = held.select("doc_id", "window_id").join(parts, "window_id").select("doc_id", "key", "words", F.explode("at").alias("at")).distinct()
    found = places.join(texts.select("key", F.split("units", " ").alias("u")), "key").groupBy("doc_id", "key", "words").agg(F.sum(F.when(F.expr("u[at]").rlike(f"^[{HAN}]$"), 0.5).otherwise(1.0)).alias("here"))
    share = F.round(F.col("here") / F.col("words"), 6)
    return found.join(ids, "key").select("doc_id", "item_id", share.alias("coverage")).where(F.col("coverage") >= covered)
