"""Exact byte-level BPE by prefix-sharing traversal of the distinct pieces.

A byte-pair encoding with merge ranks has, for every prefix of a word, one last token; the encoding of the prefix is the
encoding of what stands before that token, followed by it. So the state of a trie node is its last token, and a child's
state follows from its ancestors' states alone: of the vocabulary entries that end at the child, exactly one is
compatible with the state of the node where it begins. Two neighbouring tokens are compatible when undoing the merges on
either side of their border never shows a pair that the ranks would have merged earlier.

The distinct pieces are visited in byte order, which is the depth-first order of their trie: the states of the path to
the current word are kept on a stack, a shared prefix is computed once, and the trie itself is never held in memory.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: The pre-tokeniser of the 50k byte-level vocabularies (fixed value).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same language on the standard library's engine, which is about three times faster. It holds for texts without
#: the characters of `odd_characters`, whose classes the two engines see differently.
FAST_PATTERN = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: Pieces kept in a worker's memo; beyond that it is emptied, which costs time but changes no result.
MEMO_PIECES = 400_000


@lru_cache(maxsize=1)
def odd_characters() -> tuple[str, str]:
    """Character classes of the code points that the two engines classify differently: inside the first plane, beyond it.

    They are apart because the standard library looks a first-plane class up in a table, but walks through a longer one.
    """
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)))
    odd: set[str] = set()
    for exact, fast in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd ^= set(regex.findall(exact, every)) ^ set(re.findall(fast, every))
    # a character that differs in two classes cancels out above, so both are added again
    odd |= set(regex.findall(r"\p{N}", every)) ^ set(re.findall(r"\d", every))
    odd |= set(regex.findall(r"\p{L}", every)) ^ set(re.findall(r"[^\W\d_]", every))
    points, ranges = sorted(map(ord, odd)), []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    classes = []
    for low, high in ((0, 0xFFFF), (0x10000, sys.maxunicode)):
        inside = "".join(f"\\U{max(a, low):08x}-\\U{min(b, high):08x}" for a, b in ranges if a <= high and b >= low)
        classes.append(f"[{inside}]" if inside else r"(?!)")
    return classes[0], classes[1]


class Splitter:
    """Cuts a text into the pieces within which merges happen."""

    def __init__(self, odd: tuple[str, str]) -> None:
        self._odd = re.compile(odd[0]).search
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search
        self._odd_beyond = re.compile(odd[1]).search
        self._fast = re.compile(FAST_PATTERN).findall
        self._exact = regex.compile(PIECE_PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if self._odd(text) or (self._beyond(text) and self._odd_beyond(text)):
            return self._exact(text)
        return self._fast(text)


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary in id order, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def derive_splits(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the two tokens whose merge makes it; a single byte has itself on both sides.

    A token's last merge is what remains when its bytes are merged with the ranks below its own.
    """
    ids = {token: i for i, token in enumerate(vocab)}
    left, right = np.arange(len(vocab), dtype=np.int32), np.arange(len(vocab), dtype=np.int32)
    for token, own in ids.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = own, -1
            for i in range(len(parts) - 1):
                rank = ids.get(parts[i] + parts[i + 1], own)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left[own], right[own] = ids[parts[0]], ids[parts[1]]
    return left, right


@lru_cache(maxsize=4)
def tokenizer_tables(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray, tuple[str, str]]:
    """What a worker needs to encode; its size is fixed by the vocabulary (50k entries, about 2 MB)."""
    vocab = load_ranks(path)
    return (vocab, *derive_splits(vocab), odd_characters())


class TrieEncoder:
    """Encodes sets of pieces along their shared prefixes and remembers the results."""

    def __init__(self, vocab: list[bytes], left: np.ndarray, right: np.ndarray) -> None:
        self._ids = {token: i for i, token in enumerate(vocab)}
        self._size = [len(token) for token in vocab]
        # the longest entry that ends in given two bytes bounds the search for the tokens that end at a node
        self._longest: dict[bytes, int] = {}
        for token in vocab:
            self._longest[token[-2:]] = max(self._longest.get(token[-2:], 1), len(token))
        self._left, self._right = left.tolist(), right.tolist()
        self._merged = {(a, b): i for i, (a, b) in enumerate(zip(self._left, self._right)) if self._size[i] > 1 and a != i}
        self._border: dict[tuple[int, int], bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        left, right, merged = self._left, self._right, self._merged
        x, y, bound, verdict = a, b, 1 << 31, None
        while verdict is None:
            rank = merged.get((x, y))
            if rank is not None and rank < bound:
                verdict = False
                break
            # undo the younger of the two merges; a single byte has none
            can_x, can_y = right[x] != x, left[y] != y
            if not can_x and not can_y:
                verdict = True
            elif can_x and (x > y or not can_y):
                bound, x = x, right[x]
            else:
                bound, y = y + 1, left[y]
        if len(self._border) > 2_000_000:
            self._border.clear()
        self._border[(a, b)] = verdict
        return verdict

    def _last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The state of the node ``word[:end]``; ``last`` has the states of its ancestors."""
        ids, border = self._ids, self._border
        for size in range(min(end, self._longest.get(word[max(0, end - 2) : end], 1)), 0, -1):
            token = ids.get(word[end - size : end])
            if token is not None:
                if size == end:
                    return token
                before = last[end - size]
                fits = border.get((before, token))
                if self._compatible(before, token) if fits is None else fits:
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def walk(self, words: Iterable[bytes], visit: Callable[[bytes, list[int], int], None]) -> None:
        """Depth-first over the trie of ``words``; ``visit`` gets each word with the last token of each of its prefixes,
        and the length of the prefix that it shares with the word before."""
        last: list[int] = [-1]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last.append(self._last_token(word, end, last))
            before = word
            visit(word, last, shared)

    def encode(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each word."""
        out: dict[bytes, tuple[int, ...]] = {}
        size = self._size

        def visit(word: bytes, last: list[int], shared: int) -> None:
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            out[word] = tuple(reversed(ids))

        self.walk(words, visit)
        return out

    def count(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """The number of tokens of each word; the count is carried along the path like the last token."""
        out: dict[bytes, int] = {}
        size = self._size

        so_far = [0]

        def visit(word: bytes, last: list[int], shared: int) -> None:
            del so_far[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                so_far.append(so_far[end - size[last[end]]] + 1)
            out[word] = so_far[len(word)]

        self.walk(words, visit)
        return out


class CorpusEncoder:
    """Splitter, trie and memo of one Python worker."""

    def __init__(self, vocab: list[bytes], left: np.ndarray, right: np.ndarray, odd: tuple[str, str]) -> None:
        self._trie = TrieEncoder(vocab, left, right)
        self.split = Splitter(odd)
        self._ids: dict[str, tuple[int, ...]] = {}
        self._counts: dict[str, int] = {}

    @staticmethod
    def _learn(memo: dict, pieces: list[list[str]], make: Callable[[Iterable[bytes]], dict]) -> None:
        new = set(chain.from_iterable(pieces)) - memo.keys()
        if len(memo) > MEMO_PIECES:
            memo.clear()
            new = set(chain.from_iterable(pieces))
        raw = {piece: piece.encode("utf-8", "surrogatepass") for piece in new}
        made = make(raw.values())
        memo.update((piece, made[b]) for piece, b in raw.items())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin; null and empty texts have none."""
        pieces = [self.split(t) if t else [] for t in texts]
        self._learn(self._ids, pieces, self._trie.encode)
        get = self._ids.__getitem__
        parts = [np.fromiter(chain.from_iterable(map(get, p)), dtype=np.int32) for p in pieces]
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have 0."""
        pieces = [self.split(t) if t else [] for t in texts]
        self._learn(self._counts, pieces, self._trie.count)
        get = self._counts.__getitem__
        return [sum(map(get, p)) for p in pieces]


_WORKER: dict[int, CorpusEncoder] = {}


def worker_encoder(tables) -> CorpusEncoder:
    """The encoder of this Python worker, made once for each broadcast of tables."""
    if id(tables) not in _WORKER:
        _WORKER.clear()
        _WORKER[id(tables)] = CorpusEncoder(*tables.value)
    return _WORKER[id(tables)]
