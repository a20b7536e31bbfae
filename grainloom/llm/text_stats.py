"""Per-document text quality statistics, and the rules that tell prose from lists, tables and junk (problem 2).

A document is cut into chunks of `CHUNK` code points. Each chunk gives the counts of the lines that lie wholly inside it
and a summary of the line pieces at its two ends; summaries merge associatively. What a cut went through (a word, a
sentence end, a cell, a gap) is repaired in every count from the text that the two pieces keep of either side of the cut:
the counts of both sides together take the place of the counts of each. Documents of one chunk, nearly all, are finished
in the narrow stage; longer ones are cut in it, in one pass, and their chunks are merged in a tree of `FANIN` branches, so
no task ever holds a whole huge text. Ratios and rules are derived from the merged counts.

A line that no cut has touched, nearly every one, keeps no summary: what all rules ask for comes from a few passes over all
lines of the chunk at once, and a measure that few lines are judged by is taken of a line only when a rule asks for it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainloom.llm.common import small_batches

#: Code points in a chunk, chunks in a first-level merge, and the greatest number of common words (a bounded parameter).
CHUNK, FANIN, MOST_COMMON_WORDS = 1 << 16, 64, 100_000

#: Characters kept of a line's two ends, for markers, dates and end marks, and of either side of a cut, for its repair: a
#: word, a number or a run of blanks that a cut goes through may be that long on each side and still counts as uncut.
EDGE, CONTEXT = 256, 1024

HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_HAN = re.compile(f"[{HAN}]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-\u2010-\u2015\u2018-\u201f\u3001-\u3011\uff01-\uff0f\uff1a\uff1b\uff1f\u2026\u0300-\u036f\u0900-\u0963\u0e00-\u0e7f]|_")
_END = tuple(".!?\u3002\uff01\uff1f\uff0e\uff61\u2026\u0964\u061f\u06d4")
_ENDS = frozenset(_END)
_CLOSERS = "\"'\u201d\u2019\u300d\u300f\u300b\u300f\uff09)]\u00bb*_"
# a mark comes first in this pattern, and in those of cells and voiced words, so that the search skips to the marks
_SENTENCE_END = re.compile(r"[.!?\u3002\uff01\uff1f\uff0e\uff61\u2026\u0964\u061f\u06d4](?:(?:(?<!\.)|(?<=[^\W\d_]{3}\.))[\"'\u201d\u2019\u300d\u300f\uff09)\]\u00bb]*(?=\s|$)|(?<=[\u3002\uff01\uff1f\uff61]))")
_BULLET = re.compile(r"\s*(?:[-*+\u2022\u00b7\u25cf\u2023\u25aa\u2013\u2014\u25e6\u25a0\u25cb]\s|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\u3001\uff09]\s|[\u4e00-\u5341]{1,3}\u3001|\uff08[\u4e00-\u5341\d]{1,3}\uff09)")
_LOG = re.compile(r"\s*[\[(]?(?:\d{4}[-/]\d\d[-/]\d\d|\d\d:\d\d:\d\d)\b")
_LEADER = re.compile(r"(?:\.{4,}|(?:\. ){3,}|\u2026{2,}|_{4,}|\u00b7{4,})\s*\d+\s*$")
_PAIR = re.compile(r"\s*[^\s:\uff1a](?:[^:\uff1a.!?\u3002]{0,38}[^\s:\uff1a.!?\u3002])?\s*(?:[:\uff1a=]| [-\u2013\u2014] )\s*\S")
_GAPS = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_TABBED = re.compile(r"\S\s*\t\s*(?=\S)")
_CHAIN = re.compile(r"\s[>|\u00bb\u203a/\u2192\u00b7\u2022]\s|\s#\w|[,\uff0c\u3001]\s?")
_NUMBER = r"\s*(?:-?[\d.]+%?|[nN]/[aA]|-|)\s*(?=[,;|\t]|$)"
_FIRST_NUMBER_CELL, _NUMBER_CELL = re.compile(_NUMBER), re.compile(r"[,;|\t]" + _NUMBER)
_BLOB = re.compile(r"[A-Za-z0-9+/=]{28,}")
_VOICED = re.compile(r"[aeiouyAEIOUY\u00c0-\u00ff]\S*")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"((?:[^\w\s]|_)+)")
_HANS = re.compile(f"[{HAN}]+")
#: For ASCII texts: small letters and digits with blanks for marks, and symbols only.
_LOW = {c: chr(c).lower() if chr(c).isalnum() or chr(c).isspace() else " " for c in range(128)}
_ONLY_SYMBOLS = {c: chr(c) if _SYMBOL.match(chr(c)) else None for c in range(128)}

#: Kinds of lines. Plain lines are judged by the document they stand in.
KINDS = ("prose", "list", "table", "junk", "short", "long")


@dataclass
class Counts:
    """Additive statistics of a piece of text."""

    chars: int = 0
    words: int = 0
    word_chars: int = 0
    symbols: int = 0
    spaces: int = 0
    han: int = 0
    common: int = 0
    lines: int = 0
    punct_lines: int = 0
    ends: int = 0
    short_words: int = 0
    prose: int = 0
    list: int = 0
    table: int = 0
    junk: int = 0
    short: int = 0
    long: int = 0

    def add(self, other: Counts) -> None:
        mine = self.__dict__
        for name, value in other.__dict__.items():
            if value:
                mine[name] += value


_NAMES = tuple(f.name for f in fields(Counts))


class Judged:
    """A complete line, by its measures."""

    __slots__ = ()

    def judge(self, c: Counts) -> None:
        """Add the line's verdict to the counts of its document; its text is added elsewhere."""
        ended = self._ended()
        kind = self._kind(ended)
        c.lines += 1
        c.punct_lines += ended
        c.__dict__[kind] += self.chars - self.spaces
        if kind in ("short", "long", "prose"):
            c.ends += self.ends
            if kind == "short":
                c.short_words += self.words

    def _ended(self) -> bool:
        last = self.tail[-1:]
        return last in _ENDS or last in _CLOSERS and self.tail.rstrip(_CLOSERS).endswith(_END)

    def _kind(self, ended: bool) -> str:
        """The kind of a complete line. What costs time to measure is asked for last."""
        body = self.chars - self.spaces
        latin = self.words - self.han
        share = self.common / max(1, self.words)
        least = 0.02 if self.han > latin else 0.08
        if _LOG.match(self.head) and self.digits > 0.25 * body:
            return "junk"
        if self.tail[-1:].isdecimal() and _LEADER.search(self.tail):
            return "list"
        barred = self.head.startswith("|")
        if self.alnum < 0.2 * body:
            return "table" if barred else "junk"
        # symbols are among what is not alphanumeric
        if share < 0.2 and body - self.alnum > 0.3 * body and self.symbols > 0.3 * body or self.blob > 0.5 * body:
            return "table" if barred else "junk"
        if barred or self.tail.endswith("|") and self.cells > 1:
            return "table"
        if self.cells >= 2 and self.numeric_cells > 0.4 * (self.cells + 1) or share < least and self.tabs:
            return "table"
        if share < least and self.gaps >= 2 and (self.digits > 0.1 * body or self.gaps > 0.5 * self.words):
            return "table"
        if _BULLET.match(self.head):
            return "prose" if ended and (self.words > 7 and share > least) else "list"
        if not ended and self.words <= 12 + self.han * 0.6 and _PAIR.match(self.head):
            return "list"
        if ended and (share >= least or self.words < 12) and self.wordlike:
            return "prose"
        if self.han > latin:
            if self.words <= 12:
                return "short"
            return "long" if share >= 0.02 else "junk"
        if self.words <= 8:
            return "short"
        if share < 0.08 and self.chains >= 4 and self.chains > 0.3 * self.words:
            return "list"
        if share < 0.08 or self.voiced < 0.6 * self.words and self.digits < 0.2 * body:
            return "junk"
        return "long"


@dataclass
class Piece(Judged):
    """Summary of a stretch of one line, up to a cut or from one; ``merge`` is associative."""

    chars: int = 0
    words: int = 0
    word_chars: int = 0
    symbols: int = 0
    spaces: int = 0
    han: int = 0
    common: int = 0
    ends: int = 0
    cells: int = 0
    numeric_cells: int = 0
    gaps: int = 0
    tabs: int = 0
    chains: int = 0
    blob: int = 0
    voiced: int = 0
    wordlike: int = 0
    digits: int = 0
    alnum: int = 0
    #: the two ends without the white space outside them
    head: str = ""
    tail: str = ""
    #: the two ends as they stand
    left: str = ""
    right: str = ""

    @staticmethod
    def of(text: str, common: frozenset[str]) -> Piece:
        blanks = text.split()
        ascii_only = text.isascii()
        han = 0 if ascii_only else len(_HAN.findall(text))
        plain = blanks if not han else _HAN.sub(" ", text).split()
        solid = sum(map(len, blanks))
        p = Piece(chars=len(text), han=han, words=len(plain) + han, spaces=len(text) - solid)
        p.word_chars = (sum(map(len, plain)) + han) if han else solid
        tokens = _TOKEN.findall(text.lower())
        p.alnum = sum(map(len, tokens))
        p.common = sum(map(common.__contains__, tokens))
        if han:
            p.common += sum(map(text.count, _single(common))) - sum(map(_single(common).__contains__, tokens))
        if p.alnum + p.spaces < len(text):
            p.symbols = len(_SYMBOL.findall(text))
            p.ends = len(_SENTENCE_END.findall(text))
            p.cells = _cells(text)
            p.chains = len(_CHAIN.findall(text))
        if p.spaces > len(blanks) - 1 or "\t" in text:
            p.gaps = len(_GAPS.findall(text))
            if "\t" in text:
                p.tabs = len(_TABBED.findall(text))
                p.cells = p.cells or text.count("\t")
        p.numeric_cells = _numeric_cells(text)
        p.blob = sum(map(len, _BLOB.findall(text))) if solid > 27 and max(map(len, blanks)) > 27 else 0
        p.wordlike = sum(1 for t in tokens if len(t) > 1 and t.isalpha())
        p.voiced = len(_VOICED.findall(text))
        p.digits = sum(map(len, _DIGITS.findall(text)))
        p.head, p.tail = text.lstrip()[:EDGE], text.rstrip()[-EDGE:]
        p.left, p.right = text[:CONTEXT], text[-CONTEXT:]
        return p

    def merge(self, right: Piece, common: frozenset[str]) -> Piece:
        """The piece that ``right`` follows without a line break."""
        if not self.chars:
            return right
        if not right.chars:
            return self
        whole = Piece.of(self.right + right.left, common)
        parts = [Piece.of(x, common) for x in (self.right, right.left)]
        p = Piece(**{n: getattr(self, n) + getattr(right, n) + getattr(whole, n) - sum(getattr(x, n) for x in parts) for n in _ADDED})
        p.head = (self.head + right.left)[:EDGE] if self.head and len(self.head) < EDGE else self.head or right.head
        p.tail = (self.right + right.tail)[-EDGE:] if right.tail and len(right.tail) < EDGE else right.tail or self.tail
        p.left = (self.left + right.left)[:CONTEXT] if self.chars < CONTEXT else self.left
        p.right = (self.right + right.right)[-CONTEXT:] if right.chars < CONTEXT else right.right
        return p

    def counts(self) -> Counts:
        """What this line, now complete, adds to the document."""
        c = Counts(self.chars, self.words, self.word_chars, self.symbols, self.spaces, self.han, self.common)
        if self.chars > self.spaces:
            self.judge(c)
        return c


#: Counts of a piece; its other fields are text.
_ADDED = tuple(f.name for f in fields(Piece) if f.type == "int")


@lru_cache(maxsize=4)
def _single(common: frozenset[str]) -> frozenset[str]:
    return frozenset(w for w in common if len(w) == 1 and _HAN.match(w))


def _line_feeds(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _cells(text: str) -> int:
    return text.count(",") + text.count(";") + text.count("|") + text.count("\t")


def _numeric_cells(text: str) -> int:
    first = _FIRST_NUMBER_CELL.match(text)
    return len(_NUMBER_CELL.findall(text, first.end())) + 1 if first else len(_NUMBER_CELL.findall(text))


class Line(Judged):
    """A line without cuts. What is missing is measured when it is asked for."""

    __slots__ = ("text", "blanks", "tokens", "chars", "spaces", "words", "han", "common", "alnum", "head", "tail", "cells")

    def __init__(self, text: str, blanks: list[str], body: int, tokens: list[str], words: int, han: int, common: int):
        self.text, self.blanks, self.tokens = text, blanks, tokens
        self.chars, self.spaces, self.words, self.han, self.common = len(text), len(text) - body, words, han, common
        self.alnum = len("".join(tokens))
        self.head, self.tail = text.lstrip()[:EDGE], text.rstrip()[-EDGE:]
        self.cells = _cells(text)

    @property
    def symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @property
    def ends(self) -> int:
        return len(_SENTENCE_END.findall(self.text))

    @property
    def numeric_cells(self) -> int:
        return _numeric_cells(self.text)

    @property
    def gaps(self) -> int:
        return len(_GAPS.findall(self.text)) if self.spaces > len(self.blanks) - 1 or "\t" in self.text else 0

    @property
    def tabs(self) -> int:
        return len(_TABBED.findall(self.text)) if "\t" in self.text else 0

    @property
    def chains(self) -> int:
        return len(_CHAIN.findall(self.text))

    @property
    def blob(self) -> int:
        return sum(map(len, _BLOB.findall(self.text))) if self.chars - self.spaces > 27 and max(map(len, self.blanks)) > 27 else 0

    @property
    def voiced(self) -> int:
        return len(_VOICED.findall(self.text))

    @property
    def wordlike(self) -> bool:
        return any(len(t) > 1 and t.isalpha() for t in self.tokens)

    @property
    def digits(self) -> int:
        return sum(map(len, _DIGITS.findall(self.text)))


def count_lines(text: str, common: frozenset[str]) -> Counts:
    """The counts of complete lines, with the breaks (line feeds) between them."""
    c = Counts(chars=len(text))
    bare = None
    if text.isascii():
        low = text.translate(_LOW)
        c.symbols = len(text.translate(_ONLY_SYMBOLS))
    else:
        parts = _MARKS.split(text.lower())
        low = " ".join(parts[::2])
        c.symbols = len(_SYMBOL.findall("".join(parts[1::2])))
        if _HAN.search(text):
            bare = _HANS.sub(" ", text).split("\n")
            single = _single(common)
            common = common - single
    for n, (line, spaced) in enumerate(zip(text.split("\n"), low.split("\n"))):
        blanks = line.split()
        if not blanks:
            continue
        body, words, han = len("".join(blanks)), len(blanks), 0
        tokens = spaced.split()
        known = sum(map(common.__contains__, tokens))
        if bare is not None:
            rest = bare[n].split()
            han = body - len("".join(rest))
            words = len(rest) + han
            if han:
                known += sum(map(line.count, single))
        c.words += words
        c.word_chars += body
        c.han += han
        c.common += known
        Line(line, blanks, body, tokens, words, han, known).judge(c)
    c.spaces = c.chars - c.word_chars
    return c


@dataclass
class Chunk:
    """Summary of a stretch of a document: its complete lines, and the pieces before the first and after the last break."""

    counts: Counts = field(default_factory=Counts)
    broken: bool = False
    before: Piece = field(default_factory=Piece)
    after: Piece = field(default_factory=Piece)

    @staticmethod
    def of(text: str, common: frozenset[str]) -> Chunk:
        text = _line_feeds(text)
        first, last = text.find("\n"), text.rfind("\n")
        if first < 0:
            return Chunk(before=Piece.of(text, common))
        return Chunk(count_lines(text[first : last + 1], common), True, Piece.of(text[:first], common), Piece.of(text[last + 1 :], common))

    def merge(self, right: Chunk, common: frozenset[str]) -> Chunk:
        """The stretch that ``right`` follows directly."""
        out = Chunk(broken=self.broken or right.broken)
        out.counts.add(self.counts)
        out.counts.add(right.counts)
        if not self.broken:
            out.before, out.after = self.before.merge(right.before, common), right.after
        elif not right.broken:
            out.before, out.after = self.before, self.after.merge(right.before, common)
        else:
            out.before, out.after = self.before, right.after
            out.counts.add(self.after.merge(right.before, common).counts())
        return out

    def total(self) -> Counts:
        out = Counts()
        for c in (self.counts, self.before.counts(), self.after.counts()):
            out.add(c)
        return out


_STATS = ", ".join(f"`{n}` bigint" for n in _NAMES)


def text_counts(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row of `Counts` for each row of ``df``, keyed ``doc_id``; a null text counts as an empty one.

    Every row gives a row, also one with a null or a repeated id, whatever its length. Line ends of any kind count as
    breaks. Extra columns are not read.
    """
    small_batches(df.sparkSession)
    words = [r[0] for r in common_words.where(F.col("word").isNotNull()).select("word").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    common = frozenset(w.lower() for w in words)
    plain = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_lines(_line_feeds(t), common) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([getattr(r, n) for r in rows], pa.int64()) for n in _NAMES]], ["doc_id", *_NAMES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                # a cut between the two halves of a CR LF would make two breaks of one, so it is normalised first
                text = _line_feeds(text)
                parts = range(0, len(text), chunk)
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    columns = [[row] * len(some), [i] * len(some), list(range(k, k + len(some))), [text[at : at + chunk] for at in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["row", "doc_id", "n", "text"])

    def pieces(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "n": pdf["n"], "state": [pickle.dumps(Chunk.of(t, common)) for t in pdf["text"]]})

    def fold(states: Iterable[bytes]) -> Chunk:
        out: Chunk | None = None
        for state in states:
            part = pickle.loads(state)
            out = part if out is None else out.merge(part, common)
        return out

    def branch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "doc_id": pdf["doc_id"].iloc[:1].astype("Int64"), "n": pdf["n"].iloc[:1] // FANIN, "state": [pickle.dumps(fold(pdf["state"]))]})

    def finish(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [pickle.loads(x).total() for x in pdf["state"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **{n: [getattr(r, n) for r in rows] for n in _NAMES}})

    fits = F.length("text") <= chunk
    short = plain.where(fits).mapInArrow(whole, f"doc_id bigint, {_STATS}")
    # a row's number among the input's rows keeps the chunks of a text together, whatever its id
    long = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(~fits).mapInArrow(cut, "row bigint, doc_id bigint, n int, text string")
    states = long.repartition("row", "n").mapInPandas(pieces, "row bigint, doc_id bigint, n int, state binary")
    # three levels of 64 branches hold more chunks than the longest string of a table has
    for _ in range(3):
        states = states.groupBy("row", F.expr(f"n div {FANIN}").alias("run")).applyInPandas(branch, "row bigint, doc_id bigint, n int, state binary")
    return short.unionByName(states.mapInPandas(finish, f"doc_id bigint, {_STATS}"))


def _share(part: Column | str, whole: Column | str) -> Column:
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_statistics(counts: DataFrame) -> DataFrame:
    """Ratios and verdict of each row of `text_counts`; documents are told apart by id, of the deliveries of one id the
    longest counts. Rows without an id stay apart.

    ``kind`` is ``blank``, ``prose``, ``list``, ``table`` or ``junk``: what fills more than half of the body. Plain lines
    without an end mark are prose when they are long, or when the document ends sentences often enough for its short
    lines to be broken prose rather than headings.
    """
    body = F.col("chars") - F.col("spaces")
    broken = F.col("short_words") <= F.when(F.col("han") * 2 > F.col("words"), 60).otherwise(40) * F.greatest(F.col("ends"), F.lit(0))
    prose = F.col("prose") + F.col("long") + F.when(broken, F.col("short")).otherwise(0)
    listed = F.col("list") + F.when(broken, 0).otherwise(F.col("short"))
    # a lone short line is a short text, not a list
    tiny = (F.col("lines") <= 3) & (F.col("list") + F.col("table") + F.col("junk") == 0)
    odd = listed + F.col("table") + F.col("junk")
    kind = F.when(body == 0, "blank").when(tiny | (prose >= odd), "prose").when((listed >= F.col("table")) & (listed >= F.col("junk")), "list").when(F.col("table") >= F.col("junk"), "table").otherwise("junk")
    out = counts.select(
        "doc_id",
        "chars",
        "words",
        "lines",
        F.round(_share("word_chars", "words"), 6).alias("mean_word_len"),
        F.round(_share("symbols", body), 6).alias("symbol_share"),
        F.round(_share("punct_lines", "lines"), 6).alias("punct_line_share"),
        F.round(_share("common", "words"), 6).alias("common_word_share"),
        F.round(_share(prose, body), 6).alias("prose_share"),
        F.round(_share(listed, body), 6).alias("list_share"),
        F.round(_share("table", body), 6).alias("table_share"),
        F.round(_share("junk", body), 6).alias("junk_share"),
        kind.alias("kind"),
    )
    values = [c for c in out.columns if c != "doc_id"]
    # a row without an id is a group of its own, in the same pass as the others
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return out.withColumn("own", own).groupBy("doc_id", "own").agg(F.max(F.struct(*values)).alias("s")).select("doc_id", "s.*")


def not_prose(stats: DataFrame) -> DataFrame:
    """The documents whose body is a list, a table or junk."""
    return stats.where(F.col("kind").isin("list", "table", "junk")).select("doc_id")
