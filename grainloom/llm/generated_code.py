"""Generated, minified, vendored and pure-data files among source code (problem 4).

One narrow stage reads each file once: a multi-pattern automaton finds generation and upstream notices in its comments,
path rules look for vendored directories, lockfiles and minified suffixes, and the body's shape shows packed code, data
and accessors written by a machine. Paths are a hint only: a suffix counts when the body agrees. Copies of third-party
libraries without notice or path are found by the lines they share with files that have one: line fingerprints of those
libraries are joined to the other files' lines, and the share of a file's telling lines is thresholded.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainloom.llm.common import map_batches, shared_checkpoint, small_batches

#: Share of a file's telling lines, and their least number, that make it a copy of a library.
COPIED, TELLING_LINES = 0.5, 4

#: A library line tells when it is at most so many times (and so many files) more frequent outside known copies.
COMMON_TIMES, COMMON_FILES = 3, 3

#: Lines that are looked up by broadcast at most, the most frequent ones of all code.
MOST_HOT_LINES = 10_000

#: Words that may stand before a phrase that opens a comment.
MOST_BEFORE = 4

#: Phrases of generation notices. Strong ones suffice where they open a comment or stand in one beside
#: another phrase; weak ones also occur in ordinary remarks and need a second phrase.
STRONG = (
    "code generated by", "@generated", "autogenerated file", "autogenerated by", "autogenerated on", "autogenerated from",
    "auto-generated by", "auto-generated file", "auto-generated from", "auto-generated on", "automatically generated",
    "<auto-generated", "<autogenerated", "machine generated", "machine-generated", "machine written", "this file is generated",
    "this file was generated", "generated file", "do not modify: built from", "自动生成", "自動生成", "do not edit directly",
)
WEAK = (
    "generated by", "generated from", "do not edit", "do not modify", "don't edit", "source of truth", "regenerate with",
    "changes will be lost", "edits are overwritten", "edits will be overwritten", "manual edits", "hand changes go to",
    "created with", "produced by", "built from", "auto-generated", "autogenerated", "请勿手动修改", "请勿修改", "請勿修改",
    "overwritten",
)
UPSTREAM = (
    "@license", "@preserve", "see upstream", "upstream release", "bundled copy", "vendored from", "vendored copy",
    "third-party", "third party", "released under the", "licensed under the", "distributed under the", "permission is hereby granted",
    "redistribution and use in source", "the authors, released",
)

_VENDORED = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|node_modules|bower_components|third_party|third-party|thirdparty|3rdparty|deps|ext|extern|external|externals|site-packages|Pods|Godeps)/", re.I)
_LOCKFILE = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock|flake\.lock)$", re.I)
_MINIFIED = re.compile(r"[.-](?:min|pack|bundle|prod)\.[a-z]+$", re.I)
_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|--+|/\*+!?|\*+|<!--+|;+|%+|\"\"\"|''')\s*(.*)$")
_QUOTED = re.compile(r"'[^'\n]{3,60}'|\"[^\"\n]{3,60}\"|`[^`\n]{3,60}`")
_PACKED = re.compile(r"eval\(function\(p,a,c,k|eval\(atob\(|\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){15}")
_TIGHT = re.compile(r"[{}();,:=?!&|\[\]]")
_NUMBERISH = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z%]{0,2}\s*[,;\s\])}]\s*)+|(?:\"[^\"\n]{0,80}\"|'[^'\n]{0,80}')\s*[:,]\s*")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{48,}")
_INSERT = re.compile(r"^\s*(?:INSERT\s+INTO\b.*\bVALUES\b|\()", re.I)
_CSV = re.compile(r"^[^,;(){}=<>#]*(?:,[^,;(){}=<>#]*){2,}$|^[^\t]*(?:\t[^\t]*){2,}$")
_COUNTER = re.compile(r"(?<![\d.])(\d{1,6})(?![\d.])")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("strong", STRONG), ("weak", WEAK), ("upstream", UPSTREAM)):
        for phrase in phrases:
            a.add_word(phrase, (kind, phrase))
    a.make_automaton()
    return a


def notices(text: str) -> tuple[bool, bool]:
    """Whether comments of the text say that a tool wrote it, and that it comes from upstream."""
    low = text.lower()
    hits = list(_automaton().iter(low))
    generated = upstream = False
    lines: dict[int, list[tuple[str, str, int]]] = {}
    for end, (kind, phrase) in hits:
        begin = low.rfind("\n", 0, end - len(phrase) + 1) + 1
        lines.setdefault(begin, []).append((kind, phrase, end - len(phrase) + 1 - begin))
    for begin, found in lines.items():
        stop = low.find("\n", begin)
        line = low[begin : stop if stop >= 0 else len(low)]
        comment = _COMMENT.match(line)
        if not comment:
            continue
        # packed code may follow on the line behind the comment's end
        closed = line.find("*/") if line.lstrip().startswith("/*") else -1
        line = line[:closed] if closed >= 0 else line
        found = [x for x in found if x[2] < len(line)]
        quoted = [m.span() for m in _QUOTED.finditer(line)]
        said = {(k, p, at) for k, p, at in found if not any(a <= at < b for a, b in quoted)}
        kinds = [k for k, _, _ in said]
        distinct = {p for k, p, _ in said if k != "upstream" and not any(p != q and p in q for _, q, _ in said)}
        opens = any(k == "strong" and len(line[comment.start(1) : at].split()) <= MOST_BEFORE for k, p, at in said)
        generated |= opens or len(distinct) >= 2
        upstream |= kinds.count("upstream") >= 2 or any(k == "upstream" and p in ("@license", "@preserve", "permission is hereby granted", "redistribution and use in source", "bundled copy", "upstream release", "released under the") for k, p, _ in said)
    return generated, upstream


def _sequence_share(lines: list[str]) -> float:
    """Share of the lines that carry a counter running 0, 1, 2, ... through the file."""
    want, covered, n = 0, 0, 0
    for line in lines:
        numbers = {int(x) for x in _COUNTER.findall(line.replace("_", " "))}
        numbers |= {int(x) for x in re.findall(r"[A-Za-z](\d{1,6})\b", line)}
        if want in numbers:
            want, n = want + 1, n + 1
            covered += 1
        elif n and want - 1 in numbers:
            covered += 1
    return covered / max(1, len(lines)) if n >= 5 else 0.0


def body_kind(text: str) -> str | None:
    """``minified``, ``data`` or ``accessors`` from the shape of the body, else null."""
    lines = [x for x in text.splitlines() if x.strip()]
    code = [x for x in lines if not _COMMENT.match(x) or x.lstrip()[:1] in "#*" and "{" in x] or lines
    body = sum(map(len, code))
    if not body:
        return None
    if _PACKED.search(text):
        return "minified"
    long = [x for x in code if len(x) > 160]
    dense = sum(len(x) for x in long if sum(map(x.count, " \t")) < 0.12 * len(x) and len(_TIGHT.findall(x)) > 0.12 * len(x))
    numeric = sum(len(m.group()) for x in code for m in _NUMBERISH.finditer(x))
    if numeric > 0.6 * body and len(code) + body // 80 >= 5:
        return "data"
    if dense > 0.5 * body:
        return "minified"
    if sum(len(b) for b in _BLOB.findall(text)) > 0.6 * body:
        return "data"
    if len(code) >= 5:
        if sum(1 for x in code if _INSERT.match(x)) >= 0.8 * len(code) and numeric > 0:
            return "data"
        if sum(1 for x in code if _CSV.match(x)) >= 0.9 * len(code):
            return "data"
        if _sequence_share(code) >= 0.45:
            return "accessors"
    return None


def line_prints(text: str) -> list[int]:
    """Fingerprints of a file's distinct lines of some length, whatever their white space and line ends."""
    out = set()
    for line in text.splitlines():
        plain = _SPACE.sub("", line)
        if len(plain) >= 12:
            out.add(xxhash.xxh64_intdigest(plain) - (1 << 63))
    return sorted(out)


def classify_files(code: DataFrame, file_id: str = "file_id", path: str = "path", text: str = "code") -> DataFrame:
    """``file_id``, ``kind`` (generated, minified, data, vendored; null for the rest) and line ``prints`` of each row.

    A null, empty or blank text has no kind, whatever its path. A null path is no hint. Repeated rows stay repeated.
    """
    small_batches(code.sparkSession)
    plain = code.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("code"))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, prints = [], []
        for where, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kind = None
            if body and not body.isspace():
                generated, upstream = notices(body)
                where = where or ""
                shape = body_kind(body)
                if generated or _LOCKFILE.search(where) or shape == "accessors":
                    kind = "generated"
                elif upstream or _VENDORED.search(where):
                    kind = "vendored"
                elif shape:
                    kind = shape
                elif _MINIFIED.search(where) and max(map(len, body.splitlines())) > 400:
                    kind = "minified"
            kinds.append(kind)
            prints.append(line_prints(body) if body and kind in (None, "vendored") else [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(prints, pa.list_(pa.int64()))], ["file_id", "kind", "prints"])

    return map_batches(plain, look, "file_id bigint, kind string, prints array<bigint>")


def _by_telling_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """``file_id`` of the unmarked files of which half the lines are of marked ones, those of ordinary code left out."""
    told = lines.groupBy("line").agg(F.count_if("marked").alias("inside"), F.count_if(~F.col("marked")).alias("outside"))
    library = told.where((F.col("inside") > 0) & (F.col("outside") <= COMMON_TIMES * F.col("inside") + COMMON_FILES)).select("line", F.lit(1).alias("known"))
    # lines of ordinary code found in many files tell nothing about any one of them
    ordinary = told.where((F.col("inside") > 0) & (F.col("outside") > COMMON_TIMES * F.col("inside") + COMMON_FILES)).select("line", F.lit(0).alias("known"))
    # a line with a ten-thousandth of all occurrences or more: there are at most so many, so they are joined by broadcast
    table = told.select("line", (F.col("inside") + F.col("outside")).alias("times")).join(library.unionByName(ordinary), "line")
    least = 1 + lines.count() // MOST_HOT_LINES
    mine = lines.where("NOT marked").select("file_id", "line")
    hot = table.where(F.col("times") >= least).select("line", "known")
    rest = mine.join(F.broadcast(hot.select("line")), "line", "left_anti").join(table.where(F.col("times") < least).select("line", "known"), "line")
    shared = mine.join(F.broadcast(hot), "line").unionByName(rest).groupBy("file_id").agg(F.sum("known").alias("hits"), F.count_if(F.col("known") == 0).alias("common"))
    return shared.join(sizes, "file_id").where((F.col("hits") >= TELLING_LINES) & (F.col("hits") >= COPIED * (F.col("n") - F.col("common")))).select("file_id")


def _agree(pairs: DataFrame, held: DataFrame, models: DataFrame) -> DataFrame:
    """``file_id`` of the ``pairs`` of a file and a model that have half the lines, of both, in common; ``held`` is
    ``file_id, a`` and ``models`` is ``model, b``."""
    common = F.size(F.array_intersect("a", "b"))
    both = pairs.join(held, "file_id").join(models, "model")
    return both.where((common >= TELLING_LINES) & (common >= COPIED * F.greatest(F.size("a"), F.size("b")))).select("file_id").distinct()


def _rare_lines(sets: DataFrame, key: str, df: DataFrame) -> DataFrame:
    """``key, line, size, at``: of each set of lines the rarest, by ``df``, among which one is shared with every set that
    has half the lines in common; ``at`` is a line's place in the order from rare to frequent."""
    order = Window.partitionBy(key).orderBy("df", "line")
    placed = sets.select(key, F.size("set").alias("size"), F.explode("set").alias("line")).join(df, "line").withColumn("at", F.row_number().over(order))
    return placed.where(F.col("at") <= F.col("size") - F.ceil(F.lit(COPIED) * F.col("size")) + 1).drop("df")


def _whole_copies(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """``file_id`` of the candidates that share half the lines, of both, with one marked file, however many copies there are.

    A line leads to the first marked file that has it, so copies are never paired with each other; lines of one library
    mostly lead to one file. What that leaves is compared with all marked files: files of the same lines count once, only
    files of which half the lines are of marked ones at all can agree, and two sets that do share one of the rarest lines of
    each (prefix filtering), at places that leave enough lines behind them.
    """
    marked = lines.where("marked").select("file_id", "line")
    first = marked.groupBy("line").agg(F.min("file_id").alias("model"))
    led = shared_checkpoint(candidates.select("file_id", "line").join(first, "line").select("file_id", "model"))
    pairs = led.distinct()
    held = candidates.groupBy("file_id").agg(F.array_sort(F.collect_set("line")).alias("a"))
    models = marked.join(pairs.select(F.col("model").alias("file_id")).distinct(), "file_id").groupBy("file_id").agg(F.collect_set("line").alias("b"))
    found = shared_checkpoint(_agree(pairs, held, models.withColumnRenamed("file_id", "model")))

    known = led.groupBy("file_id").agg(F.count("*").alias("known"))
    open_ = held.join(found, "file_id", "left_anti").join(known, "file_id").where((F.col("known") >= TELLING_LINES) & (F.col("known") >= COPIED * F.size("a")))
    open_ = shared_checkpoint(open_.select("file_id", "a"))
    if open_.isEmpty():
        return found
    mine = shared_checkpoint(open_.groupBy(F.col("a").alias("set")).agg(F.min("file_id").alias("one")))
    theirs = marked.groupBy("file_id").agg(F.array_sort(F.collect_set("line")).alias("set")).where(F.size("set") >= TELLING_LINES)
    theirs = shared_checkpoint(theirs.groupBy("set").agg(F.min("file_id").alias("model")))
    df = mine.select("set").unionByName(theirs.select("set")).select(F.explode("set").alias("line")).groupBy("line").agg(F.count("*").alias("df"))
    x, y = _rare_lines(mine, "one", df).alias("x"), _rare_lines(theirs, "model", df).alias("y")
    most = F.greatest("x.size", "y.size")
    # shared at most: all before this line in the shorter stretch, the line, and all behind it in the shorter rest
    reach = F.least("x.at", "y.at") + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    fits = (F.least("x.size", "y.size") >= F.lit(COPIED) * most) & (reach >= F.lit(COPIED) * most)
    met = x.join(y, (F.col("x.line") == F.col("y.line")) & fits).select(F.col("x.one").alias("file_id"), F.col("y.model").alias("model")).distinct()
    agreed = _agree(met, mine.select(F.col("one").alias("file_id"), F.col("set").alias("a")), theirs.select("model", F.col("set").alias("b")))
    sets = mine.join(agreed.withColumnRenamed("file_id", "one"), "one").select(F.col("set").alias("a"))
    return found.unionByName(open_.join(sets, "a").select("file_id"))


def not_hand_written(code: DataFrame, file_id: str = "file_id", path: str = "path", text: str = "code") -> DataFrame:
    """One row ``(file_id, kind)`` for each file that is not hand-written source.

    Besides the kinds of `classify_files` this finds unmarked, also slightly changed, copies of the libraries that other
    files are marked copies of. Null ids are left out, repeated rows count once (should their contents differ, any kind
    found counts, the alphabetically first), an empty table gives an empty result.
    """
    files = shared_checkpoint(classify_files(code, file_id, path, text).where("file_id IS NOT NULL"))
    lines = files.where("kind = 'vendored' OR kind IS NULL").select("file_id", F.col("kind").isNotNull().alias("marked"), F.explode("prints").alias("line")).distinct()
    lines = shared_checkpoint(lines)
    sizes = files.where("kind IS NULL").groupBy("file_id").agg(F.max(F.size("prints")).alias("n"))
    copies = shared_checkpoint(_by_telling_lines(lines, sizes))
    # a library with many unmarked copies has no rare lines: its copies are those that agree with one marked file as a whole
    whole = shared_checkpoint(_whole_copies(lines, lines.where("NOT marked").join(copies.select("file_id"), "file_id", "left_anti")))
    # without them its lines tell again, also in files that hold but a part of it
    rest = lines.join(whole, "file_id", "left_anti").unionByName(lines.where("marked").join(whole, "file_id", "left_semi"))
    parts = _by_telling_lines(rest, sizes)
    copies = copies.unionByName(whole).unionByName(parts).distinct().select("file_id", F.lit("vendored").alias("kind"))
    return files.where("kind IS NOT NULL").select("file_id", "kind").unionByName(copies).groupBy("file_id").agg(F.min("kind").alias("kind"))
