"""Contamination by weighted n-grams: an evaluation index, generic n-grams taken out, hits in order of appearance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainloom.functions import text as T


def grams(text: Column | str, compatibility: bool = True) -> Column:
    """The thirteen-word windows of a text, in order."""
    return T.weighted_windows(T.units(T.normalize(text, compatibility)))


def unit_weight(text: Column | str, compatibility: bool = True) -> Column:
    """Words of a text, a Han character counting half."""
    half = F.transform(T.units(T.normalize(text, compatibility)), lambda u: F.when(u.rlike(f"^{T.HAN}$"), 0.5).otherwise(1.0))
    return F.aggregate(half, F.lit(0.0), lambda a, x: a + x)


def eval_index(items: DataFrame, compatibility: bool = True) -> DataFrame:
    """``gram, bench``: each window with the bench it is first met in, benches in order of name, items of id."""
    long = items.where("text IS NOT NULL").select("bench", "item_id", F.explode(grams("text", compatibility)).alias("gram"))
    return long.groupBy("gram").agg(F.min_by("bench", F.struct("bench", "item_id")).alias("bench"))


def item_counts(items: DataFrame, compatibility: bool = True, weight: float = 13.0) -> DataFrame:
    """Items and too short items of each bench; a null text is too short."""
    w = F.coalesce(unit_weight(F.coalesce("text", F.lit("")), compatibility), F.lit(0.0))
    return items.groupBy("bench").agg(F.count("*").alias("items"), F.count_if(w < weight).alias("too_short"))


def without_generic(index: DataFrame, exclude: DataFrame) -> DataFrame:
    """The index without the windows of the exclude list."""
    return index.join(exclude.select(F.col("ngram").alias("gram")).distinct(), "gram", "left_anti")


#: Bits of the filter that windows pass before they are joined: 8 MB, however large the index.
FILTER_BITS = 26

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_ONE_HAN, _UNIT = re.compile(f"[{_HAN}]"), re.compile(f"[{_HAN}]|[^\\s{_HAN}]+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class WindowValues:
    """64-bit values of the weighted windows of texts. Units are hashed once a worker; a window's value comes from two
    running sums, so windows cost the same however long they are."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def _sums(self, units: list[str]) -> np.ndarray:
        memo = self._memo
        if len(memo) > 1_000_000:
            memo.clear()
        for u in set(units) - memo.keys():
            memo[u] = xxhash.xxh64_intdigest(u)
        values = np.fromiter(map(memo.__getitem__, units), dtype=np.uint64, count=len(units))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_STEP, len(units))[:-1], dtype=np.uint64)])

    def of_gram(self, gram: str) -> int:
        """The value of a whole window."""
        return int(self._sums(gram.split(" "))[-1])

    def windows(self, normalized: str, weight: float = 13.0) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units of a text, and the end and value of the window from each unit on that has one."""
        units = _UNIT.findall(normalized) if _ONE_HAN.search(normalized) else normalized.split()
        half = np.fromiter((1 if len(u) == 1 and _ONE_HAN.match(u) else 2 for u in units), dtype=np.int64, count=len(units))
        ahead = np.concatenate([[0], np.cumsum(half)])
        ends = np.searchsorted(ahead, ahead[:-1] + round(2 * weight))
        ends = ends[ends <= len(units)]
        sums = self._sums(units)
        return units, ends, (sums[ends] - sums[: len(ends)]) * _powers(_BACK, len(ends))[: len(ends)]


def _filter_of(index: DataFrame) -> Broadcast:
    """A broadcast bitmap of the slots of the index's windows; 2^FILTER_BITS bits at most reach the driver, as words."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WindowValues()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([made.of_gram(g) >> (64 - FILTER_BITS) for g in batch.column(0).to_pylist()], pa.int64())], ["slot"])

    slot = index.select("gram").mapInArrow(slots, "slot bigint").distinct()
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    packed = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    packed[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return index.sparkSession.sparkContext.broadcast(packed.view(np.uint8))


def met_windows(docs: DataFrame, index: DataFrame, keys: list[str], compatibility: bool = True) -> DataFrame:
    """``keys, pos, gram, bench``: the windows of the texts that the index has, with their places.

    A narrow stage hashes all windows and lets those through whose slot the index holds, so the join that decides
    sees little more than true matches, and no window of a clean text is ever made, shuffled or compared.
    """
    bitmap = _filter_of(index)
    plain = docs.where("text IS NOT NULL").select(*keys, T.normalize("text", compatibility).alias("__n"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = WindowValues(), bitmap.value
        for batch in batches:
            rows, places, grams = [], [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                units, ends, values = made.windows(text)
                slot = (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                for at in np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).tolist():
                    rows.append(row)
                    places.append(at)
                    grams.append(" ".join(units[at : ends[at]]))
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(places, pa.int32()), pa.array(grams, pa.string())], [*keys, "pos", "gram"])

    return plain.mapInArrow(look, f"{kept}, pos int, gram string").join(index, "gram")


def hits(docs: DataFrame, index: DataFrame, key: str = "doc_id", compatibility: bool = True) -> DataFrame:
    """``key, gram, bench, pos``: the distinct windows of each document that the index has, with their first place."""
    return met_windows(docs, index, [key], compatibility).groupBy(key, "gram", "bench").agg(F.min("pos").alias("pos"))


def contaminated(docs: DataFrame, index: DataFrame, key: str = "doc_id", compatibility: bool = True) -> DataFrame:
    """``key, bench`` of each contaminated document: the bench of its first matching window."""
    return hits(docs, index, key, compatibility).groupBy(key).agg(F.min_by("bench", F.col("pos")).alias("bench"))


def generic_grams(docs: DataFrame, index: DataFrame, key: str = "doc_id", least: int = 3, compatibility: bool = True) -> DataFrame:
    """``gram, bench, n``: windows of the index that many blocks of a reference corpus hold (blocks part at blank lines)."""
    blocks = docs.where("text IS NOT NULL").select(key, F.posexplode(F.split("text", "\n{2,}")).alias("block", "text"))
    found = met_windows(blocks, index, [key, "block"], compatibility).select(key, "block", "gram", "bench").distinct()
    return found.groupBy("gram", "bench").agg(F.count("*").alias("n")).where(F.col("n") >= least)
