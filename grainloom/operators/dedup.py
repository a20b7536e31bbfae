"""Near duplicates: shingles, MinHash signatures, banded LSH with verification, connected components; exact truth."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType

from grainloom.functions import text as T
from grainloom.operators.lineage import shared_checkpoint, shuffles_dropped

#: Permutations, bands, and the similarity from which two documents count as alike. Buckets larger than `STAR` are
#: joined to their first member only; links that this star misses are found by `links_across`.
PERMUTATIONS, BANDS, ALIKE, STAR = 256, 32, 0.8, 32

_MERSENNE = (1 << 61) - 1


def coefficients(permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family, the same in every process."""
    rng = np.random.default_rng(1)
    return rng.integers(1, 1 << 32, permutations, dtype=np.uint64), rng.integers(0, 1 << 32, permutations, dtype=np.uint64)


def with_shingles(df: DataFrame, normalized: str, out: str = "shingles", n: int = 5, by_char: bool | Column = False) -> DataFrame:
    """``df`` with the distinct runs of ``n`` words of a normalised text, or of ``n`` characters without the blanks; a
    shorter text is one shingle, an empty one the empty shingle. ``by_char`` may be a condition on each row."""
    chars, words = F.split(F.replace(F.col(normalized), F.lit(" "), F.lit("")), ""), F.split(normalized, " ")
    if isinstance(by_char, Column):
        split = df.withColumn("__by_char", F.coalesce(by_char, F.lit(False))).withColumn("__tokens", F.when(F.col("__by_char"), chars).otherwise(words))
        runs = F.when(F.col("__by_char"), T.word_windows("__tokens", n, "")).otherwise(T.word_windows("__tokens", n, " "))
        return split.withColumn(out, F.array_distinct(runs)).drop("__tokens", "__by_char")
    tokens = chars if by_char else words
    # the tokens are a column of their own, else every run would split the text again
    return df.withColumn("__tokens", tokens).withColumn(out, F.array_distinct(T.word_windows("__tokens", n, "" if by_char else " "))).drop("__tokens")


def chinese(subset: str | None) -> Column:
    """Whether a row's subset begins with zh: a word there is a whole clause, so its texts are compared by characters."""
    return F.coalesce(F.col(subset).startswith("zh"), F.lit(False)) if subset else F.lit(False)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def base_hash(shingle: Column, kind: str = "crc32") -> Column:
    """32-bit value of a shingle: its CRC-32, or the first eight hexadecimal digits of its MD5."""
    return F.crc32(shingle) if kind == "crc32" else F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("bigint")


#: Values of a shingle's bytes outside SQL: the two base hashes, and a 64-bit one for exact comparison.
_VALUES: dict[str, Callable[[bytes], int]] = {"crc32": zlib.crc32, "md5": lambda x: int.from_bytes(hashlib.md5(x).digest()[:4], "big"), "exact": xxhash.xxh64_intdigest}


def _places(normalized: str, by_char: bool, n: int = 5) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a text, and where in these the runs that `with_shingles` makes begin and end, repeats included."""
    data = (normalized.replace(" ", "") if by_char else normalized).encode()
    raw = np.frombuffer(data, np.uint8)
    if by_char:
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        ends = np.append(starts[1:], len(raw))
    else:
        blanks = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], blanks + 1]), np.append(blanks, len(raw))
    if len(starts) > n:
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    else:
        starts, ends = np.zeros(1, np.int64), np.array([len(raw)])
    return data, starts, ends


def _runs(normalized: str, by_char: bool, n: int = 5) -> tuple[bytes, list[int], list[int]]:
    """`_places` as lists."""
    data, starts, ends = _places(normalized, by_char, n)
    return data, starts.tolist(), ends.tolist()


def shingle_values(normalized: str, by_char: bool, kind: str, n: int = 5) -> np.ndarray:
    """The values of the runs that `with_shingles` makes, repeats included. A run is a stretch of the text's bytes."""
    data, starts, ends = _runs(normalized, by_char, n)
    value = _VALUES[kind]
    return np.fromiter((value(data[a:b]) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))


#: Rows of shingles in a batch, but for those of one text.
_SHINGLE_ROWS = 1 << 16


def shingle_rows(normalized: DataFrame, n: int = 5) -> DataFrame:
    """``doc_rank, shingle``: a row for each distinct shingle (`with_shingles`) of ``doc_rank, n, zh``, those of zh by
    characters. A narrow stage that holds a text's shingles at a time, and a batch of rows."""

    def made(ranks: list[int], counts: list[int], flat: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ranks, np.int64), counts)), pa.array(flat, pa.binary()).view(pa.string())], ["doc_rank", "shingle"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, counts, flat = [], [], []
            for rank, text, zh in zip(*(c.to_pylist() for c in batch.columns)):
                data, starts, ends = _runs(text, zh, n)
                own = dict.fromkeys(data[a:b] for a, b in zip(starts, ends))
                ranks.append(rank)
                counts.append(len(own))
                flat += own
                if len(flat) >= _SHINGLE_ROWS:
                    yield made(ranks, counts, flat)
                    ranks, counts, flat = [], [], []
            if flat:
                yield made(ranks, counts, flat)

    return normalized.select(F.col("doc_rank").cast("bigint"), "n", "zh").mapInArrow(rows, "doc_rank bigint, shingle string")


#: Shingles hashed at a time; with all permutations their values fit a core's cache.
_AT_ONCE = 1024


def sign_values(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signatures of the sets ``values[offsets[i]:offsets[i + 1]]``, none of them empty, as rows.

    The values of all sets lie one after the other and are hashed in blocks that do not care where a set ends; minima
    are then taken over the sets' stretches of a block, so short sets cost no loop and long ones no memory.
    """
    a, b = coefficients()
    prime, low = np.uint64(_MERSENNE), np.uint64(0xFFFFFFFF)
    out = np.full((len(offsets) - 1, len(a)), low, dtype=np.uint64)
    for at in range(0, len(values), _AT_ONCE):
        block = values[at : at + _AT_ONCE]
        sets = np.arange(np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + len(block), "left"))
        hashed = np.multiply.outer(a, block)
        hashed += b[:, None]
        # the remainder by 2^61 - 1: what is above 61 bits is added to what is below
        high = hashed >> np.uint64(61)
        hashed &= prime
        hashed += high
        np.subtract(hashed, prime, out=hashed, where=hashed >= prime)
        hashed &= low
        least = np.minimum.reduceat(hashed, np.maximum(offsets[sets] - at, 0), axis=1)
        out[sets] = np.minimum(out[sets], least.T)
    return out.astype(np.uint32)


def sign_texts(normalized: DataFrame, kind: str = "crc32") -> DataFrame:
    """``doc_rank, text_key, sig, keys`` of ``doc_rank, n, zh``: a key of the normalised text, its signature (32-bit values,
    four bytes each) and the keys of its bands. A narrow stage: no text is shuffled.
    """
    rows = 4 * PERMUTATIONS // BANDS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, zh = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            place: dict[tuple[str, bool], int] = {}
            which = [place.setdefault(x, len(place)) for x in zip(texts, zh)]
            sets = [shingle_values(t, z, kind) for t, z in place]
            sigs = [x.tobytes() for x in sign_values(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))]
            keys = [[xxhash.xxh64_intdigest(x[k : k + rows]) - (1 << 63) for k in range(0, len(x), rows)] for x in sigs]
            names = [hashlib.md5(t.encode()).hexdigest() for t, _ in place]
            columns = [pa.array([made[w] for w in which], kind_) for made, kind_ in ((names, pa.string()), (sigs, pa.binary()), (keys, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_rank", "text_key", "sig", "keys"])

    plain = normalized.select(F.col("doc_rank").cast("bigint"), "n", "zh")
    return plain.mapInArrow(sign, "doc_rank bigint, text_key string, sig binary, keys array<bigint>")


@F.pandas_udf(ArrayType(LongType()))
def signature_values(sigs: pd.Series) -> pd.Series:
    """The 32-bit values of signatures."""
    return sigs.map(lambda x: np.frombuffer(x, np.uint32).astype(np.int64))


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


def candidate_probability(j: Column, bands: int = BANDS, rows: int = PERMUTATIONS // BANDS) -> Column:
    """Chance that two sets of similarity ``j`` meet in a bucket."""
    return 1 - F.pow(1 - F.pow(j, F.lit(float(rows))), F.lit(float(bands)))


def bands(signed: DataFrame) -> DataFrame:
    """``band, key, doc_rank``: one row for each document and band; the key stands for the band's values."""
    return signed.select("doc_rank", F.posexplode("keys").alias("band", "key")).select("band", "key", "doc_rank")


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` that share a bucket: all pairs of small buckets, each member with the first of large ones.

    A bucket of copies, however large, gives one pair a member, so no bucket is ever squared.
    """
    bucket = Window.partitionBy("band", "key")
    members = banded.select("*", F.count("*").over(bucket).alias("n"), F.min("doc_rank").over(bucket).alias("first")).where("n >= 2")
    small = members.where(F.col("n") <= STAR).select("band", "key", "doc_rank")
    pairs = small.alias("x").join(small.alias("y"), ["band", "key"]).where("x.doc_rank < y.doc_rank").select(F.col("x.doc_rank").alias("a"), F.col("y.doc_rank").alias("b"))
    star = members.where((F.col("n") > STAR) & (F.col("doc_rank") != F.col("first"))).select(F.col("first").alias("a"), F.col("doc_rank").alias("b"))
    return pairs.unionByName(star).distinct()


def verified_edges(pairs: DataFrame, signed: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``a, b, similarity`` of the pairs whose signatures agree well enough. Only these documents' signatures are shuffled."""
    pairs = shared_checkpoint(pairs)
    slot = F.shiftrightunsigned(F.xxhash64("doc_rank"), 64 - _SLOT_BITS)
    met = _bitmap(pairs.select(F.explode(F.array(F.col("a").cast("bigint"), F.col("b").cast("bigint"))).alias("doc_rank")).select(slot.alias("slot")))
    sigs = signed.withColumn("doc_rank", F.col("doc_rank").cast("bigint")).where(_marked(slot, met)).select("doc_rank", "sig")
    joined = pairs.join(sigs.select(F.col("doc_rank").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_rank").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.select("a", "b", _agreement("sa", "sb").alias("similarity")).where(F.col("similarity") >= alike)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node of each node's component.

    Large-star and small-star rounds: every node's greater neighbours, then its lesser ones, are hung on its least
    neighbour, until nothing changes. Rounds grow with the logarithm of a component's width, and no component is ever
    gathered in one task. Each round is cut off by a checkpoint.
    """
    now = shared_checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = shared_checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def links_across(banded: DataFrame, signed: DataFrame, roots: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``a, b, similarity``: the alike pairs among members of large buckets that their stars left in different classes.

    Exact, by prefix filtering: two alike signatures agree in ``ceil(alike * size)`` places at least, so they share one of
    the rarest ``size - ceil(alike * size) + 1`` places of each. A bucket whose members are all of one class has no pairs.
    """
    large = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > STAR).select("band", "key")
    members = banded.join(large, ["band", "key"]).join(roots.select(F.col("node").alias("doc_rank"), "root"), "doc_rank", "left").withColumn("root", F.coalesce("root", "doc_rank"))
    mixed = members.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    open_ = shared_checkpoint(members.join(mixed, ["band", "key"]).select("doc_rank", "root").distinct())
    places = signed.join(open_, "doc_rank").select("doc_rank", "root", F.posexplode(signature_values("sig")).alias("at", "value"))
    rare = places.groupBy("at", "value").agg(F.count("*").alias("df"))
    order = Window.partitionBy("doc_rank").orderBy("df", "at", "value")
    least = PERMUTATIONS - math.ceil(alike * PERMUTATIONS) + 1
    prefix = places.join(rare, ["at", "value"]).withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= least) & (F.col("df") > 1))
    x, y = prefix.alias("x"), prefix.alias("y")
    same = (F.col("x.at") == F.col("y.at")) & (F.col("x.value") == F.col("y.value"))
    pairs = x.join(y, same & (F.col("x.doc_rank") < F.col("y.doc_rank")) & (F.col("x.root") != F.col("y.root"))).select(F.col("x.doc_rank").alias("a"), F.col("y.doc_rank").alias("b")).distinct()
    return verified_edges(pairs, signed, alike)


def normalized_documents(docs: DataFrame, text: str = "text", rank: str = "doc_rank", compatibility: bool = True, subset: str | None = None) -> DataFrame:
    """``doc_rank, zh, n``: the normalised texts, null ones as empty; rows without a rank are left out."""
    return docs.where(F.col(rank).isNotNull()).select(F.col(rank).alias("doc_rank"), chinese(subset).alias("zh"), T.normalize(F.coalesce(F.col(text), F.lit("")), compatibility).alias("n"))


def sign_documents(docs: DataFrame, text: str = "text", rank: str = "doc_rank", compatibility: bool = True, kind: str = "crc32", subset: str | None = None) -> DataFrame:
    """Signatures (`sign_texts`) of each document; a null text counts as empty, and all empty texts are alike."""
    return sign_texts(normalized_documents(docs, text, rank, compatibility, subset), kind)


def near_duplicates(docs: DataFrame, text: str = "text", rank: str = "doc_rank", compatibility: bool = True, kind: str = "crc32", subset: str | None = None) -> DataFrame:
    """``doc_rank, rep``: one row for each document with the least rank of its class of near duplicates.

    Equal texts are joined first, by the key of the normalised text, and only one of each goes through LSH.
    Ranks must be distinct; null ranks are left out. Of a ``subset`` that begins with zh the shingles are of characters.
    """
    every = shared_checkpoint(sign_documents(docs, text, rank, compatibility, kind, subset))
    once = every.groupBy("text_key").agg(F.min("doc_rank").alias("first"), F.min_by(F.struct("sig", "keys"), "doc_rank").alias("s"))
    signed = shared_checkpoint(once.select(F.col("first").alias("doc_rank"), "text_key", "s.sig", "s.keys"))
    same = every.select("doc_rank", "text_key").join(signed.select("text_key", F.col("doc_rank").alias("first")), "text_key").select("doc_rank", "first")
    banded = bands(signed)
    edges = shared_checkpoint(verified_edges(candidate_pairs(banded), signed))
    roots = components(edges)
    more = shared_checkpoint(links_across(banded, signed, roots))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    return same.join(roots, same["first"] == roots["node"], "left").select("doc_rank", F.coalesce("root", "first").alias("rep"))


#: Bits of a bitmap, 8 MB.
_SLOT_BITS = 26


def _bitmap(slots: DataFrame) -> Broadcast:
    """A broadcast bitmap of the values of ``slot``; its bits reach the driver as words."""
    with shuffles_dropped(slots.sparkSession):
        words = slots.distinct().groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    packed = np.zeros(1 << (_SLOT_BITS - 6), dtype=np.int64)
    packed[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return slots.sparkSession.sparkContext.broadcast(packed.view(np.uint8))


def _in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def _marked(slot: Column, bitmap: Broadcast) -> Column:
    """Whether the bitmap has a slot."""

    @F.pandas_udf(BooleanType())
    def marked(slots: pd.Series) -> pd.Series:
        return pd.Series(_in_bitmap(bitmap.value, slots.to_numpy(np.int64)))

    return marked(slot)


def least_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``, with the least value of each other column, as by grouping.

    Only rows whose key may stand elsewhere too, by a bitmap of the repeated keys, are shuffled; the others stay where they
    are, so tables with few repeated keys move next to nothing.
    """
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - _SLOT_BITS)
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(slot.alias("slot"))
    bitmap = _bitmap(repeated)

    may_repeat = _marked(slot, bitmap)
    others = [c for c in rows.columns if c != key]
    grouped = rows.where(may_repeat).groupBy(key).agg(*(F.min(c).alias(c) for c in others))
    return rows.where(~may_repeat).select(key, *others).unionByName(grouped)


#: Of the running sums of `shingle_set`: a value for each byte, a step and its inverse modulo 2^64, and their powers so far.
_SIGNS = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_POWERS = {x: np.ones(1, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))}


def _powers(x: int, n: int) -> np.ndarray:
    """The powers of ``x`` up to the ``n``-th at least."""
    if len(_POWERS[x]) <= n:
        _POWERS[x] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)]), dtype=np.uint64)
    return _POWERS[x]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, one to one."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: Bytes of text whose shingles are made at a time, but for longer texts.
_BYTES = 1 << 18


def _run_values(texts: list[str], by_char: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A value for each run that `with_shingles` makes of the texts, repeats included, and the place of each run's text.

    A run's value comes from two running sums over all bytes, so that equal runs have equal values wherever they stand.
    """
    joined = "\n".join(texts)
    raw = np.frombuffer((joined.replace(" ", "") if by_char else joined).encode(), np.uint8)
    lines = np.flatnonzero(raw == 10)
    first, last = np.concatenate([[0], lines + 1]), np.append(lines, len(raw))
    if by_char:
        starts = np.flatnonzero(((raw & 0xC0) != 0x80) & (raw != 10))
        ends = np.append(starts[1:], len(raw))
        ends = np.where(raw[ends - 1] == 10, ends - 1, ends) if len(raw) else ends
    else:
        ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
        starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.searchsorted(starts, np.append(first, len(raw) + 1))
    sizes = np.diff(at)
    whole = np.flatnonzero(sizes <= n)
    heads = np.arange(max(0, len(starts) - n + 1))
    of = np.repeat(np.arange(len(texts)), sizes)
    heads = heads[(of[heads] == of[heads + n - 1]) & (sizes[of[heads]] > n)]
    starts, ends, of = np.concatenate([starts[heads], first[whole]]), np.concatenate([ends[heads + n - 1], last[whole]]), np.concatenate([of[heads], whole])
    step, back = _POWERS
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SIGNS[raw] * _powers(step, len(raw))[: len(raw)], dtype=np.uint64, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(back, len(raw))[starts]), of


def shingle_sets(texts: list[str], by_char: list[bool], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit values of the shingles that `with_shingles` makes of texts without line ends, ascending in each
    text, and where each text's begin, with the end of all."""
    made, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for kind in (False, True):
        own = [k for k, c in enumerate(by_char) if bool(c) == kind]
        if own:
            values, places = _run_values([texts[k] for k in own], kind, n)
            made.append(values)
            of.append(np.array(own)[places])
    values, of = np.concatenate(made), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    values, of = values[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingled(batches: Iterator[pa.RecordBatch], text: int = 0, zh: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """Slices of the batches of about `_BYTES` of text, with their texts and `shingle_sets`."""
    for batch in (b for b in batches if b.num_rows):
        lengths = np.cumsum(np.array([len(x) for x in batch.column(text).to_pylist()], np.int64))
        cuts = np.flatnonzero(np.diff(lengths // _BYTES)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]):
            part = batch.slice(a, b - a)
            texts = part.column(text).to_pylist()
            yield part, texts, *shingle_sets(texts, part.column(zh).to_pylist())


#: Shingles counted at a time, times that one stands among these from which it is reported, and the most frequent ones that
#: are broadcast (8 bytes and one each).
_COUNTED, _OFTEN, _MOST_FREQUENT = 1 << 22, 3, 1 << 21

#: Times that a shingle is counted from which it counts as frequent.
HOT = 4


def frequent_shingles(normalized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values of frequent shingles, ascending, and the logarithm of how often each was counted.

    Any order of the shingles serves `exact_near_duplicates`, if it is the same for all documents; this one only keeps the
    frequent ones, which would give many pairs, behind the others.
    """

    def often(values: list[np.ndarray]) -> pa.RecordBatch:
        found = np.sort(np.concatenate(values))
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        found, times = found[starts], np.diff(np.append(starts, len(found)))
        return pa.RecordBatch.from_arrays([pa.array(found[times >= _OFTEN].view(np.int64)), pa.array(times[times >= _OFTEN])], ["g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, values, _ in shingled(batches):
            held.append(values)
            size += len(values)
            if size >= _COUNTED:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    times = normalized.select("n", "zh").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    with shuffles_dropped(normalized.sparkSession):
        top = times.orderBy(F.desc("n"), "g").limit(_MOST_FREQUENT).toPandas()
    values, order = np.unique(top["g"].to_numpy(np.int64).view(np.uint64), return_index=True)
    return values, np.log2(np.maximum(top["n"].to_numpy(np.float64), 1))[order].astype(np.uint8)


#: Parts in which documents meet that share a shingle; documents' sizes are told in steps of this ratio; size beyond which
#: documents must share one more shingle of their prefixes; postings made at a time, and pairs.
_PARTS, _RATIO, _ONE_MORE, _POSTINGS, _PAIRS = 1024, 1.05, 64, 1 << 20, 1 << 20
_POSTING = 9

def _size_class(size: int) -> int:
    """The step of a size; the last one has all greater ones."""
    c = min(255, int(math.log(size) / math.log(_RATIO)))
    return c - (_least_size(c) > size)


def _least_size(size_class: int) -> int:
    return math.ceil(_RATIO**size_class - 1e-9)


def _shared_at_least(size_class: int) -> int:
    """How many shingles of its prefix a document of this size shares with an alike one that is not smaller."""
    return 1 + _least_size(size_class) // _ONE_MORE


def text_id(text: str) -> int:
    """32 bits of a normalised text's hash. Other texts may have the same; it names candidates only."""
    return xxhash.xxh64_intdigest(text) >> 32


def _postings(normalized: DataFrame, alike: float) -> DataFrame:
    """``part, postings``: what documents show of the shingles of their prefixes, packed: 32 bits of the value, the text's
    id and its size's step."""
    frequent = normalized.sparkSession.sparkContext.broadcast(frequent_shingles(normalized))

    def packed(made: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        values, counts = np.concatenate([x for x, _, _ in made]), [len(x) for x, _, _ in made]
        parts = (values % np.uint64(_PARTS)).astype(np.int32)
        order = np.argsort(parts, kind="stable")
        shown = ((values // np.uint64(_PARTS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
        ids = np.repeat(np.array([x for _, x, _ in made], np.uint32), counts)[order]
        steps = np.repeat(np.array([x for _, _, x in made], np.uint8), counts)[order]
        found, starts = np.unique(parts[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        blobs = [shown[a:b].tobytes() + ids[a:b].tobytes() + steps[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "postings"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        rare = np.ones(1 << 23, bool)
        rare[(often >> np.uint64(41)).astype(np.int64)] = False
        made, size = [], 0
        for _, texts, values, bounds in shingled(batches):
            order = np.zeros(len(values), np.uint8)
            maybe = np.flatnonzero(~rare[(values >> np.uint64(41)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(often, values[maybe]), len(often) - 1)
                order[maybe] = np.where(often[at] == values[maybe], times[at], 0)
            for text, a, b, mixed in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), np.maximum.reduceat(order, bounds[:-1]).tolist()):
                step = _size_class(b - a)
                own = values[a:b][np.argsort(order[a:b], kind="stable")] if mixed else values[a:b]
                prefix = own[: b - a - math.ceil(alike * (b - a) - 1e-9) + _shared_at_least(step)]
                made.append((prefix, text_id(text), step))
                size += len(prefix)
            if size >= _POSTINGS:
                yield packed(made)
                made, size = [], 0
        if made:
            yield packed(made)

    return normalized.select("n", "zh").mapInArrow(show, "part int, postings binary")


def _meeting(shown: np.ndarray, ids: np.ndarray, steps: np.ndarray, alike: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, step`` of the pairs of postings of one value whose sizes allow that they are alike, with the lesser step.

    A text's postings are taken once; had it several, copies or another text of its id, it is a pair with itself too.
    """
    apart = 1 + int(-math.log(alike) / math.log(_RATIO))
    order = np.lexsort((ids, steps, shown))
    shown, ids, steps = shown[order], ids[order], steps[order].astype(np.int64)
    first = np.append(True, (shown[1:] != shown[:-1]) | (ids[1:] != ids[:-1]) | (steps[1:] != steps[:-1])) if len(ids) else np.zeros(0, bool)
    again = np.unique(np.flatnonzero(~first))
    if len(again):
        yield ids[again], ids[again], steps[again]
    shown, ids, steps = shown[first], ids[first], steps[first]
    at, ahead = np.arange(len(ids)), 0
    while len(at):
        ahead += 1
        at = at[at + ahead < len(ids)]
        at = at[(shown[at] == shown[at + ahead]) & (steps[at + ahead] - steps[at] <= apart)]
        if len(at):
            yield np.minimum(ids[at], ids[at + ahead]), np.maximum(ids[at], ids[at + ahead]), steps[at]


def candidate_texts(normalized: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``x, y``, ids of texts (`text_id`): all pairs of alike texts are among these; x <= y.

    Prefix filtering: two alike documents share ``k`` of the first ``size - ceil(alike * size) + k`` shingles of each, in
    any order of all shingles. What they show of these meets in parts by value, 9 bytes each, and is counted by pair.
    """

    def pairs(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = [len(b) // _POSTING for b in blobs]
        shown, ids, steps = (np.concatenate([np.frombuffer(b, kind, n, at * n) for b, n in zip(blobs, counts)]) for kind, at in ((np.uint32, 0), (np.uint32, 4), (np.uint8, 8)))
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            x, y, step = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((step, y, x))
            x, y, step = x[order], y[order], step[order]
            starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            needed = pa.array([_shared_at_least(c) for c in step[starts].tolist()], pa.int32())
            both = x[starts].astype(np.uint64) << np.uint64(32) | y[starts]
            return pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(np.diff(np.append(starts, len(x))), pa.int32()), needed], ["both", "shared", "needed"])

        for found in _meeting(shown, ids, steps, alike):
            held.append(found)
            size += len(found[0])
            if size >= _PAIRS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for here, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != part and blobs:
                    yield from pairs(blobs)
                    blobs = []
                part = here
                blobs.append(blob)
        if blobs:
            yield from pairs(blobs)

    parts = _postings(normalized, alike).repartition("part").sortWithinPartitions("part")
    met = parts.mapInArrow(meet, "both bigint, shared int, needed int")
    alike_enough = met.groupBy("both").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed")).where("shared >= needed")
    return alike_enough.select(F.shiftrightunsigned("both", 32).alias("x"), F.col("both").bitwiseAND(0xFFFFFFFF).alias("y"))


def texts_of(normalized: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, doc_rank, zh, z``: of the texts with ids among ``x, y`` the first document and the compressed text.

    A bitmap of the ids keeps all other texts in their narrow stage; those that only share its slots meet no pair.
    """
    bitmap = _bitmap(pairs.select(F.explode(F.array("x", "y")).alias("id")).select(F.shiftright("id", 32 - _SLOT_BITS).alias("slot")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids = np.fromiter(map(text_id, texts), np.int64, len(texts))
            rows = np.flatnonzero(_in_bitmap(held, ids >> (32 - _SLOT_BITS)))
            own = [texts[k].encode() for k in rows.tolist()]
            taken = [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
            columns = [pa.array(ids[rows]), *taken, pa.array([hashlib.md5(x).digest() for x in own], pa.binary()), pa.array([zlib.compress(x, 4) for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc_rank", "zh", "k", "z"])

    packed = normalized.select(F.col("doc_rank").cast("bigint"), "zh", "n").mapInArrow(pack, "id bigint, doc_rank bigint, zh boolean, k binary, z binary")
    first = packed.repartition("id").groupBy("id", "k").agg(F.min("doc_rank").alias("doc_rank"), F.min_by(F.struct("zh", "z"), "doc_rank").alias("t"))
    return first.select("id", "doc_rank", "t.zh", "t.z")


#: Pairs whose texts are compared at a time.
_COMPARED = 512


def _in_both(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sets share."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def exact_near_duplicates(docs: DataFrame, text: str = "text", rank: str = "doc_rank", compatibility: bool = True, alike: float = ALIKE, subset: str | None = None) -> DataFrame:
    """``a, b, similarity`` of all pairs of distinct texts with Jaccard similarity from ``alike`` on.

    Exact but for chance collisions of 64-bit values: `candidate_texts` misses no alike pair, and the shingles of each
    candidate pair are compared in whole. Only prefixes and the candidates' texts, compressed, are shuffled; equal texts
    are joined when these meet. Of a ``subset`` that begins with zh the shingles are of characters.
    """
    norm = normalized_documents(docs, text, rank, compatibility, subset)
    pairs = shared_checkpoint(candidate_texts(norm, alike))
    texts = texts_of(norm, pairs)
    a, b = (texts.select(*(F.col(c).alias(c + side) for c in texts.columns)) for side in ("_a", "_b"))
    both = pairs.join(a, F.col("x") == F.col("id_a")).join(b, F.col("y") == F.col("id_b")).where("x < y or doc_rank_a < doc_rank_b")

    def texts_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Both texts of each row, one after the other."""
        texts = [zlib.decompress(z).decode() for row in zip(*(batch.column(k).to_pylist() for k in (2, 5))) for z in row]
        return pa.RecordBatch.from_arrays([pa.array(texts), pa.array([c for row in zip(*(batch.column(k).to_pylist() for k in (1, 4))) for c in row])], ["n", "zh"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _COMPARED):
                rows = batch.slice(at, _COMPARED)
                pieces = [np.split(values, bounds[1:-1]) for _, _, values, bounds in shingled(iter([texts_in(rows)]))]
                sets = [x for piece in pieces for x in piece]
                ranks = [rows.column(k).to_numpy() for k in (0, 3)]
                shared = np.array([_in_both(x, y) for x, y in zip(sets[::2], sets[1::2])], np.int64)
                sizes = np.array([len(x) for x in sets], np.int64)
                columns = [np.minimum(*ranks), np.maximum(*ranks), shared / (sizes[::2] + sizes[1::2] - shared)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "similarity"])

    wanted = both.select("doc_rank_a", "zh_a", "z_a", "doc_rank_b", "zh_b", "z_b")
    return wanted.mapInArrow(compare, "a bigint, b bigint, similarity double").where(F.col("similarity") >= alike)


def precision_recall(got: DataFrame, ideal: DataFrame, key: str = "doc_rank") -> DataFrame:
    """``got, ideal, common, precision, recall`` of two sets of keys; an empty set counts as of size 1."""
    both = got.select(key).distinct().withColumn("g", F.lit(1)).join(ideal.select(key).distinct().withColumn("i", F.lit(1)), key, "full_outer")
    sums = both.agg(F.count("g").alias("got"), F.count("i").alias("ideal"), F.count_if(F.col("g").isNotNull() & F.col("i").isNotNull()).alias("common"))
    return sums.select("got", "ideal", "common", (F.col("common") / F.greatest("got", F.lit(1))).alias("precision"), (F.col("common") / F.greatest("ideal", F.lit(1))).alias("recall"))
