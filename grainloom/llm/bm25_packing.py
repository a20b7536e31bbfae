"""Filling containers of fixed capacity by lexical retrieval (problem 3).

Documents become vectors of hashed terms; the document frequencies of the `TERMS` hash slots are counted over the whole
corpus, a table of fixed size. Documents are dealt to shards of about `SHARD` members by content: those with the same
strongest shared term stand together, and where these are too many for a shard, those with the same second one. Every
shard is packed on its own: an inverted index of BM25 impacts returns, for each seed document (the longest unused), its
unused neighbours by score, which fill the seed's container as they fit; what space is left takes the longest unused
document that fits. Containers that stay too empty are dissolved, and their documents are packed by length across shards.

A document longer than a container is cut: its full pieces fill containers of their own, the rest is packed like the
others. Every document is placed once. ``via`` tells how a document came to its container.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainloom.llm.common import map_batches, shared_checkpoint, small_batches
from grainloom.llm.token_budget import count_tokens

#: Hash slots of terms, documents in a shard.
TERMS, SHARD = 1 << 18, 1500

#: Documents that must share a term for it to decide on their shard.
SHARED = 4

#: Container sizes packed in one call.
MOST_SPECS = 1000

#: BM25's term-frequency saturation and length normalisation; a container below this fill is dissolved once.
K1, B, WELL_FILLED = 1.2, 0.75, 0.9

_TERM = re.compile(r"[㐀-鿿]{2}|[^\W\d_㐀-鿿]{3,}")


_ZSTD = pa.Codec("zstd", 1)


def packed_vector(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """A document's rising terms and their counts: the steps between the terms, then the counts, by planes of their bytes."""
    values = np.concatenate([np.diff(terms, prepend=0), counts]).astype(np.uint32)
    return _ZSTD.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpacked_vector(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms and counts of a `packed_vector` of ``n`` terms."""
    planes = np.frombuffer(_ZSTD.decompress(packed, 8 * n, asbytes=True), np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return np.cumsum(values[:n]).astype(np.int32), values[n:].astype(np.int64)


def term_vectors(clean: DataFrame) -> DataFrame:
    """``doc_id, n, vector``: the ``n`` distinct hashed terms of each document's text with their counts, as a
    `packed_vector`, deliveries of one id once."""
    small_batches(clean.sparkSession)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict[str, int] = {}
        sizes, packed = [], []
        for text in batch.column(1).to_pylist():
            words = _TERM.findall(text.lower())
            for w in set(words) - memo.keys():
                memo[w] = xxhash.xxh32_intdigest(w) % TERMS
            ids, n = np.unique(np.fromiter(map(memo.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
            sizes.append(len(ids))
            packed.append(packed_vector(ids, n))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "n", "vector"])

    plain = clean.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(plain, vectors, "doc_id bigint, n int, vector binary").dropDuplicates(["doc_id"])


def document_lengths(docs_idx: DataFrame, clean: DataFrame | None = None, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, tokens`` of each indexed document once; the offsets' difference stands in for a missing length. For a
    document with neither, the tokens of its text in ``clean`` under the public tokenizer are taken, and one for the
    end-of-text token; without a text it counts 0."""
    length = F.coalesce(F.col("tokens"), F.col("end_off") - F.col("start_off"))
    known = docs_idx.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(length.isNotNull(), F.greatest(length, F.lit(0)))).cast("bigint").alias("tokens"))
    if clean is not None:
        missing = known.where("tokens IS NULL").select("doc_id")
        if not missing.isEmpty():
            texts = clean.select("doc_id", "text").join(missing, "doc_id", "left_semi")
            measured = count_tokens(texts, ["doc_id"], ranks_path=ranks_path).groupBy("doc_id").agg((F.max("n_tokens") + 1).alias("measured"))
            known = known.join(measured, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", "measured")).drop("measured")
    return known.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def corpus_weights(vectors: DataFrame) -> Broadcast:
    """Of all hash slots the inverse document frequency and whether `SHARED` documents have it, and the mean length."""

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [unpacked_vector(v, n) for n, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        terms, docs = np.unique(np.concatenate([t for t, _ in each]) if each else np.zeros(0, np.int32), return_counts=True)
        # at -1 and -2 the documents and their words
        terms, docs = np.append(terms, [-1, -2]), np.append(docs, [len(each), sum(int(c.sum()) for _, c in each)])
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(docs, pa.int64())], ["t", "n"])

    df = np.zeros(TERMS, dtype=np.int64)
    rows = map_batches(vectors.select("doc_id", "n", "vector"), sums, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toPandas()  # at most TERMS rows and two
    told = rows["t"].to_numpy(dtype=np.int64) >= 0
    df[rows["t"].to_numpy(dtype=np.int64)[told]] = rows["n"].to_numpy(dtype=np.int64)[told]
    totals = dict(zip(rows["t"].tolist(), rows["n"].tolist()))
    n = totals.get(-1, 0)
    mean = totals.get(-2, 0) / max(1, n) or 1.0
    return vectors.sparkSession.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), df >= SHARED, mean))


def bm25_impacts(vector: bytes, n: int, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a document, rising, and what each adds to the score of a document that shares it."""
    t, c = unpacked_vector(vector, n)
    c = c.astype(np.float32)
    return t, idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * c.sum() / mean))


def with_homes(vectors: DataFrame, weights: Broadcast) -> DataFrame:
    """``doc_id, n, vector, first, second``: with the two strongest terms that `SHARED` documents have (-1 where there is
    none)."""

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        idf, shared, mean = weights.value
        homes = []
        for n, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            t, score = bm25_impacts(vector, n, idf, mean)
            t = t[np.argsort(-score, kind="stable")]
            homes.append([*t[shared[t]][:2].tolist(), -1, -1][:2])
        first, second = zip(*homes) if homes else ((), ())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], ["doc_id", "n", "vector", "first", "second"])

    return map_batches(vectors.select("doc_id", "n", "vector"), look, "doc_id bigint, n int, vector binary, first int, second int")


def indexed_vectors(vectors: DataFrame) -> DataFrame:
    """``doc_id, terms, impacts, first, second``: all terms of each document with their BM25 impacts, statistics over all
    documents, and its two strongest terms that `SHARED` documents have (-1 where there is none)."""
    weights = corpus_weights(vectors)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        idf, _, mean = weights.value
        made = [bm25_impacts(v, n, idf, mean) for n, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = [pa.array([t for t, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3), batch.column(4)], ["doc_id", "terms", "impacts", "first", "second"])

    return map_batches(with_homes(vectors, weights), weigh, "doc_id bigint, terms array<int>, impacts array<float>, first int, second int")


def dealt_to_shards(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``docs`` with ``shard``: about so many documents that have their strongest terms in common.

    Terms that fewer documents have than a shard takes are lined up and the line is cut; the documents of a more frequent
    one are lined up by their second term; and those of a pair of terms that alone exceeds a shard are dealt by hash. The
    counts are of hash slots and of pairs of these, never of a group's documents in one task.
    """
    home = docs.select("doc_id", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("second", F.lit(-1)).alias("second"))
    pairs = home.groupBy("first", "second").agg(F.count("*").alias("n2"))
    ones = pairs.groupBy("first").agg(F.sum("n2").alias("n1"))
    line = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # at most TERMS rows
    ones = ones.withColumn("ahead1", F.coalesce(F.sum(F.when(F.col("n1") <= shard, F.col("n1"))).over(line), F.lit(0)))
    inside = Window.partitionBy("first").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)  # as many at most
    pairs = pairs.withColumn("ahead2", F.coalesce(F.sum(F.when(F.col("n2") <= shard, F.col("n2"))).over(inside), F.lit(0)))
    table = pairs.join(ones, "first").select("first", "second", "n1", "n2", "ahead1", "ahead2")
    named = docs.withColumn("first", F.coalesce("first", F.lit(-1))).withColumn("second", F.coalesce("second", F.lit(-1))).join(table, ["first", "second"])
    salt = F.expr(f"pmod(xxhash64(doc_id), cast(ceil(n2 / {shard}) as bigint))")
    name = (
        F.when(F.col("n1") <= shard, F.format_string("%d", F.floor(F.col("ahead1") / shard)))
        .when(F.col("n2") <= shard, F.format_string("%d.%d", "first", F.floor(F.col("ahead2") / shard)))
        .otherwise(F.format_string("%d.%d.%d", "first", "second", salt))
    )
    return named.withColumn("shard", name).drop("n1", "n2", "ahead1", "ahead2", "first", "second")


class ShardIndex:
    """Inverted index of one shard; answers with unused neighbours."""

    def __init__(self, terms: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        self.terms, self.impacts = terms, impacts
        sizes = [len(t) for t in terms]
        flat = np.concatenate(terms) if sum(sizes) else np.zeros(0, np.int32)
        weight = np.concatenate(impacts) if sum(sizes) else np.zeros(0, np.float32)
        owner = np.repeat(np.arange(len(terms), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        self._owner, self._weight = owner[order], weight[order]
        self._term, first = np.unique(flat[order], return_index=True)
        self._first = np.append(first, len(flat))

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents that share terms with the seed, by falling score."""
        if not len(self.terms[seed]):
            return []
        at = np.searchsorted(self._term, self.terms[seed])
        owners = np.concatenate([self._owner[self._first[k] : self._first[k + 1]] for k in at])
        score = np.bincount(owners, np.concatenate([self._weight[self._first[k] : self._first[k + 1]] for k in at]), minlength=len(unused))
        score[~unused] = 0.0
        top = np.flatnonzero(score > 0)
        return top[np.argsort(-score[top], kind="stable")].tolist()


def pack_shard(lengths: np.ndarray, index: ShardIndex | None, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """Containers of the documents of a shard, none of which is longer than the capacity, and how each came to its own:
    0 as the seed, 1 as a neighbour of it, 2 because its length fits best."""
    unused = np.ones(len(lengths), dtype=bool)
    via = np.zeros(len(lengths), dtype=np.int8)
    by_length = sorted(range(len(lengths)), key=lambda i: (int(lengths[i]), i))
    sizes = [int(lengths[i]) for i in by_length]
    out: list[list[int]] = []
    while by_length:
        seed = by_length.pop()
        room = capacity - sizes.pop()
        unused[seed] = False
        box = [seed]

        def take(i: int, how: int) -> None:
            nonlocal room
            k = bisect.bisect_left(sizes, int(lengths[i]))
            while by_length[k] != i:
                k += 1
            by_length.pop(k)
            sizes.pop(k)
            unused[i] = False
            via[i] = how
            box.append(i)
            room -= int(lengths[i])

        if index is not None and sizes and sizes[0] <= room:
            for i in index.neighbours(seed, unused):
                # a neighbour that leaves a gap nothing fits must fill nearly as well as the best fit would
                rest = room - int(lengths[i])
                if rest >= 0 and (sizes[0] <= rest or int(lengths[i]) >= sizes[bisect.bisect_right(sizes, room) - 1] - 0.02 * capacity):
                    take(i, 1)
                    if not sizes or sizes[0] > room:
                        break
        while sizes and sizes[0] <= room:
            take(by_length[bisect.bisect_right(sizes, room) - 1], 2)
        out.append(box)
    return out, via


VIA = ("seed", "neighbour", "fit", "piece")
_OUT = "spec string, capacity bigint, container string, doc_id bigint, piece int, tokens bigint, via string"
_NAMES = [c.split(" ")[0] for c in _OUT.split(", ")]


def pack_documents(docs_idx: DataFrame, clean: DataFrame, specs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """One row ``(spec, capacity, container, doc_id, piece, tokens, via)`` for each placed document, or piece of one that is
    longer than the container.

    Specs without a positive capacity are left out, repeated ones count once. Documents of `docs_idx` without a text are
    packed by length alone. Null ids are left out; empty tables give no rows; extra columns are not read.
    """
    vectors = shared_checkpoint(term_vectors(clean))
    few = specs.where("capacity > 0").groupBy("spec").agg(F.max("capacity").alias("capacity")).limit(MOST_SPECS + 1).collect()
    if len(few) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    sizes = sorted((str(r["spec"]), int(r["capacity"])) for r in few)
    weights = corpus_weights(vectors)
    docs = shared_checkpoint(document_lengths(docs_idx, clean, ranks_path).join(with_homes(vectors, weights), "doc_id", "left"))

    def pieces(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Full pieces of each document, and the place and length of those with a rest, or that are empty."""
        full, rest = length // capacity, length % capacity
        return full, np.flatnonzero((rest > 0) | (full == 0)), rest

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable").reset_index(drop=True)
        idf, _, mean = weights.value
        none = np.zeros(0, np.int32), np.zeros(0, np.float32)
        terms, impacts = zip(*(none if v is None else bm25_impacts(v, int(n), idf, mean) for v, n in zip(pdf["vector"], pdf["n"])))
        ids, length = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy()
        name, out = str(pdf["shard"].iloc[0]), []
        for spec, capacity in sizes:
            full, left, rest = pieces(length, capacity)
            for i in np.flatnonzero(full):
                out += [(spec, capacity, f"f-{ids[i]}-{k}", ids[i], k, capacity, VIA[3]) for k in range(full[i])]
            boxes, via = pack_shard(rest[left], ShardIndex([terms[i] for i in left], [impacts[i] for i in left]), capacity)
            for k, box in enumerate(boxes):
                # a container that stays too empty is given up: its documents have no container yet
                named = f"a-{name}-{k}" if rest[left[box]].sum() >= WELL_FILLED * capacity else None
                out += [(spec, capacity, named, ids[left[i]], int(full[left[i]]), int(rest[left[i]]), VIA[via[i]]) for i in box]
        return pd.DataFrame(out, columns=_NAMES)

    # all container sizes are packed where a shard's terms are, so these are moved once
    first = shared_checkpoint(dealt_to_shards(docs).select("shard", "doc_id", "tokens", "n", "vector").groupBy("shard").applyInPandas(pack, _OUT))
    loose = first.where("container IS NULL")
    counts = {r["spec"]: r["count"] for r in loose.groupBy("spec").count().collect()}
    dealt = F.lit(1)
    for spec, n in counts.items():
        dealt = F.when(F.col("spec") == spec, -(-n // SHARD)).otherwise(dealt)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        boxes, via = pack_shard(pdf["tokens"].to_numpy(), None, int(pdf["capacity"].iloc[0]))
        name = np.empty(len(pdf), dtype=object)
        for k, box in enumerate(boxes):
            name[box] = f"b-{pdf['shard'].iloc[0]}-{k}"
        return pd.DataFrame({**{c: pdf[c] for c in _NAMES}, "container": name, "via": [VIA[v] for v in via]})[_NAMES]

    again = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), dealt.cast("bigint")))
    return first.where("container IS NOT NULL").unionByName(again.groupBy("spec", "shard").applyInPandas(fill, _OUT))


def unused_space(packed: DataFrame) -> DataFrame:
    """Of each spec: containers, the least possible number, tokens and share of the space left unused, and the share of the
    documents added to a seed that came as its neighbours."""
    boxes = packed.groupBy("spec", "capacity", "container").agg(F.sum("tokens").alias("used"), F.count_if(F.col("via") == "neighbour").alias("near"), F.count_if(F.col("via").isin("neighbour", "fit")).alias("added"))
    out = boxes.groupBy("spec", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("near").alias("near"), F.sum("added").alias("added"))
    space = F.col("containers") * F.col("capacity")
    return out.select(
        "spec",
        "capacity",
        "containers",
        F.ceil(F.col("used") / F.col("capacity")).alias("least_containers"),
        (space - F.col("used")).alias("unused"),
        F.round(1 - F.col("used") / space, 6).alias("unused_share"),
        F.round(F.col("near") / F.greatest(F.col("added"), F.lit(1)), 6).alias("retrieved_share"),
    )
