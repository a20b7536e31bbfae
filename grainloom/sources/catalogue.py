"""Sources: the catalogue of subsets, file picks, byte budgets, samples, manifests, and file formats."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Languages of code that are admitted, and the largest admitted file.
CODE_LANGUAGES = ("Python", "JavaScript", "TypeScript", "Java", "C", "C++", "GO", "Rust", "Markdown", "Shell", "SQL", "HTML", "CSS")
CODE_MAX_BYTES = 100_000

#: What each subset is read from: format, text column, columns read beside it, files at most.
CATALOGUE = {
    "en_web": ("parquet", "text", (), 4),
    "en_web_dclm": ("jsonl.zst", "text", (), 4),
    "zh_web": ("parquet", "text", (), 4),
    "code": ("parquet", "code", ("language", "size"), 4),
    "math": ("parquet", "text", (), 4),
    "en_wiki": ("parquet", "text", (), 4),
    "zh_wiki": ("parquet", "text", (), 4),
}


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k, f, t, ",".join(x), n) for k, (f, t, x, n) in CATALOGUE.items()]
    return spark.createDataFrame(rows, "subset string, format string, text_col string, extra_cols string, n_files int")


def scan(df: DataFrame, text: str, *extra: str) -> DataFrame:
    """The text and extra columns of the rows that have a text; only these columns are read."""
    return df.select(text, *extra).where(F.col(text) != "")


def code_prefilter(code: DataFrame, languages: tuple[str, ...] = CODE_LANGUAGES, most: int = CODE_MAX_BYTES) -> DataFrame:
    """Rows of an admitted language and size; unknown ones are not admitted."""
    return code.where(F.col("language").isin(*languages) & (F.col("size") <= most))


def running_bytes(df: DataFrame, group: str, order: list[str], text: str = "text") -> Column:
    """UTF-8 bytes of the group's texts before each row, by order. Groups are files or parts, bounded by what one reader
    takes."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0))


def byte_budget(df: DataFrame, group: str, order: list[str], most: int, text: str = "text") -> DataFrame:
    """Rows of each group up to the one that crosses the budget, which is still taken."""
    return df.withColumn("__before", running_bytes(df, group, order, text)).where(F.col("__before") < most).drop("__before")


def even_file_pick(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """``n`` files spread evenly over the sorted listing: the one at ``i * files // n`` for each i. A listing is small."""
    order = Window.partitionBy().orderBy(path)
    numbered = files.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    k = F.least(F.lit(n), F.col("__n"))
    # index i*N//k is hit exactly when the k-step ladder moves on between i-1 and i
    hit = F.floor(((F.col("__i") + 1) * k - 1) / F.col("__n")) != F.floor((F.col("__i") * k - 1) / F.col("__n"))
    return numbered.where(hit).drop("__i", "__n")


def probed_groups(groups: DataFrame, subset: str = "subset", group: str = "part") -> DataFrame:
    """The first, middle and last group of each subset, of its distinct groups."""
    span = groups.groupBy(subset).agg((F.max(group) + 1).alias("n"))
    return groups.join(span, subset).where((F.col(group) == 0) | (F.col(group) == F.floor(F.col("n") / 2)) | (F.col(group) == F.col("n") - 1)).select(subset, group).distinct()


def yield_probe(rows: DataFrame, groups: DataFrame, usable: Column, subset: str = "subset", group: str = "part", text: str = "text") -> DataFrame:
    """Mean bytes of usable texts in the probed ``groups`` of each subset, at least 1; only these groups' rows are judged."""
    sizes = rows.where(usable).groupBy(subset, group).agg(F.sum(F.octet_length(text)).alias("__bytes"))
    return groups.join(sizes, [subset, group], "left").groupBy(subset).agg(F.greatest(F.lit(1), F.floor(F.avg(F.coalesce("__bytes", F.lit(0))))).cast("bigint").alias("bytes_per_group"))


def plan_tasks(files: DataFrame, need: int, per_task: int = 8) -> DataFrame:
    """``part, file, first_group, groups`` of each task that reads row groups; ``files`` has ``file, groups``.

    The n-th task of a file takes its groups from ``n * per_task`` on, and tasks are ordered by n, then by file. Those are
    planned before which fewer than ``need`` groups stand, so a greater need only adds tasks. A listing is small.
    """
    turns = files.where("groups > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("groups") - 1) / per_task))))
    tasks = turns.select("file", "turn", (F.col("turn") * per_task).alias("first_group"), F.least(F.lit(per_task), F.col("groups") - F.col("turn") * per_task).cast("bigint").alias("groups"))
    order = Window.orderBy("turn", "file")
    ahead = F.coalesce(F.sum("groups").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tasks.withColumn("ahead", ahead).where(F.col("ahead") < need).select((F.row_number().over(order) - 1).cast("bigint").alias("part"), "file", "first_group", "groups")


def plan_byte_tasks(files: DataFrame, target: int) -> DataFrame:
    """``part, file, max_bytes``: a task for each line file, with its part of the bytes, rounded up."""
    every = Window.partitionBy()  # a listing is small
    share = F.ceil(F.lit(target) / F.count("*").over(every)).cast("bigint")
    return files.select((F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("part"), "file", share.alias("max_bytes"))


def target_bytes(weights: DataFrame, rates: DataFrame, total_tokens: int, loss: float = 1.1, keep: float = 0.9) -> DataFrame:
    """Bytes to read for each subset's share of the tokens: tokens times bytes a token, times losses, over the yield."""
    every = Window.partitionBy()  # a row for each subset
    share = F.col("weight") / F.sum("weight").over(every)
    tokens = F.round(share * total_tokens)
    out = weights.withColumn("target_tokens", tokens.cast("bigint")).join(rates, "subset")
    return out.select("subset", "target_tokens", F.round(F.col("target_tokens") * F.col("bytes_per_token") * loss / keep).cast("bigint").alias("target_bytes"))


def unfinished(planned: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Planned parts that are not done yet."""
    return planned.join(done.select(*key).distinct(), list(key), "left_anti")


def sample_to_budget(df: DataFrame, group: str, key: str, most: int, seed: int = 0, text: str = "text") -> DataFrame:
    """Rows of each group in a seeded order until the byte budget is reached; order and totals are two-level."""
    from grainloom.operators.packing import running_totals, shuffle_key

    sized = df.withColumn("__k", shuffle_key(seed, group, key)).withColumn("__b", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    return running_totals(sized, group, "__k", "__b", "__before").where(F.col("__before") < most).drop("__k", "__b", "__before")


def language_cap(df: DataFrame, budget: int, cap: float = 0.25, language: str = "language", size: str = "size", key: str = "file_id") -> DataFrame:
    """Rows admitted while their language holds less than its share of the budget (checked before adding)."""
    from grainloom.operators.packing import running_totals, shuffle_key

    keyed = df.withColumn("__l", F.coalesce(language, F.lit(""))).withColumn("__k", shuffle_key(0, key)).withColumn("__s", F.coalesce(size, F.lit(0)))
    return running_totals(keyed, "__l", "__k", "__s", "__before").where(F.col("__before") < cap * budget).drop("__l", "__k", "__s", "__before")


def holdout_file(files: DataFrame, group: str = "subset", path: str = "part") -> DataFrame:
    """``split``: the last file of each group is ``eval``, the rest ``train``."""
    last = files.groupBy(group).agg(F.max(path).alias("__last"))
    return files.join(last, group).withColumn("split", F.when(F.col(path) == F.col("__last"), "eval").otherwise("train")).drop("__last")


def manifest(df: DataFrame, group: str = "subset", text: str = "text") -> DataFrame:
    """Documents, UTF-8 bytes and an order-free fingerprint (sum of the texts' CRC-32) of each group."""
    return df.groupBy(group).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.sum(F.crc32(F.coalesce(text, F.lit("")))), F.lit(0)).cast("bigint").alias("crc"))


def review_sample(df: DataFrame, per_group: int, seed: int = 0, group: str = "subset", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first characters of some documents of each group in a seeded order, for reading. A top-k, taken part by part."""
    k = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group), F.col(key).cast("string")))
    order = Window.partitionBy(group).orderBy("__k", key)
    return df.withColumn("__k", k).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_group).select(group, key, F.substring(text, 1, 800).alias("head"))


# -- files ----------------------------------------------------------------------------------------------------------


def write_jsonl_zst(df: DataFrame, folder: str, text: str = "text", level: int = 3) -> DataFrame:
    """Files of lines ``{"text": ...}``, one a partition, compressed with Zstandard, in a folder that all executors see;
    returns ``path, docs``. (The JVM's JSON writer has the codec only where native libraries are.)

    A file is written under another name and renamed, so a repeated task leaves no half file.
    """

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.jsonl.zst")
        part = f"{path}.{TaskContext.get().taskAttemptId()}"
        n = 0
        with open(part, "wb") as raw, zstandard.ZstdCompressor(level).stream_writer(raw) as out:
            for batch in frames:
                for t in batch.column(0).to_pylist():
                    out.write((json.dumps({"text": t}, ensure_ascii=False) + "\n").encode())
                    n += 1
        os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "docs"])

    os.makedirs(folder, exist_ok=True)
    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(write, "path string, docs bigint")


def read_jsonl_zst(spark: SparkSession, folder: str) -> DataFrame:
    """``text`` of each line of the files; a file is one task's work and is decompressed as a stream."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for batch in frames:
            for content in batch.column(0).to_pylist():
                rows: list[str | None] = []
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)) as raw:
                    for line in io.TextIOWrapper(raw, encoding="utf-8", newline="\n"):
                        rows.append(json.loads(line)["text"])
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])

    return spark.read.format("binaryFile").load(f"{folder}/*.jsonl.zst").select("content").mapInArrow(read, "text string")


def write_token_shards(tokens: DataFrame, folder: str, shard: str = "shard", order: str = "ord", ids: str = "tokens") -> DataFrame:
    """Flat little-endian 16-bit files, one for each shard, in a folder that all executors see; returns ``shard, n``.

    Ids outside 0 to 65,535 are an error. A shard is bounded by the cutting step; each is written by one task.
    """

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        counts: dict[int, int] = {}
        try:
            for batch in frames:
                for s, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = row.values.to_numpy() if row.values is not None else np.zeros(0, np.int64)
                    if len(values) and (values.min() < 0 or values.max() > 65_535):
                        raise ValueError("token id outside 16 bits")
                    if s not in counts:
                        if out:
                            out.close()
                        out = open(os.path.join(folder, f"shard_{s:05d}.bin"), "wb")
                        counts[s] = 0
                    out.write(values.astype("<u2").tobytes())
                    counts[s] += len(values)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["shard", "n"])

    os.makedirs(folder, exist_ok=True)
    placed = tokens.select(F.col(shard).cast("bigint").alias("shard"), ids, order).repartition("shard").sortWithinPartitions("shard", order)
    return placed.select("shard", F.col(ids).cast("array<bigint>").alias("ids")).mapInArrow(write, "shard bigint, n bigint")


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``path, tokens`` of each shard file; files without a byte are left out."""

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            lists = [np.frombuffer(x, dtype="<u2").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["path", "tokens"])

    return spark.read.format("binaryFile").load(f"{folder}/*.bin").select("path", "content").mapInArrow(decode, "path string, tokens array<int>")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each value."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(31))


def markov_corpus(spark: SparkSession, chains: int, length: int, states: int, branch: int, seed: int = 0) -> DataFrame:
    """``chain, pos, state``: chains that begin with state 0 and step to one of each state's ``branch`` distinct
    successors, drawn by a seeded hash. The entropy of a step is the logarithm of ``branch``."""

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            ids = batch.column(0).to_numpy()
            state = np.zeros(len(ids), dtype=np.int64)
            path = [state]
            for step in range(1, length):
                draw = (_mixed(ids + np.int64(step) * 1_000_003 + np.int64(seed) * 998_244_353) % np.uint64(branch)).astype(np.int64)
                state = 1 + (state * branch + draw + seed) % (states - 1)
                path.append(state)
            flat = np.stack(path, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, length)), pa.array(np.tile(np.arange(length), len(ids))), pa.array(flat.reshape(-1))], ["chain", "pos", "state"])

    return spark.range(chains).mapInArrow(walk, "chain bigint, pos bigint, state bigint")
