"""Pre-tokenisation, encoding with a public tokenizer, round trips and fertility. Tokenizers are used, never trained."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainloom.functions import text as T

#: Fixed value: the pre-tokeniser with single digits.
SPLIT_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"

#: Reserved tokens, their ids being their places.
SPECIAL_TOKENS = ("<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|tool|>", "<|pad|>", *(f"<|reserved_{i}|>" for i in range(10)))


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    return os.path.join(os.environ.get("GRAINLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def pretokenize(text: Column | str) -> Column:
    """The pieces of a text within which merges happen."""
    return F.regexp_extract_all(T.col(text), F.lit(f"({SPLIT_PATTERN})"), 1)


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``piece, n`` over all documents."""
    return docs.where(F.col(text).isNotNull()).select(F.explode(pretokenize(text)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


#: Characters that are encoded at a time (one longer text is taken alone): an encoding holds some hundred bytes a token.
AT_ONCE = 1 << 18


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Where stretches of at most `AT_ONCE` characters, or of one text, begin and end."""
    begin = held = 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > AT_ONCE:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: ids without special tokens; a null text has an empty list."""
    path = path or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        tok = _load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids = [np.array(e.ids, np.int32) for e in tok.encode_batch(texts[a:b], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key, text`` of encoded documents; reserved tokens are shown."""
    path = path or vocabulary_file()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _load(path)
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "text": tok.decode_batch([list(x) for x in pdf["ids"]], skip_special_tokens=False)})

    return encoded.select(key, "ids").mapInPandas(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the number of its text's tokens, ``n``, in the place of the text; no ids leave the worker."""
    path = path or vocabulary_file()
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        tok = _load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            n = [len(e) for a, b in _slices(texts) for e in tok.encode_batch(texts[a:b], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64())], [*kept, "n"])

    return docs.select(*kept, text).mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept), "n bigint"]))


def fertility(docs: DataFrame, encoded: DataFrame | None = None, group: str = "subset", key: str = "doc_id") -> DataFrame:
    """Bytes, words, characters and tokens of each group, and bytes a token, tokens a word, tokens a character. Without
    ``encoded`` the texts are read once for all of these."""
    sized = docs.where("text IS NOT NULL").select(key, group, F.octet_length("text").alias("b"), F.size(T.words("text")).alias("w"), F.length(T.without_space("text")).alias("c"), "text")
    told = token_counts(sized.drop(key)) if encoded is None else sized.drop("text").join(encoded.select(key, F.size("ids").alias("n")), key)
    sums = told.groupBy(group).agg(F.sum("b").alias("n_bytes"), F.sum("w").alias("n_words"), F.sum("c").alias("n_chars"), F.sum("n").alias("tokens"))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return sums.withColumn("bytes_per_token", rate("n_bytes", "tokens")).withColumn("tokens_per_word", rate("tokens", "n_words")).withColumn("tokens_per_char", rate("tokens", "n_chars"))
