"""Encoding a whole corpus with a public byte-level BPE tokenizer (problem 6).

Each Arrow batch hands its new distinct pieces to the prefix-sharing trie of `bpe_trie`; a document's ids are the
concatenation of its pieces' ids. The stage is narrow: no shuffle, no skew, memory bounded by the memo of a worker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainloom.llm.bpe_trie import tokenizer_tables, worker_encoder
from grainloom.llm.common import map_batches, small_batches, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row ``(doc_id, ids)`` for each row of ``df``, without special tokens.

    Text that looks like a special token is ordinary text. A null and an empty text both have an empty list, never null;
    a blank text has the ids of its blanks. Repeated rows stay repeated, a null id stays null, other columns of ``df``
    are neither read nor returned, an empty table gives an empty result. Texts of any length are encoded whole.
    """
    small_batches(df.sparkSession)
    tables = df.sparkSession.sparkContext.broadcast(tokenizer_tables(ranks_path or tokenizer_file(RANKS)))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = worker_encoder(tables).encode(batch.column(1).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    plain = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, encode, "doc_id bigint, ids array<int>")
