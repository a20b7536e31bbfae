"""The queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainloom.llm import bm25_packing as p3
from grainloom.llm import curriculum_mix as p7
from grainloom.llm import encode_corpus as p6
from grainloom.llm import generated_code as p4
from grainloom.llm import hidden_event_sentences as p8
from grainloom.llm import leak_tiling as p1
from grainloom.llm import text_stats as p2
from grainloom.llm import token_budget as p5
from grainloom.llm.common import read_table as t

Query = Callable[[SparkSession, str], DataFrame]


def _p2_stats(spark: SparkSession, d: str, code: bool = True) -> DataFrame:
    clean = t(spark, d, "clean", "doc_id", "subset", "text")
    if not code:
        clean = clean.where("subset IS NULL OR lower(trim(subset)) <> 'code'")
    return p2.text_statistics(p2.text_counts(clean, t(spark, d, "common_words")))


def _p5_audit(spark: SparkSession, d: str) -> DataFrame:
    clean = t(spark, d, "clean", "doc_id", "text")
    docs_idx = t(spark, d, "docs_idx", "subset", "part", "doc_id", "start_off", "end_off", "tokens")
    return p5.audit_parts(clean, docs_idx, t(spark, d, "docs"))


def _p5_slices(spark: SparkSession, d: str) -> DataFrame:
    clean = t(spark, d, "clean", "doc_id", "subset", "lang", "domain", "text")
    documents = t(spark, d, "documents", "doc_id", "source", "lang", "domain", "text")
    docs_idx = t(spark, d, "docs_idx", "subset", "part", "doc_id", "start_off", "end_off", "tokens")
    return p5.slice_totals(clean, documents, docs_idx, t(spark, d, "tokenizer_eval"))


def _p3_packed(spark: SparkSession, d: str) -> DataFrame:
    docs_idx = t(spark, d, "docs_idx", "subset", "doc_id", "start_off", "end_off", "tokens")
    return p3.pack_documents(docs_idx, t(spark, d, "clean", "doc_id", "text"), t(spark, d, "pack_specs"))


def _p7_sized(spark: SparkSession, d: str) -> DataFrame:
    return p7.sized_documents(t(spark, d, "documents", "doc_id", "source", "text"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: p1.leaked_items(t(s, d, "clean", "doc_id", "text"), t(s, d, "eval_sets", "item_id", "text"), t(s, d, "decontam_exclude", "ngram")),
    "p1_coverage": lambda s, d: p1.item_coverage(t(s, d, "clean", "doc_id", "text"), t(s, d, "eval_sets", "item_id", "text"), t(s, d, "decontam_exclude", "ngram")),
    "p2_found": lambda s, d: p2.not_prose(_p2_stats(s, d, code=False)),
    "p2_text_statistics": _p2_stats,
    "p3_containers": _p3_packed,
    "p3_unused_space": lambda s, d: p3.unused_space(_p3_packed(s, d)),
    "p4_found": lambda s, d: p4.not_hand_written(t(s, d, "code", "file_id", "path", "code")).select("file_id"),
    "p4_file_kinds": lambda s, d: p4.not_hand_written(t(s, d, "code", "file_id", "path", "code")),
    "p5_found": lambda s, d: p5.wrong_totals(_p5_audit(s, d)),
    "p5_part_audit": _p5_audit,
    "p5_slice_totals": _p5_slices,
    "p5_odd_lengths": lambda s, d: p5.odd_lengths(t(s, d, "clean", "doc_id", "text"), t(s, d, "docs_idx", "subset", "part", "doc_id", "start_off", "end_off", "tokens")),
    "p6_ids": lambda s, d: p6.encode_corpus(t(s, d, "documents", "doc_id", "text")),
    "p7_draw": lambda s, d: p7.draw_mixture(_p7_sized(s, d), t(s, d, "mix_plan")),
    "p7_shares": lambda s, d: p7.mixture_shares(_p7_sized(s, d), t(s, d, "mix_plan")),
    "p8_found": lambda s, d: p8.sentence_units(t(s, d, "documents", "doc_id", "text", "source")),
}

ORACLE: dict[str, str] = {
    "p5_found": """
        WITH latest AS (
          SELECT subset, part, arg_max(row(tokens), row(written_at, run_id, tokens)) AS r FROM docs GROUP BY subset, part),
        per_doc AS (
          SELECT subset, part, doc_id, max(coalesce(tokens, end_off - start_off)) AS n FROM docs_idx GROUP BY ALL),
        sums AS (SELECT subset, part, sum(n) AS n FROM per_doc GROUP BY ALL)
        SELECT l.subset, l.part FROM latest l LEFT JOIN sums s
          ON l.subset IS NOT DISTINCT FROM s.subset AND l.part IS NOT DISTINCT FROM s.part
        WHERE l.r[1] IS NULL OR l.r[1] <> coalesce(s.n, 0)""",
}
