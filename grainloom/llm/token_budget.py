"""Token budget per source and language, and the audit of recorded token totals (problem 5).

Tokens are counted under a public tokenizer by the prefix-sharing trie of `bpe_trie`: every worker visits the trie of
the distinct pieces of its partition, and the terminal counts are joined to the documents where the pieces came from, so
no pair of document and piece is ever shuffled. All later steps move a few numbers per document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainloom.llm.bpe_trie import tokenizer_tables, worker_encoder
from grainloom.llm.common import map_batches, small_batches, tokenizer_file
from grainloom.llm.encode_corpus import RANKS


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row, and ``n_tokens`` and ``n_bytes`` (UTF-8) of its text.

    A null or empty text has 0 of both. Repeated rows stay repeated; other columns are neither read nor returned.
    """
    small_batches(df.sparkSession)
    tables = df.sparkSession.sparkContext.broadcast(tokenizer_tables(ranks_path or tokenizer_file(RANKS)))
    plain = df.select(*keep, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text_col).cast("string").alias("__text"))
    width = len(keep)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array(worker_encoder(tables).count(batch.column(width + 1).to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[: width + 1], n], [*keep, "n_bytes", "n_tokens"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[: width + 1])
    return map_batches(plain, count, f"{kept}, n_tokens bigint")


def language_code(lang: Column) -> Column:
    """Two-letter code of a language name spelled in any of the usual ways; ``und`` where it is missing or unknown."""
    base = F.lower(F.trim(F.split(F.coalesce(lang, F.lit("")), "[-_]").getItem(0)))
    three = {"eng": "en", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "ara": "ar", "jpn": "ja", "hin": "hi", "tha": "th"}
    known = F.create_map(*[F.lit(x) for pair in three.items() for x in pair])
    code = F.coalesce(F.try_element_at(known, base), base)
    return F.when(F.length(code) == 2, code).otherwise(F.lit("und"))


def once_per_document(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One whole row for each document id: of its deliveries the one with the longest text, then the most fields filled,
    then the greatest values. Rows without an id stay apart."""
    rest = [c for c in counted.columns if c != key]
    filled = sum((F.col(c).isNotNull().cast("int") for c in rest), F.lit(0))
    order = F.struct(F.col("n_bytes"), filled, *rest)
    # a row without an id is a group of its own, in the same pass as the others
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return counted.withColumn("__own", own).groupBy(key, "__own").agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def slice_totals(clean: DataFrame, documents: DataFrame, docs_idx: DataFrame, tokenizer_eval: DataFrame, tokenizer: str = "mt32k", ranks_path: str | None = None) -> DataFrame:
    """Totals by table, subset or source, language and domain, next to what others recorded.

    ``tokens`` is measured here; ``recorded_tokens`` sums ``docs_idx`` (null where nothing is recorded, as for
    ``documents``); ``expected_tokens`` applies the measured bytes a token of ``tokenizer`` to the slice's bytes, null for
    a slice that ``tokenizer_eval`` lacks. Every document id counts once. Missing languages are ``und``, missing domains
    and sources the empty string, spellings differ by case and blanks only are one. Empty tables give no rows.
    """
    name = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    counted_clean = once_per_document(count_tokens(clean, ["doc_id", "subset", "lang", "domain"], ranks_path=ranks_path))
    recorded = indexed_documents(docs_idx).groupBy("doc_id").agg(F.max("indexed").alias("recorded"))
    a = counted_clean.join(recorded, "doc_id", "left").select(F.lit("clean").alias("origin"), name("subset").alias("slice"), language_code(F.col("lang")).alias("lang"), name("domain").alias("domain"), "n_bytes", "n_tokens", "recorded")
    counted_docs = once_per_document(count_tokens(documents, ["doc_id", "source", "lang", "domain"], ranks_path=ranks_path))
    b = counted_docs.select(F.lit("documents").alias("origin"), name("source").alias("slice"), language_code(F.col("lang")).alias("lang"), name("domain").alias("domain"), "n_bytes", "n_tokens", F.lit(None).cast("bigint").alias("recorded"))
    totals = a.unionByName(b).groupBy("origin", "slice", "lang", "domain").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.sum("recorded").alias("recorded_tokens"))
    rates = tokenizer_eval.where(F.col("tokenizer") == tokenizer).groupBy(name("subset").alias("slice")).agg((F.sum("tokens") / F.sum("n_bytes")).alias("rate"))
    return totals.join(rates, "slice", "left").select("origin", "slice", "lang", "domain", "docs", "bytes", "tokens", "recorded_tokens", F.round(F.col("bytes") * F.col("rate")).cast("bigint").alias("expected_tokens"))


def indexed_documents(docs_idx: DataFrame) -> DataFrame:
    """Each document of a part once, with its indexed length: ``tokens``, else the offsets' difference, else null."""
    length = F.coalesce(F.col("tokens"), F.col("end_off") - F.col("start_off"))
    return docs_idx.groupBy("subset", "part", "doc_id").agg(F.max(length).alias("indexed"))


def latest_records(docs: DataFrame) -> DataFrame:
    """The most recently written record of each part; equal times fall to the greater run id, then the greater total."""
    order = F.struct("written_at", "run_id", "tokens")
    return docs.groupBy("subset", "part").agg(F.max_by(F.struct("tokens", "docs", "run_id"), order).alias("r")).select("subset", "part", F.col("r.tokens").alias("recorded"), F.col("r.docs").alias("recorded_docs"), F.col("r.run_id").alias("run_id"))


def audit_parts(clean: DataFrame, docs_idx: DataFrame, docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Each part's recorded total against its documents.

    ``indexed`` adds up ``docs_idx``, each document once; those with neither length nor offsets are counted in
    ``unindexed`` and add nothing. ``measured`` are the tokens of the part's documents under the public tokenizer, their
    end-of-text tokens included: another tokenizer's, so it is never added to ``indexed``. ``rate`` is the indexed over
    the measured tokens of the documents that have both. ``status`` is ``missing`` (no total recorded), ``differs`` or
    ``ok``. A part without indexed documents adds up to 0; null subsets or parts are parts of
    their own; repeated rows count once; empty tables give no rows.
    """
    measured = once_per_document(count_tokens(clean, ["doc_id"], ranks_path=ranks_path)).select("doc_id", (F.col("n_tokens") + 1).alias("measured"))
    per_doc = indexed_documents(docs_idx).join(measured, "doc_id", "left")
    sums = per_doc.groupBy("subset", "part").agg(F.count("*").alias("indexed_docs"), F.count_if(F.col("indexed").isNull()).alias("unindexed"), F.sum("indexed").alias("indexed"), F.sum("measured").alias("measured"), F.round(F.sum(F.when(F.col("measured").isNotNull(), F.col("indexed"))) / F.sum(F.when(F.col("indexed").isNotNull(), F.col("measured"))), 6).alias("rate"))
    records, sums = latest_records(docs).alias("r"), sums.alias("s")
    joined = records.join(sums, F.col("r.subset").eqNullSafe(F.col("s.subset")) & F.col("r.part").eqNullSafe(F.col("s.part")), "left")
    total = F.coalesce("s.indexed", F.lit(0))
    status = F.when(F.col("r.recorded").isNull(), "missing").when(F.col("r.recorded") != total, "differs").otherwise("ok")
    return joined.select("r.subset", "r.part", "r.run_id", "r.recorded_docs", F.coalesce("s.indexed_docs", F.lit(0)).alias("indexed_docs"), "r.recorded", total.alias("indexed"), F.coalesce("s.unindexed", F.lit(0)).alias("unindexed"), F.coalesce("s.measured", F.lit(0)).alias("measured"), "s.rate", status.alias("status"))


def wrong_totals(audit: DataFrame) -> DataFrame:
    """Parts of `audit_parts` whose recorded total is missing or wrong."""
    return audit.where(F.col("status") != "ok").select("subset", "part")


#: How many times greater or smaller than its subset's a document's rate of recorded to measured tokens must be to be odd.
ODD = 3.0


def odd_lengths(clean: DataFrame, docs_idx: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``subset, part, doc_id, indexed, measured, rate``: documents whose indexed length does not fit their text.

    A document's rate is its indexed length over its measured tokens, both with the end-of-text token; it is odd when it
    is `ODD` times the rate of its whole subset, or less than one part in `ODD` of it. Documents without a length or text
    are left out, each document counts once a part, empty tables give no rows.
    """
    measured = once_per_document(count_tokens(clean, ["doc_id"], ranks_path=ranks_path)).where("n_tokens > 0").select("doc_id", (F.col("n_tokens") + 1).alias("measured"))
    both = indexed_documents(docs_idx).where("indexed IS NOT NULL").join(measured, "doc_id")
    usual = both.groupBy("subset").agg((F.sum("indexed") / F.sum("measured")).alias("usual")).alias("u")
    rate = F.col("indexed") / F.col("measured")
    joined = both.alias("b").join(usual, F.col("b.subset").eqNullSafe(F.col("u.subset")))
    return joined.where((rate > ODD * F.col("usual")) | (rate * ODD < F.col("usual"))).select("b.subset", "part", "doc_id", "indexed", "measured", F.round(rate, 6).alias("rate"))
