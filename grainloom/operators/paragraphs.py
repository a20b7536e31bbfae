"""Exact removal of paragraphs that many documents share; the first occurrence in rank order stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainloom.functions import text as T

#: Characters from which a paragraph counts, documents that make it common, characters a stripped document must keep.
LEAST_CHARS, COMMON_DOCS, LEAST_KEPT = 30, 3, 200


#: Parts into which the places of a key are dealt when keys are joined; a paragraph of a third of all documents is none
#: too many for a task then.
SALTS = 16


def _pieces(text, separator: str):
    """The pieces between blank lines, zipped with the separators after them."""
    return F.arrays_zip(F.split(text, separator).alias("para"), F.regexp_extract_all(text, F.lit(f"({separator})"), 1).alias("sep"))


def paragraphs(docs: DataFrame, rank: str = "doc_rank", text: str = "text", separator: str = "\n{2,}", compatibility: bool = True) -> DataFrame:
    """``doc_rank, idx, para, sep, key``: the pieces between blank lines, each with the separator after it; ``key`` is the
    MD5 of the normalised text of those long enough, else null. Null texts give nothing."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(rank).alias("doc_rank"), F.posexplode(_pieces(F.col(text), separator)).alias("idx", "p")).select("doc_rank", "idx", "p.para", F.coalesce("p.sep", F.lit("")).alias("sep"))
    key = F.when(F.length(T.strip("para")) >= LEAST_CHARS, F.md5(T.normalize("para", compatibility)))
    return rows.withColumn("key", key)


def paragraph_keys(docs: DataFrame, **options) -> DataFrame:
    """``doc_rank, idx, key`` of the paragraphs that count: what is compared and moved, without their texts."""
    return paragraphs(docs, **options).where("key IS NOT NULL").select("doc_rank", "idx", "key")


def common_paragraphs(keys: DataFrame, least: int = COMMON_DOCS) -> DataFrame:
    """``key, docs``: keys that at least so many documents hold."""
    return keys.where("key IS NOT NULL").select("doc_rank", "key").distinct().groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def later_occurrences(keys: DataFrame, common: DataFrame) -> DataFrame:
    """``doc_rank, gone, removed``: the places of each document's common paragraphs that stand somewhere before, and their
    number. An aggregate finds each key's first place, so no key's places are ever gathered in one task."""
    every = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keys.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_rank), {SALTS}) as int)"))
    places = salted.join(every(common.select("key")), ["key", "salt"])
    first = places.groupBy("key").agg(F.min(F.struct("doc_rank", "idx")).alias("first"))
    gone = places.join(every(first), ["key", "salt"]).where(F.struct("doc_rank", "idx") != F.col("first"))
    return gone.groupBy("doc_rank").agg(F.collect_set("idx").alias("gone"), F.count("*").alias("removed"))


def without_places(text, gone, separator: str = "\n{2,}"):
    """The text without the pieces at the places ``gone`` (null for none) and without blank lines at its ends."""
    left = F.filter(F.transform(_pieces(text, separator), lambda p, i: F.struct(i.alias("i"), F.concat(p["para"], F.coalesce(p["sep"], F.lit(""))).alias("s"))), lambda p: ~F.array_contains(gone, p["i"]))
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(left, lambda p: p["s"]), ""))
    return F.regexp_replace(kept, "^\n+|\n+\\z", "")


def strip_paragraphs(docs: DataFrame, compatibility: bool = True) -> DataFrame:
    """``doc_rank, text, removed``: the documents without the later occurrences of their common paragraphs. Texts are
    joined once, with the places that go; those that lose nothing are not taken apart."""
    docs = docs.where("text IS NOT NULL").select("doc_rank", "text")
    keys = paragraph_keys(docs, compatibility=compatibility)
    joined = docs.join(later_occurrences(keys, common_paragraphs(keys)), "doc_rank", "left")
    return joined.select("doc_rank", without_places(F.col("text"), F.col("gone")).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))
