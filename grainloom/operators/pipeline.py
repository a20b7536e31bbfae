"""The cleaning decision of a corpus, and the reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import decontam, dedup, filters, paragraphs
from grainloom.operators.lineage import shared_checkpoint

#: Order in which subsets are cleaned: what comes first survives among near duplicates and repeated paragraphs.
PRIORITY = ("en_wiki", "zh_wiki", "math", "code", "en_web", "en_web_dclm", "zh_web")


def document_rank(subset: Column, part: Column, pos: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """Order of cleaning as one number: priority of the subset, part, place in it. No window over all rows is needed.

    Parts and places must be below 2^24 and 2^32; subsets outside the list come last.
    """
    place = F.lit(len(priority))
    for i, name in enumerate(priority):
        place = F.when(subset == name, i).otherwise(place)
    return F.shiftleft(place.cast("bigint"), 56) + F.shiftleft(F.coalesce(part, F.lit(0)).cast("bigint"), 32) + F.coalesce(pos, F.lit(0)).cast("bigint")


def fetch_stage(docs: DataFrame, grams: bool = True) -> DataFrame:
    """Documents that pass their subset's filters, null texts never."""
    return filters.apply_filters(docs, grams=grams).where("reason IS NULL AND text IS NOT NULL").drop("reason")


def clean_status(docs: DataFrame, index: DataFrame, compatibility: bool = True, kind: str = "crc32") -> DataFrame:
    """``doc_rank, subset, text, removed, status`` of filtered documents.

    In this order: near duplicate of a better ranked document, contaminated, too short once repeated paragraphs are gone,
    kept. Paragraphs are common by the documents before deduplication; first occurrences are taken among those that are
    neither duplicates nor contaminated, also when they are then too short. Code keeps its paragraphs.

    Ids, flags and paragraph keys are what the steps exchange; the texts are met once more, at the end.
    """
    docs = shared_checkpoint(docs.select("doc_rank", "subset", "text"))
    reps = dedup.near_duplicates(docs, compatibility=compatibility, kind=kind, subset="subset")
    bad = decontam.contaminated(docs, index, key="doc_rank", compatibility=compatibility)
    verdict = F.when(F.col("rep") != F.col("doc_rank"), "near_dup").when(F.col("bench").isNotNull(), F.concat(F.lit("contam:"), "bench"))
    flags = shared_checkpoint(reps.join(bad, "doc_rank", "left").select("doc_rank", verdict.alias("verdict")))
    keys = shared_checkpoint(paragraphs.paragraph_keys(docs.where("subset <> 'code'"), compatibility=compatibility))
    eligible = keys.join(flags.where("verdict IS NULL"), "doc_rank", "left_semi")
    gone = paragraphs.later_occurrences(eligible, paragraphs.common_paragraphs(keys))
    joined = docs.join(flags.join(gone, "doc_rank", "left"), "doc_rank")
    stripped = F.when(F.col("verdict").isNull() & (F.col("subset") != "code"), paragraphs.without_places(F.col("text"), F.col("gone")))
    out = joined.select("doc_rank", "subset", "text", stripped.alias("left"), F.coalesce("removed", F.lit(0)).alias("removed"), "verdict")
    short = F.col("left").isNotNull() & (F.length(T.strip("left")) < paragraphs.LEAST_KEPT)
    return out.select("doc_rank", "subset", F.coalesce("left", "text").alias("text"), "removed", F.coalesce("verdict", F.when(short, "too_short").otherwise("kept")).alias("status"))


def clean_stats(status: DataFrame) -> DataFrame:
    """Documents, bytes and removed paragraphs of each subset and status."""
    return status.groupBy("subset", "status").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.sum("removed").cast("bigint").alias("removed"))


def funnel(read: DataFrame, filtered: DataFrame, status: DataFrame) -> DataFrame:
    """Documents read, kept by the filters and kept by cleaning, of each subset and in all (null subset)."""
    a = read.rollup("subset").agg(F.count("*").alias("read"))
    b = filtered.rollup("subset").agg(F.count("*").alias("filtered"))
    c = status.where("status = 'kept'").rollup("subset").agg(F.count("*").alias("cleaned"))
    out = a.join(b, a["subset"].eqNullSafe(b["subset"]), "left").drop(b["subset"])
    out = out.join(c, a["subset"].eqNullSafe(c["subset"]), "left").drop(c["subset"]).na.fill(0, ["filtered", "cleaned"])
    ratio = lambda x, y: F.round(F.col(x) / F.greatest(F.col(y), F.lit(1)), 6)
    return out.withColumn("filter_rate", ratio("filtered", "read")).withColumn("clean_rate", ratio("cleaned", "filtered"))
