"""Mixing sources to target weights with a time-varying curriculum (problem 7).

Over the training time u from 0 to 1 every source has a schedule, a piecewise linear factor of its weight. At each u the
weighted factors of all sources are normalised to add up to 1, so u is the share of all tokens consumed; the weights are
fitted such that each source's rate, integrated over the time, is its planned total. The integrated demand of a source is
inverted for each drawn document: its training position is the time at which the demand reaches the middle of the
document. The draw is range-sorted by position.

Prefix sums of document sizes are two-level: sums of hash buckets, running totals of these few rows, and a window inside
each bucket. No window ever holds a whole source, so a source with a third of all documents costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from grainloom.llm.common import shared_checkpoint
from grainloom.llm.token_budget import count_tokens

#: Documents in a hash bucket, on average over the corpus; steepest tilt of a schedule that is made from the priority;
#: sources of a plan at most (it is collected and broadcast); steps in which schedules are integrated.
BUCKET_DOCS, STEEPEST, MOST_SOURCES, STEPS = 5_000, 0.8, 10_000, 512


def source_name(source: Column) -> Column:
    """Spellings that differ by case and blanks only are one source; a missing one is the empty name."""
    return F.lower(F.trim(F.coalesce(source, F.lit(""))))


def plan_targets(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """Target, capacity, draw and tilt of each planned source; ``sizes`` has ``source, n_docs, n_tokens``.

    Shares are relative to the summed weights of the planned sources that have documents, the total is ``draw_share`` of
    all documents' tokens, planned or not; a planned source without documents has share and target 0. A source that cannot supply its target within ``max_epochs`` gives all it can, and what it lacks is not made
    up by others. Rows of one source are added up (weights) or narrowed (epochs); null or negative weights count as 0,
    missing epochs as 1. Sources listed first in ``priority`` come late in training, the others early.
    """
    rows = plan.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.min(F.greatest(F.coalesce("max_epochs", F.lit(1)), F.lit(0))).alias("max_epochs"),
        F.min("priority").alias("priority"),
        F.max(F.coalesce("draw_share", F.lit(1.0))).alias("draw_share"),
    )
    everything = Window.partitionBy()  # over the plan's few rows
    rank = (F.row_number().over(Window.partitionBy().orderBy(F.col("priority").asc_nulls_last(), "source")) - 1) / F.greatest(F.count("*").over(everything) - 1, F.lit(1))
    rows = rows.withColumn("tilt", F.round(STEEPEST * (2 * rank - 1), 9))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    joined = rows.withColumn("all_tokens", F.lit(total)).join(sizes, "source", "left").na.fill({"n_docs": 0, "n_tokens": 0})
    there = F.when(F.col("n_tokens") > 0, F.col("weight")).otherwise(0.0)
    joined = joined.withColumn("share", F.coalesce(there / F.nullif(F.sum(there).over(everything), F.lit(0.0)), F.lit(0.0)))
    joined = joined.withColumn("target", F.coalesce(F.col("share") * F.col("draw_share") * F.col("all_tokens"), F.lit(0.0)))
    draw = F.least(F.col("target"), (F.col("n_tokens") * F.col("max_epochs")).cast("double"))
    return joined.withColumn("draw", draw).select("source", "share", "target", "draw", "tilt", "max_epochs", "priority", "n_docs", "n_tokens")


def sized_documents(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of each document once; without tokens a document cannot be drawn and is left out."""
    counted = count_tokens(documents.where("doc_id IS NOT NULL"), ["doc_id", "source"], ranks_path=ranks_path)
    once = counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.min(source_name(F.col("source"))).alias("source"))
    return shared_checkpoint(once.where("n_tokens > 0").select("doc_id", "source", "n_tokens"))


def demand_curves(totals: dict[str, float], factors: dict[str, list[tuple[float, float]]]) -> dict[str, np.ndarray]:
    """The share of each source's total that is due at each of `STEPS` + 1 equally spaced times.

    ``factors`` has the knots ``(time, factor)`` of each source's schedule; a source without knots is level. At every time
    the sources' rates add up to 1. The weights before the factors are fitted until each source's rates add up to its
    part of all totals; a source whose factor is 0 all the time keeps a level rate, as it must be drawn all the same.
    """
    names = [s for s, t in totals.items() if t > 0]
    if not names:
        return {}
    part = np.array([totals[s] for s in names])
    part /= part.sum()
    middle = (np.arange(STEPS) + 0.5) / STEPS
    shape = np.ones((len(names), STEPS))
    for k, s in enumerate(names):
        knots = sorted(factors.get(s) or [])
        if knots and max(y for _, y in knots) > 0:
            shape[k] = np.interp(middle, [x for x, _ in knots], [max(0.0, y) for _, y in knots])
            if not shape[k].any():
                shape[k] = 1.0
    # a time at which no schedule wants anything is filled by all of them
    shape[:, ~shape.any(axis=0)] = 1.0
    rate = shape * part[:, None]
    for _ in range(2_000):
        rate *= (part / np.maximum(rate.mean(axis=1), 1e-300))[:, None]
        rate /= rate.sum(axis=0)
        if np.abs(rate.mean(axis=1) - part).max() < 1e-9:
            break
    curves = np.concatenate([np.zeros((len(names), 1)), np.cumsum(rate, axis=1)], axis=1)
    return {s: curve / curve[-1] for s, curve in zip(names, curves)}


def draw_mixture(sized: DataFrame, plan: DataFrame, seed: int = 0, schedules: DataFrame | None = None) -> DataFrame:
    """The drawn documents ``(doc_id, source, epoch, n_tokens, position)``, range-sorted by training position.

    ``schedules`` has knots ``source, time, factor``; without it every source has the linear schedule that `plan_targets`
    makes from the priority. Each epoch has its own seeded order; whole epochs first, the last one up to the document in
    whose middle the target falls. Sources that the plan does not name are not drawn; planned ones without documents give
    nothing.
    """
    spark = sized.sparkSession
    sizes = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = plan_targets(plan, sizes).where("draw > 0").select("source", "draw", "tilt", F.col("n_tokens").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    factors: dict[str, list[tuple[float, float]]] = {r["source"]: [(0.0, 1 + r["tilt"]), (1.0, 1 - r["tilt"])] for r in rows}
    if schedules is not None:
        named = schedules.select(source_name(F.col("source")).alias("source"), F.col("time").cast("double"), F.col("factor").cast("double")).na.drop().limit(64 * MOST_SOURCES + 1).collect()
        if len(named) > 64 * MOST_SOURCES:
            raise ValueError("too many knots")
        factors = {}
        for r in named:
            factors.setdefault(r["source"], []).append((r["time"], r["factor"]))
    curves = spark.sparkContext.broadcast(demand_curves({r["source"]: float(r["draw"]) for r in rows}, factors))

    @F.pandas_udf(DoubleType())
    def position(source: pd.Series, share: pd.Series) -> pd.Series:
        out = np.zeros(len(source))
        names = source.to_numpy()
        for s in set(names):
            here = names == s
            out[here] = np.interp(share.to_numpy()[here], curves.value[s], np.linspace(0.0, 1.0, STEPS + 1))
        return pd.Series(out)

    targets = spark.createDataFrame([(r["source"], float(r["draw"]), int(r["size"])) for r in rows], "source string, draw double, size bigint")
    buckets = 1 + sized.count() // BUCKET_DOCS
    copies = sized.join(F.broadcast(targets), "source")  # `MOST_SOURCES` rows at most
    copies = copies.withColumn("epoch", F.explode(F.expr("sequence(0L, greatest(cast(ceil(draw / size) as bigint) - 1, 0L))")))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id")).withColumn("bucket", F.expr(f"pmod(shiftrightunsigned(h, 24), {buckets}L)"))
    ahead = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.join(sums, ["source", "epoch", "bucket"]).withColumn("start", F.col("epoch") * F.col("size") + F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    middle = F.col("start") + F.col("n_tokens") / 2
    drawn = placed.where(middle <= F.col("draw"))
    return drawn.select("doc_id", "source", "epoch", "n_tokens", position("source", F.least(middle / F.col("draw"), F.lit(1.0))).alias("position")).orderBy("position", "source", "epoch", "doc_id")


def mixture_shares(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """Of each planned source: planned and real share of the drawn tokens, target, draw, and how often it was used."""
    sizes = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    targets = plan_targets(plan, sizes)
    drawn = draw_mixture(sized, plan, seed).groupBy("source").agg(F.count("*").alias("drawn_docs"), F.sum("n_tokens").alias("drawn_tokens"), (F.max("epoch") + 1).alias("epochs"))
    out = targets.join(drawn, "source", "left").na.fill({"drawn_docs": 0, "drawn_tokens": 0, "epochs": 0})
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # over the plan's few rows
    real = F.when(total > 0, F.col("drawn_tokens") / total).otherwise(F.lit(0.0))
    return out.select("source", F.round("share", 6).alias("planned_share"), F.round(real, 6).alias("real_share"), F.round("target").cast("bigint").alias("target_tokens"), "drawn_tokens", "drawn_docs", F.col("n_tokens").alias("source_tokens"), "epochs", "max_epochs", ((F.col("target") > F.col("draw") + 0.5) | (F.col("n_tokens") == 0)).alias("lacking"))
