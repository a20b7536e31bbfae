"""Token offsets, validation split, weighted mixing, shards and the loader's plan over document lengths.

Running totals are two-level, so that no window holds a whole subset: sums of hash buckets, running totals over these
few rows, and a window inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lengths(docs_idx: DataFrame) -> DataFrame:
    """``subset, part, ord, doc_id, n_tokens``: each indexed document once; a missing length is the offsets' difference."""
    n = F.coalesce(F.col("tokens"), F.col("end_off") - F.col("start_off"))
    return docs_idx.groupBy("subset", "part", "doc_id").agg(F.min("ord").alias("ord"), F.max(n).alias("n_tokens"))


def doc_offsets(docs: DataFrame) -> DataFrame:
    """``start_off, end_off`` of each document in its part; a part is a bounded file."""
    upto = Window.partitionBy("subset", "part").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs.withColumn("end_off", F.sum("n_tokens").over(upto)).withColumn("start_off", F.col("end_off") - F.col("n_tokens"))


def shuffle_key(seed: int, *cols: str) -> Column:
    """A seeded order: the MD5 of seed and columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def running_totals(df: DataFrame, group: str | list[str], key: str, value: str, out: str = "before") -> DataFrame:
    """``df`` with the total of ``value`` over the rows of its group that come before it by ``key``, a hexadecimal hash.

    Keys must be distinct inside a group; the first three digits make the buckets.
    """
    return bucket_totals(df.withColumn("__bucket", F.substring(key, 1, 3)), [group] if isinstance(group, str) else group, [key], value, out)


def bucket_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the total of ``value`` before each row by ``order``, of which ``__bucket`` is a coarse form; the buckets
    are summed first, so that no window holds more than one of them."""
    sums = df.groupBy(*group, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, "__bucket"]).withColumn(out, F.col("__ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__bucket", "__ahead")


def split_validation(docs: DataFrame, val_tokens: int, seed: int = 0) -> DataFrame:
    """``docs`` with ``split``: of each subset the shortest prefix of a seeded order with ``val_tokens`` tokens is ``val``."""
    keyed = docs.withColumn("key", shuffle_key(seed, "subset", "doc_id"))
    return running_totals(keyed, "subset", "key", "n_tokens").withColumn("split", F.when(F.col("before") < val_tokens, "val").otherwise("train")).drop("before")


def mix_targets(train: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    """Of each weighted subset that has tokens: ``share`` of the mix, tokens to draw (``demand``), its own ``size``, ``docs``."""
    sizes = train.groupBy("subset").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs"))
    both = sizes.where("size > 0").join(weights.where("weight > 0").groupBy("subset").agg(F.sum("weight").alias("weight")), "subset")
    share = F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy()), 9)  # a row for each subset
    return both.select("subset", share.alias("share"), (share * total).alias("demand"), "size", "docs")


def mix_order(train: DataFrame, weights: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """The mix of ``total`` tokens: ``train`` with ``epoch`` and ``due``, once for each use of a document.

    A subset gives its share of the total; one that is too small is gone through again, in a new seeded order, and its
    last epoch is cut where the share is reached. ``due`` is the part of its subset's demand drawn before the document:
    sorted by it, every prefix of the mix has the target shares up to a document a subset.
    """
    copies = train.join(mix_targets(train, weights, total), "subset")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("demand") / F.col("size")) - 1, F.lit(0)).cast("bigint"))))
    keyed = copies.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed + 1)), F.col("epoch").cast("string"), "subset", F.col("doc_id").cast("string"))))
    timed = running_totals(keyed, ["subset", "epoch"], "key", "n_tokens").withColumn("from", F.col("epoch") * F.col("size") + F.col("before"))
    return timed.where(F.col("from") < F.col("demand")).withColumn("due", F.col("from") / F.col("demand")).drop("before", "from", "key", "demand", "size", "share", "docs")


#: Buckets of the mix's order; each is a range of it.
MIX_BUCKETS = 4096


def cut_shards(mixed: DataFrame, shard_tokens: int) -> DataFrame:
    """The mix with the tokens before each document (``start``) and its shard: documents stay whole, a shard begins with
    the first document that starts in its span."""
    placed = mixed.withColumn("__bucket", F.floor(F.col("due") * MIX_BUCKETS).cast("int"))
    return bucket_totals(placed, [], ["due", "subset", "epoch", "doc_id"], "n_tokens", "start").withColumn("shard", F.floor(F.col("start") / shard_tokens).cast("bigint"))


def pack_meta(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents, tokens, real and target share of each subset of a mix, and how often its documents were used."""
    sums = mixed.groupBy("subset").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    share = F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4)  # a row for each subset
    return sums.withColumn("share", share).join(targets.select("subset", F.round("share", 4).alias("target_share"), F.col("docs").alias("__docs")), "subset").withColumn("epochs", F.round(F.col("docs") / F.col("__docs"), 4)).drop("__docs")


def check_meta(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Parts whose latest record's total is not what their documents add up to, or whose tokenizer is not that of most parts."""
    last = records.groupBy("subset", "part").agg(F.max_by(F.struct("tokens", "tokenizer"), F.struct("written_at", "run_id", "tokens")).alias("r"))
    last = last.select("subset", "part", F.col("r.tokens").alias("recorded"), "r.tokenizer")
    usual = last.groupBy("tokenizer").agg(F.count("*").alias("n")).agg(F.max_by("tokenizer", F.struct("n", "tokenizer")).alias("usual"))
    sums = docs.groupBy("subset", "part").agg(F.sum("n_tokens").alias("actual"))
    both = last.join(sums, ["subset", "part"], "full_outer").join(usual, how="left")  # one row
    both = both.withColumn("same_tokenizer", F.col("tokenizer").eqNullSafe(F.col("usual"))).drop("tokenizer", "usual")
    return both.where(~F.col("recorded").eqNullSafe(F.col("actual")) | ~F.col("same_tokenizer"))


def usable_shards(shards: DataFrame, batch: int, length: int, world: int = 1) -> DataFrame:
    """Shards with a step's tokens at least; none at all is an error."""
    least = batch * length * world + 1
    usable = shards.where(F.col("n_tokens") >= least)
    if usable.isEmpty():
        raise ValueError(f"every shard is shorter than the {least} tokens of a step")
    return usable


def batch_plan(shards: DataFrame, batch: int, length: int, world: int = 1) -> DataFrame:
    """``shard key, step, offset`` of every step: a step reads ``batch * length * world + 1`` tokens and advances by one
    less; what does not fill a step is left. Shards too small for a step have none."""
    stride = batch * length * world
    steps = F.floor((F.col("n_tokens") - 1) / stride)
    return shards.where(F.col("n_tokens") >= stride + 1).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1))).withColumn("offset", F.col("step") * stride)


def rank_slices(plan: DataFrame, batch: int, length: int, world: int) -> DataFrame:
    """Where each rank reads in each step."""
    return plan.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1)))).withColumn("rank_offset", F.col("offset") + F.col("rank") * batch * length)


def epoch_order(shards: DataFrame, epoch: int, seed: int = 0) -> DataFrame:
    """Shards with the key that orders them in an epoch."""
    return shards.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), "subset", F.col("part").cast("string"))))


def loader_stream(shards: DataFrame, epochs: int, batch: int, length: int, world: int = 1, seed: int = 0) -> DataFrame:
    """The loader's one ordered stream: ``epoch, turn, step, offset`` and the shard's key of each step, steps numbered on
    through the shards in the order of each epoch. A loader that has done n steps resumes at step n.

    Only a row a shard and epoch is numbered in one window; the steps are made from these rows.
    """
    stride = batch * length * world
    every = shards.where(F.col("n_tokens") >= stride + 1).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = Window.orderBy("epoch", F.md5(F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), "subset", F.col("part").cast("string"))), "subset", "part")
    steps = F.floor((F.col("n_tokens") - 1) / stride)
    placed = every.withColumn("turn", F.row_number().over(order) - 1).withColumn("first", F.coalesce(F.sum(steps).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1))).select("epoch", "turn", "subset", "part", (F.col("first") + F.col("k")).alias("step"), (F.col("k") * stride).alias("offset"))


def shifted_pairs(tokens: DataFrame, length: int) -> DataFrame:
    """``x, y`` rows of ``length`` tokens of each document's token list; ``y`` is ``x`` one token later, rows share one."""
    rows = F.floor((F.size("tokens") - 1) / length).cast("int")
    long = tokens.where(F.size("tokens") > length).withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
    return long.withColumn("x", F.slice("tokens", F.col("row") * length + 1, length)).withColumn("y", F.slice("tokens", F.col("row") * length + 2, length)).drop("tokens")
