"""Queries of the cleaning pipeline, of packing and of the loader, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.operators import packing as pk
from grainloom.operators import pipeline as pl
from grainloom.plans import decontam_queries as dq
from grainloom.plans import dedup_queries as ddq
from grainloom.plans import filter_queries as fq
from grainloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]

#: Added to a planted copy's place in its part.
LATER = 1 << 30

VAL_TOKENS, SHARD_TOKENS, BATCH, LENGTH, WORLD = 2_000, 20_000, 4, 128, 2


def documents(s: SparkSession, d: str) -> DataFrame:
    """Each document of the cleaned corpus once, and the planted near copies, with their ranks."""
    df = t(s, d, "clean", "doc_id", "subset", "part", "pos", "text").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("subset", "part", "pos", "text")])
    copies = ddq.planted(df, "doc_id").withColumn("doc_id", F.col("doc_id") + ddq.PLANTED).withColumn("pos", F.coalesce("pos", F.lit(0)) + LATER)
    return df.unionByName(copies).withColumn("doc_rank", pl.document_rank(F.col("subset"), F.col("part"), F.col("pos")))


def _fetched(s: SparkSession, d: str, grams: bool = True) -> DataFrame:
    return pl.fetch_stage(documents(s, d), grams=grams)


def _status(s: SparkSession, d: str, grams: bool = True) -> DataFrame:
    return pl.clean_status(_fetched(s, d, grams), dq.index(s, d), compatibility=False, kind="md5")


def _funnel(s: SparkSession, d: str, grams: bool = True) -> DataFrame:
    return pl.funnel(documents(s, d), _fetched(s, d, grams), _status(s, d, grams))


def _shown(status: DataFrame) -> DataFrame:
    return status.select("doc_rank", "subset", F.md5("text").alias("text_md5"), "removed", "status")


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return pk.lengths(t(s, d, "docs_idx"))


def _weights(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "mix_plan", "source", "weight").withColumnRenamed("source", "subset")


def _train(s: SparkSession, d: str) -> DataFrame:
    return pk.split_validation(_lengths(s, d), VAL_TOKENS).where("split = 'train'").drop("key", "split")


def _shards(s: SparkSession, d: str) -> DataFrame:
    """Tokenised parts as shards."""
    return _lengths(s, d).groupBy("subset", "part").agg(F.sum("n_tokens").alias("n_tokens"))


def _total(s: SparkSession, d: str) -> int:
    """Tokens of the mix: half as much again as there are, so that subsets are gone through more than once."""
    return 3 * int(_train(s, d).agg(F.sum("n_tokens")).first()[0] or 0) // 2


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return pk.mix_order(_train(s, d), _weights(s, d), _total(s, d))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return pk.cut_shards(_mixed(s, d), SHARD_TOKENS)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Rows of input and target; the lengths of a text's words stand for its tokens."""
    tokens = t(s, d, "documents", "doc_id", "text").select("doc_id", F.transform(F.split("text", " "), F.length).alias("tokens"))
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return pk.shifted_pairs(tokens, LENGTH).select("doc_id", F.col("row").cast("bigint").alias("row"), shown("x"), shown("y"))


_LEN = "len AS (SELECT subset, part, doc_id, min(ord) AS ord, max(coalesce(tokens, end_off - start_off)) AS n_tokens FROM docs_idx GROUP BY subset, part, doc_id)"


def _before(seed: int, source: str) -> str:
    key = f"md5('{seed}:' || subset || ':' || doc_id)"
    return f"SELECT *, {key} AS key, coalesce(sum(n_tokens) OVER (PARTITION BY subset ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {source}"


_SPLIT = f"{_LEN}, sp AS (SELECT *, CASE WHEN before < {VAL_TOKENS} THEN 'val' ELSE 'train' END AS split FROM ({_before(0, 'len')}))"
_TRAIN = f"{_SPLIT}, train AS (SELECT subset, part, ord, doc_id, n_tokens FROM sp WHERE split = 'train')"
_SHARDS = f"{_LEN}, shards AS (SELECT subset, part, sum(n_tokens)::BIGINT AS n_tokens FROM len GROUP BY ALL)"
_MIX = f"""{_TRAIN}, total AS (SELECT 3 * sum(n_tokens)::BIGINT // 2 AS total FROM train), sz AS (SELECT subset, sum(n_tokens)::BIGINT AS size, count(*) AS docs FROM train GROUP BY ALL),
    wt AS (SELECT source AS subset, sum(weight) AS weight FROM mix_plan WHERE weight > 0 GROUP BY ALL),
    tg AS (SELECT subset, round(weight / sum(weight) OVER (), 9) AS share, size, docs FROM sz JOIN wt USING (subset) WHERE size > 0),
    tgt AS (SELECT *, share * total AS demand FROM tg, total),
    cp AS (SELECT train.*, size, demand, unnest(range(0, greatest(ceil(demand / size)::BIGINT, 1))) AS epoch FROM train JOIN tgt USING (subset)),
    ck AS (SELECT *, md5('1:' || epoch || ':' || subset || ':' || doc_id) AS key FROM cp),
    fr AS (SELECT *, epoch * size + coalesce(sum(n_tokens) OVER (PARTITION BY subset, epoch ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM ck),
    mix AS (SELECT subset, doc_id, n_tokens, epoch, f / demand AS due FROM fr WHERE f < demand),
    cut AS (SELECT *, (coalesce(sum(n_tokens) OVER (ORDER BY due, subset, epoch, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {SHARD_TOKENS})::BIGINT AS shard FROM mix)"""
_STRIDE = BATCH * LENGTH * WORLD
_PLAN = f"{_SHARDS}, plan AS (SELECT subset, part, step, step * {_STRIDE} AS offset FROM (SELECT subset, part, unnest(range(0, (n_tokens - 1) // {_STRIDE})) AS step FROM shards WHERE n_tokens >= {_STRIDE + 1}))"

_STREAM = f"""{_SHARDS}, o AS (SELECT epoch::INT AS epoch, subset, part, n_tokens, (n_tokens - 1) // {_STRIDE} AS steps FROM shards, range(0, 2) e(epoch) WHERE n_tokens >= {_STRIDE + 1}),
    n AS (SELECT *, row_number() OVER w - 1 AS turn, coalesce(sum(steps) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM o
        WINDOW w AS (ORDER BY epoch, md5(epoch || ':' || subset || ':' || part), subset, part)),
    stream AS (SELECT epoch, turn, subset, part, first + k AS step, k * {_STRIDE} AS "offset" FROM (SELECT *, unnest(range(0, steps)) AS k FROM n))"""

_RANK = "CASE subset " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(pl.PRIORITY)) + f" ELSE {len(pl.PRIORITY)} END * 72057594037927936 + coalesce(part, 0) * 4294967296 + coalesce(pos, 0)"
_COPIED, _COPY = ddq.planted_sql("doc_id")
_FETCH = f"""raw2 AS (SELECT doc_id, min(subset) AS subset, min(part) AS part, min(pos) AS pos, min(text) AS text FROM clean GROUP BY doc_id),
    raw AS (SELECT * FROM raw2 UNION ALL SELECT doc_id + {ddq.PLANTED}, subset, part, coalesce(pos, 0) + {LATER}, {_COPY} FROM raw2 WHERE {_COPIED}),
    {fq.BASE_SQL.replace("FROM clean", "FROM raw")}, fs AS (SELECT doc_id, {fq.subset_case_sql()} AS reason FROM m),
    fetched AS (SELECT ({_RANK})::BIGINT AS doc_rank, raw.* FROM raw JOIN fs USING (doc_id) WHERE reason IS NULL AND text IS NOT NULL)"""
_STATUS_CORE = f"""{_FETCH}, {dq._ITEMS}, ct AS (SELECT doc_rank AS key, text AS t FROM fetched), {dq.windows_sql("ct", "cw")},
    contam AS (SELECT key AS doc_rank, arg_min(bench, i) AS bench FROM cw JOIN idx USING (gram) GROUP BY key),
    fd AS (SELECT doc_rank AS doc_id, coalesce(starts_with(subset, 'zh'), false) AS zh, {dq.NORM_SQL.format("text")} AS n FROM fetched), {ddq.classes_sql("fd")},
    reps AS (SELECT fd.doc_id AS doc_rank, coalesce(c.root, once.doc_rank) AS rep FROM fd JOIN once USING (n) LEFT JOIN c ON c.node = once.doc_rank),
    cd AS (SELECT doc_rank AS doc_id, subset, text FROM fetched),
    {dq.PARAS_SQL},
    flag AS (SELECT f.doc_rank, subset, text, CASE WHEN rep <> f.doc_rank THEN 'near_dup' WHEN bench IS NOT NULL THEN 'contam:' || bench END AS status
        FROM fetched f JOIN reps USING (doc_rank) LEFT JOIN contam USING (doc_rank)),
    el AS (SELECT p.* FROM paras p JOIN flag USING (doc_rank) WHERE status IS NULL),
    mark AS (SELECT el.*, c.key IS NOT NULL AND row_number() OVER (PARTITION BY el.key ORDER BY doc_rank, idx) > 1 AS gone FROM el LEFT JOIN common c USING (key)),
    st AS (SELECT doc_rank, regexp_replace(coalesce(string_agg(para || sep, '' ORDER BY idx) FILTER (NOT gone), ''), '^\\n+|\\n+\\z', '', 'g') AS left_text, count(*) FILTER (gone) AS removed FROM mark GROUP BY doc_rank),
    status AS (SELECT flag.doc_rank, subset, coalesce(left_text, text) AS text, coalesce(removed, 0) AS removed,
        coalesce(status, CASE WHEN left_text IS NOT NULL AND length({dq.strip_sql("left_text")}) < 200 THEN 'too_short' ELSE 'kept' END) AS status FROM flag LEFT JOIN st USING (doc_rank))"""

QUERIES: dict[str, Query] = {
    "stage_fetch": lambda s, d: _fetched(s, d).select("doc_rank", "doc_id", "subset"),
    "clean_status": lambda s, d: _shown(_status(s, d)),
    "clean_stats": lambda s, d: pl.clean_stats(_status(s, d)),
    "funnel": _funnel,
    # without the n-gram rules, which SQL does not express
    "stage_fetch_plain": lambda s, d: _fetched(s, d, False).select("doc_rank", "doc_id", "subset"),
    "clean_status_plain": lambda s, d: _shown(_status(s, d, False)),
    "clean_stats_plain": lambda s, d: pl.clean_stats(_status(s, d, False)),
    "funnel_plain": lambda s, d: _funnel(s, d, False),
    "doc_offsets": lambda s, d: pk.doc_offsets(_lengths(s, d)).select("subset", "part", "ord", "doc_id", "n_tokens", "start_off", "end_off"),
    "split_val": lambda s, d: pk.split_validation(_lengths(s, d), VAL_TOKENS).select("subset", "doc_id", "n_tokens", "split"),
    "mix_schedule": lambda s, d: _mixed(s, d).select("subset", "doc_id", "epoch", F.round("due", 6).alias("due")),
    "mix_epochs": lambda s, d: _mixed(s, d).groupBy("subset", "epoch").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")),
    "shard_assign": lambda s, d: _assigned(s, d).select("subset", "doc_id", "epoch", "shard"),
    "shard_totals": lambda s, d: _assigned(s, d).groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")),
    "pack_meta": lambda s, d: pk.pack_meta(_mixed(s, d), pk.mix_targets(_train(s, d), _weights(s, d), _total(s, d))),
    "check_meta": lambda s, d: pk.check_meta(t(s, d, "docs"), _lengths(s, d)),
    "usable_shards": lambda s, d: pk.usable_shards(_shards(s, d), BATCH, LENGTH, WORLD),
    "epoch_order": lambda s, d: pk.epoch_order(_shards(s, d), 3),
    "batch_plan": lambda s, d: pk.batch_plan(_shards(s, d), BATCH, LENGTH, WORLD).select("subset", "part", "step", "offset"),
    "rank_slices": lambda s, d: pk.rank_slices(pk.batch_plan(_shards(s, d), BATCH, LENGTH, WORLD), BATCH, LENGTH, WORLD).select("subset", "part", "step", "rank", "rank_offset"),
    "loader_stream": lambda s, d: pk.loader_stream(_shards(s, d), 2, BATCH, LENGTH, WORLD),
    "resume_stream": lambda s, d: pk.loader_stream(_shards(s, d), 2, BATCH, LENGTH, WORLD).where("step >= 5"),
    "xy_pairs": _pairs,
    "eval_batches": lambda s, d: pk.batch_plan(_shards(s, d), BATCH, LENGTH, WORLD).where("step < 2").select("subset", "part", "step", "offset"),
}

ORACLE: dict[str, str] = {
    "stage_fetch_plain": f"WITH {_FETCH} SELECT doc_rank, doc_id, subset FROM fetched",
    "clean_status_plain": f"WITH RECURSIVE {_STATUS_CORE} SELECT doc_rank, subset, md5(text) AS text_md5, removed, status FROM status",
    "clean_stats_plain": f"WITH RECURSIVE {_STATUS_CORE} SELECT subset, status, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, sum(removed)::BIGINT AS removed FROM status GROUP BY ALL",
    "funnel_plain": f"""WITH RECURSIVE {_STATUS_CORE}, a AS (SELECT subset, count(*) AS read FROM raw GROUP BY ROLLUP (subset)), b AS (SELECT subset, count(*) AS filtered FROM fetched GROUP BY ROLLUP (subset)),
        c3 AS (SELECT subset, count(*) AS cleaned FROM status WHERE status = 'kept' GROUP BY ROLLUP (subset)),
        j AS (SELECT a.subset, read, coalesce(filtered, 0) AS filtered, coalesce(cleaned, 0) AS cleaned FROM a LEFT JOIN b ON a.subset IS NOT DISTINCT FROM b.subset LEFT JOIN c3 ON a.subset IS NOT DISTINCT FROM c3.subset)
        SELECT *, round(filtered / greatest(read, 1)::DOUBLE, 6) AS filter_rate, round(cleaned / greatest(filtered, 1)::DOUBLE, 6) AS clean_rate FROM j""",
    "doc_offsets": f"""WITH {_LEN} SELECT *, (sum(n_tokens) OVER w)::BIGINT AS end_off, (sum(n_tokens) OVER w)::BIGINT - n_tokens AS start_off FROM len
        WINDOW w AS (PARTITION BY subset, part ORDER BY ord, doc_id)""",
    "split_val": f"WITH {_SPLIT} SELECT subset, doc_id, n_tokens, split FROM sp",
    "mix_schedule": f"WITH {_MIX} SELECT subset, doc_id, epoch, round(due, 6) AS due FROM mix",
    "mix_epochs": f"WITH {_MIX} SELECT subset, epoch, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM mix GROUP BY ALL",
    "shard_assign": f"WITH {_MIX} SELECT subset, doc_id, epoch, shard FROM cut",
    "shard_totals": f"WITH {_MIX} SELECT shard, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM cut GROUP BY ALL",
    "pack_meta": f"""WITH {_MIX}, a AS (SELECT subset, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM mix GROUP BY ALL)
        SELECT subset, a.docs, tokens, round(tokens / (sum(tokens) OVER ())::DOUBLE, 4) AS share, round(tgt.share, 4) AS target_share, round(a.docs / tgt.docs::DOUBLE, 4) AS epochs FROM a JOIN tgt USING (subset)""",
    "check_meta": f"""WITH {_SHARDS}, l AS (SELECT subset, part, arg_max(row(tokens, tokenizer), row(written_at, run_id, tokens)) AS r FROM docs GROUP BY ALL),
        u AS (SELECT arg_max(tokenizer, row(n, tokenizer)) AS usual FROM (SELECT r[2] AS tokenizer, count(*) AS n FROM l GROUP BY ALL)),
        j AS (SELECT coalesce(l.subset, s.subset) AS subset, coalesce(l.part, s.part) AS part, l.r[1] AS recorded, s.n_tokens AS actual, l.r[2] IS NOT DISTINCT FROM usual AS same_tokenizer
            FROM l FULL JOIN shards s ON l.subset = s.subset AND l.part = s.part CROSS JOIN u)
        SELECT * FROM j WHERE recorded IS DISTINCT FROM actual OR NOT same_tokenizer""",
    "usable_shards": f"WITH {_SHARDS} SELECT * FROM shards WHERE n_tokens >= {_STRIDE + 1}",
    "epoch_order": f"WITH {_SHARDS} SELECT *, md5('3:' || subset || ':' || part) AS key FROM shards",
    "batch_plan": f'WITH {_PLAN} SELECT subset, part, step, "offset" FROM plan'.replace("AS offset", 'AS "offset"'),
    "rank_slices": f'WITH {_PLAN} SELECT subset, part, step, r AS rank, "offset" + r * {BATCH * LENGTH} AS rank_offset FROM plan, range(0, {WORLD}) q(r)'.replace("AS offset", 'AS "offset"'),
    "loader_stream": f"WITH {_STREAM} SELECT * FROM stream",
    "resume_stream": f"WITH {_STREAM} SELECT * FROM stream WHERE step >= 5",
    "xy_pairs": f"""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS t FROM documents WHERE text IS NOT NULL),
        r AS (SELECT *, unnest(range(0, (len(t) - 1) // {LENGTH})) AS row FROM w WHERE len(t) > {LENGTH})
        SELECT doc_id, row, array_to_string(t[row * {LENGTH} + 1:row * {LENGTH} + {LENGTH}], ',') AS x, array_to_string(t[row * {LENGTH} + 2:row * {LENGTH} + {LENGTH} + 1], ',') AS y FROM r""",
    "eval_batches": f'WITH {_PLAN} SELECT subset, part, step, "offset" FROM plan WHERE step < 2'.replace("AS offset", 'AS "offset"'),
}
