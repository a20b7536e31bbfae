"""Queries of sources, tokens, analytics and sizing, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import analytics as an
from grainloom.operators import filters as fl
from grainloom.operators import tokens as tk
from grainloom.plans import filter_queries as fq
from grainloom.sources import catalogue as sc
from grainloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]


def clean(s: SparkSession, d: str) -> DataFrame:
    """Each document of the cleaned corpus once."""
    return t(s, d, "clean", "doc_id", "subset", "part", "pos", "text").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("subset", "part", "pos", "text")])


def code(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "code", "file_id", "language", "size", "code").distinct()


#: Small tables of runs and models (public figures), as rows in both dialects.
MODELS = """SELECT * FROM (VALUES ('250m', 32768, 1024, 18, 4, 64, 2816, 'swiglu', false, true, 2048), ('qk', 32768, 1024, 18, 4, 64, 2816, 'swiglu', true, true, 2048),
    ('gelu', 32768, 512, 8, 8, 64, 2048, 'gelu', false, false, 1024)) m(name, vocab_size, d_model, n_layers, n_kv_heads, head_dim, ffn_hidden, activation, qk_norm, tied, seq_len)"""
METRICS = """SELECT * FROM (VALUES ('a', 1, 'train', 100, 1000, 4.0, 9.5, 0.5, NULL), ('a', 2, 'train', 300, 3000, 3.5, 1.5, 0.7, NULL), ('a', 3, 'eval', 300, 3000, NULL, NULL, NULL, 3.6),
    ('a', 4, 'train', 400, 4000, 3.4, NULL, 0.6, NULL), ('a', 5, 'eval', 400, 4000, NULL, NULL, NULL, 3.41), ('b', 1, 'eval', 10, 100, NULL, NULL, NULL, 5.5),
    ('c', 1, 'train', 300, 3000, 3.6, 2.5, 0.7, NULL), ('c', 2, 'train', 300, 3000, 3.51, 2.5, 0.7, NULL), ('c', 3, 'train', 400, 4000, 3.41, 1.0, 0.6, NULL))
    m(run, line_no, type, step, tokens, loss, grad_norm, step_s, val_loss)"""
SEEDS = "SELECT * FROM (VALUES ('s0', 3.4101), ('s1', 3.4060), ('s2', 3.4142)) x(name, loss)"
RUNS = "SELECT * FROM (VALUES ('muon', 3.3373), ('qk', 3.4120), ('gelu', 3.4300)) x(name, loss)"
POINTS = "SELECT * FROM (VALUES (9.44e6, 4.0797), (22.55e6, 3.5302), (74.34e6, 3.0174)) x(n, loss)"
SPEED = "SELECT * FROM (VALUES ('s1', 524288, 2.85, 1.87e8, 3.12e14, 1), ('s2', 524288, 2.53, 3.1e8, 3.12e14, 2)) x(run, batch_tokens, step_s, flops, peak_flops, world)"
JOBS = "SELECT * FROM (VALUES ('short', 12.0), ('mid', 284.9), ('long', 900.5)) x(run, train_min)"
CKPTS = "SELECT * FROM (VALUES ('a', 100), ('a', 200), ('a', 300), ('a', 400), ('a', 500), ('b', 250), ('b', 1000)) x(run, step)"

SUBSET_LOSS = """SELECT * FROM (VALUES ('s0', 'en_web', 3.2), ('s1', 'en_web', 3.22), ('s2', 'en_web', 3.19), ('s0', 'zh_web', 3.9), ('s1', 'zh_web', 3.95), ('s2', 'zh_web', 3.92), ('s0', 'en_wiki', 2.9),
    ('s1', 'en_wiki', 2.91), ('s2', 'en_wiki', 2.92), ('muon', 'en_web', 3.1), ('muon', 'zh_web', 3.91), ('muon', 'code', 1.5)) x(name, subset, loss)"""
ACCUMULATION = "SELECT * FROM (VALUES ('a', 524288, 16, 2048, 1), ('b', 524288, 16, 2048, 8), ('c', 500000, 16, 2048, 1)) x(run, batch_tokens, micro_batch, seq_len, world)"
EXPECTED = "SELECT * FROM (VALUES ('250m', 236491776), ('gelu', 99000000)) x(name, expected)"


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if kind in ("double", "float") or kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def _sql(s: SparkSession, text: str) -> DataFrame:
    return _doubles(s.sql(text))


def _files(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "clean", "subset", "part").distinct()


def _done(s: SparkSession, d: str) -> DataFrame:
    """Parts whose latest record is whole, all but the last part of each subset: that one counts as broken off."""
    latest = t(s, d, "docs").groupBy("subset", "part").agg(F.max_by(F.struct("tokens", "docs"), F.struct("written_at", "run_id", "tokens")).alias("r"))
    last = _files(s, d).groupBy("subset").agg(F.max("part").alias("last"))
    return latest.where("r.tokens IS NOT NULL AND r.docs IS NOT NULL").join(last, "subset").where("part < last")


def _groups(s: SparkSession, d: str) -> DataFrame:
    """Subsets as files, a group for every hundred documents."""
    return t(s, d, "clean", "subset").groupBy(F.col("subset").alias("file")).agg(F.ceil(F.count("*") / 100).alias("groups"))


def _probe(s: SparkSession, d: str) -> DataFrame:
    """Kept bytes of the probed parts; what is judged are the rows of these parts only."""
    groups = sc.probed_groups(_files(s, d))
    rows = t(s, d, "clean", "doc_id", "subset", "part", "text").join(groups, ["subset", "part"], "left_semi").groupBy("doc_id", "subset", "part").agg(F.min("text").alias("text"))
    return sc.yield_probe(fl.apply_filters(rows.where("text IS NOT NULL"), grams=False), groups, F.col("reason").isNull())


def _rates(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "tokenizer_eval").where("tokenizer = 'mt32k'").select("subset", "bytes_per_token")


def _compare(s: SparkSession, d: str) -> DataFrame:
    m = _sql(s, METRICS).where("type = 'train'")
    return rounded(an.compare_runs(m.where("run = 'a'"), m.where("run = 'c'"), 0.01))


_ONE = "c1 AS (SELECT doc_id, min(subset) AS subset, min(part) AS part, min(pos) AS pos, min(text) AS text FROM clean GROUP BY doc_id)"
_LANGS = ", ".join(f"'{x}'" for x in sc.CODE_LANGUAGES)
_CODE = "cc AS (SELECT DISTINCT file_id, language, size, code FROM code)"

_PARAMS = f"""WITH m AS ({MODELS}), l AS (SELECT *, 2 * d_model * d_model + 2 * d_model * n_kv_heads * head_dim + (CASE activation WHEN 'swiglu' THEN 3 ELSE 2 END) * d_model * ffn_hidden + 2 * d_model + CASE WHEN qk_norm THEN 2 * head_dim ELSE 0 END AS per_layer FROM m),
        t AS (SELECT *, per_layer * n_layers + d_model AS non_embedding, vocab_size * d_model AS embedding FROM l), u AS (SELECT *, non_embedding + embedding + CASE WHEN tied THEN 0 ELSE embedding END AS total FROM t)
        SELECT name, per_layer::BIGINT AS per_layer, non_embedding::BIGINT AS non_embedding, embedding::BIGINT AS embedding, total::BIGINT AS total, (2 * total)::BIGINT AS bf16_bytes FROM u"""

QUERIES: dict[str, Query] = {
    "scan_parquet": lambda s, d: sc.scan(t(s, d, "clean"), "text", "doc_id"),
    "source_catalogue": lambda s, d: sc.catalogue(s),
    "code_prefilter": lambda s, d: sc.code_prefilter(code(s, d)).select("file_id", "language", "size"),
    "byte_budget_scan": lambda s, d: sc.byte_budget(clean(s, d).withColumn("file", F.concat_ws("/", "subset", "part")), "file", ["pos", "doc_id"], 20_000).select("doc_id", "file"),
    "even_file_pick": lambda s, d: sc.even_file_pick(_files(s, d).where("subset = 'en_web'").select(F.col("part").alias("path")), 4),
    "yield_probe": _probe,
    "plan_tasks": lambda s, d: sc.plan_tasks(_groups(s, d), 30),
    "plan_byte_tasks": lambda s, d: sc.plan_byte_tasks(_groups(s, d), 1_000_001),
    "target_bytes": lambda s, d: sc.target_bytes(t(s, d, "mix_plan", F.col("source").alias("subset"), "weight"), _rates(s, d), 1_000_000),
    "resume_skip": lambda s, d: sc.unfinished(_files(s, d), _done(s, d), "subset", "part"),
    "sample_to_budget": lambda s, d: sc.sample_to_budget(clean(s, d), "subset", "doc_id", 30_000).select("subset", "doc_id"),
    "lang_cap": lambda s, d: sc.language_cap(code(s, d).groupBy("file_id").agg(F.max("language").alias("language"), F.max("size").alias("size")), 400_000).select("file_id", "language"),
    "holdout_file": lambda s, d: sc.holdout_file(_files(s, d)),
    "manifest": lambda s, d: sc.manifest(clean(s, d)).select("subset", "docs", "bytes"),
    "review_sample": lambda s, d: sc.review_sample(clean(s, d).where("text IS NOT NULL"), 5),
    "markov_corpus": lambda s, d: sc.markov_corpus(s, 100, 64, 50, 4),
    "pretokenize": lambda s, d: t(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(tk.pretokenize("text")).cast("bigint").alias("pieces")),
    "piece_counts": lambda s, d: tk.piece_counts(t(s, d, "documents", "text")),
    "roundtrip": lambda s, d: tk.decode(tk.encode(t(s, d, "documents", "doc_id", "text"))),
    "fertility": lambda s, d: tk.fertility(clean(s, d)),
    "fertility_bytes_words": lambda s, d: clean(s, d).where("text IS NOT NULL").groupBy("subset").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.size(T.words("text"))).alias("n_words"), F.sum(F.length(T.without_space("text"))).alias("n_chars")),
    "run_summary": lambda s, d: rounded(an.run_summary(_sql(s, METRICS))),
    "seed_noise": lambda s, d: rounded(an.seed_noise(_sql(s, SEEDS))),
    "ablation": lambda s, d: rounded(an.ablation(s.sql("SELECT * FROM (VALUES ('muon'), ('qk'), ('gelu'), ('later')) x(name)"), _sql(s, RUNS), an.seed_noise(_sql(s, SEEDS)))),
    "compare_runs": _compare,
    "fit_power": lambda s, d: rounded(an.fit_power(_sql(s, POINTS))),
    "fit_scaling": lambda s, d: rounded(an.fit_scaling(_sql(s, POINTS)), 2),
    "mfu": lambda s, d: rounded(an.utilisation(_sql(s, SPEED))),
    "param_counts": lambda s, d: an.param_counts(_sql(s, MODELS)),
    "flops": lambda s, d: an.flops_per_token(_sql(s, MODELS)),
    "lr_wsd": lambda s, d: s.range(0, 1000).select("id", F.round(an.learning_rate(F.col("id"), "wsd", 3e-4, 0.1, 50, 1000), 9).alias("lr")),
    "lr_cosine": lambda s, d: s.range(0, 1000).select("id", F.round(an.learning_rate(F.col("id"), "cosine", 3e-4, 0.1, 50, 1000), 9).alias("lr")),
    "job_plan": lambda s, d: an.job_plan(_sql(s, JOBS)),
    "ckpt_retention": lambda s, d: an.checkpoint_retention(_sql(s, CKPTS), 2, 250),
    "ablation_subset": lambda s, d: rounded(an.ablation_by_subset(_sql(s, SUBSET_LOSS).where("name = 'muon'"), _sql(s, SUBSET_LOSS).where("name LIKE 's%'"))),
    "group_mean": lambda s, d: rounded(an.prefix_mean(_sql(s, SUBSET_LOSS), "en", "zh")),
    "macro_val": lambda s, d: rounded(an.macro_average(_sql(s, SUBSET_LOSS).withColumnRenamed("name", "run"))),
    "params_check": lambda s, d: rounded(an.check_params(an.param_counts(_sql(s, MODELS)), _sql(s, EXPECTED))),
    "grad_accum": lambda s, d: an.accumulation(_sql(s, ACCUMULATION)).na.fill(0, ["steps"]),
    "rms_norm": lambda s, d: t(s, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(F.aggregate(an.rms_norm(F.col("embedding").cast("array<double>")), F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("l1")),
}

ORACLE: dict[str, str] = {
    "scan_parquet": "SELECT text, doc_id FROM clean WHERE text <> ''",
    "code_prefilter": f"WITH {_CODE} SELECT file_id, language, size FROM cc WHERE language IN ({_LANGS}) AND size <= {sc.CODE_MAX_BYTES}",
    "byte_budget_scan": f"""WITH {_ONE}, b AS (SELECT doc_id, concat_ws('/', subset, part) AS file, coalesce(sum(strlen(text)) OVER (PARTITION BY subset, part ORDER BY pos, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c1) SELECT doc_id, file FROM b WHERE b < 20000""",
    "even_file_pick": """WITH f AS (SELECT DISTINCT part AS path FROM clean WHERE subset = 'en_web'), n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM f)
        SELECT path FROM n WHERE i IN (SELECT k * (SELECT max(n) FROM n) // least(4, (SELECT max(n) FROM n)) FROM range(0, 4) r(k))""",
    "yield_probe": f"""WITH f AS (SELECT DISTINCT subset, part FROM clean), n AS (SELECT *, max(part) OVER (PARTITION BY subset) + 1 AS n FROM f), pr AS (SELECT subset, part FROM n WHERE part IN (0, n // 2, n - 1)),
        rw AS (SELECT row_number() OVER () AS doc_id, * FROM (SELECT doc_id AS id, subset, part, min(text) AS text FROM clean SEMI JOIN pr USING (subset, part) WHERE text IS NOT NULL GROUP BY ALL)),
        {fq.BASE_SQL.replace("FROM clean", "FROM rw")}, k AS (SELECT doc_id, {fq.subset_case_sql()} AS reason FROM m),
        sz AS (SELECT subset, part, sum(strlen(text)) AS b FROM rw JOIN k USING (doc_id) WHERE reason IS NULL GROUP BY ALL)
        SELECT subset, greatest(1, floor(avg(coalesce(b, 0))))::BIGINT AS bytes_per_group FROM pr LEFT JOIN sz USING (subset, part) GROUP BY subset""",
    "plan_tasks": """WITH f AS (SELECT subset AS file, ceil(count(*) / 100)::BIGINT AS g FROM clean GROUP BY ALL), u AS (SELECT file, g, unnest(range(0, (g + 7) // 8)) AS turn FROM f),
        k AS (SELECT file, turn, turn * 8 AS first_group, least(8, g - turn * 8) AS groups FROM u), a AS (SELECT *, coalesce(sum(groups) OVER (ORDER BY turn, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k)
        SELECT row_number() OVER (ORDER BY turn, file) - 1 AS part, file, first_group, groups FROM a WHERE ahead < 30""",
    "plan_byte_tasks": """SELECT row_number() OVER (ORDER BY file) - 1 AS part, file, ceil(1000001 / count(*) OVER ())::BIGINT AS max_bytes FROM (SELECT DISTINCT subset AS file FROM clean)""",
    "target_bytes": """WITH w AS (SELECT source AS subset, round(weight / sum(weight) OVER () * 1000000)::BIGINT AS target_tokens FROM mix_plan)
        SELECT subset, target_tokens, round(target_tokens * bytes_per_token * 1.1::DOUBLE / 0.9::DOUBLE)::BIGINT AS target_bytes FROM w JOIN tokenizer_eval USING (subset) WHERE tokenizer = 'mt32k'""",
    "resume_skip": """WITH f AS (SELECT DISTINCT subset, part FROM clean), l AS (SELECT subset, part, arg_max(row(tokens, docs), row(written_at, run_id, tokens)) AS r FROM docs GROUP BY ALL),
        m AS (SELECT subset, max(part) AS last FROM f GROUP BY ALL)
        SELECT subset, part FROM f EXCEPT SELECT subset, part FROM l JOIN m USING (subset) WHERE r[1] IS NOT NULL AND r[2] IS NOT NULL AND part < last""",
    "sample_to_budget": f"""WITH {_ONE}, b AS (SELECT subset, doc_id, coalesce(sum(coalesce(strlen(text), 0)) OVER (PARTITION BY subset ORDER BY md5('0:' || subset || ':' || doc_id)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c1) SELECT subset, doc_id FROM b WHERE b < 30000""",
    "lang_cap": f"""WITH {_CODE}, o AS (SELECT file_id, max(language) AS language, max(size) AS size FROM cc GROUP BY file_id), b AS (SELECT file_id, language, coalesce(sum(coalesce(size, 0)) OVER
        (PARTITION BY coalesce(language, '') ORDER BY md5('0:' || file_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o) SELECT file_id, language FROM b WHERE b < 100000""",
    "holdout_file": "SELECT DISTINCT subset, part, CASE WHEN part = max(part) OVER (PARTITION BY subset) THEN 'eval' ELSE 'train' END AS split FROM clean",
    "manifest": f"WITH {_ONE} SELECT subset, count(*) AS docs, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM c1 GROUP BY subset",
    "review_sample": f"""WITH {_ONE} SELECT subset, doc_id, substr(text, 1, 800) AS head FROM c1 WHERE text IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY subset ORDER BY md5('0:' || subset || ':' || doc_id), doc_id) <= 5""",
    "roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "fertility_bytes_words": f"""WITH {_ONE} SELECT subset, sum(strlen(text))::BIGINT AS n_bytes, sum(len(list_filter(string_split_regex(text, '{T.SPACE}+'), lambda x: x <> '')))::BIGINT AS n_words,
        sum(length(regexp_replace(text, '{T.SPACE}+', '', 'g')))::BIGINT AS n_chars FROM c1 WHERE text IS NOT NULL GROUP BY subset""",
    "run_summary": f"""WITH m AS ({METRICS}), e AS (SELECT * FROM m WHERE type = 'eval' QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) = 1),
        g AS (SELECT run, max(coalesce(grad_norm, 0)) AS a, max(coalesce(grad_norm, 0)) FILTER (step > 200) AS b, avg(step_s) AS s FROM m WHERE type <> 'eval' GROUP BY run)
        SELECT run, step, tokens, round(val_loss::DOUBLE, 6) AS val_loss, round(coalesce(a, 0)::DOUBLE, 6) AS grad_norm_max, round(coalesce(b, 0)::DOUBLE, 6) AS grad_norm_late_max,
        round(coalesce(s * step / 3600, 0)::DOUBLE, 6) AS hours FROM e LEFT JOIN g USING (run)""",
    "seed_noise": f"SELECT count(*) AS n, round(avg(loss::DOUBLE), 6) AS mean, round(stddev_samp(loss::DOUBLE), 6) AS sigma, round((max(loss) - min(loss))::DOUBLE, 6) AS spread FROM ({SEEDS})",
    "ablation": f"""WITH s AS (SELECT avg(loss::DOUBLE) AS mean, stddev_samp(loss::DOUBLE) AS sigma FROM ({SEEDS})) SELECT p.name, round(r.loss::DOUBLE, 6) AS loss, round(r.loss - mean, 6) AS delta,
        abs(r.loss - mean) > 2 * sigma AS significant FROM (VALUES ('muon'), ('qk'), ('gelu'), ('later')) p(name) LEFT JOIN ({RUNS}) r USING (name), s""",
    "compare_runs": f"""WITH m AS ({METRICS}), l AS (SELECT run, step, arg_max(loss, line_no)::DOUBLE AS loss FROM m WHERE type = 'train' GROUP BY ALL),
        j AS (SELECT step, abs(a.loss - b.loss) / abs(a.loss) AS rel FROM l a JOIN l b USING (step) WHERE a.run = 'a' AND b.run = 'c')
        SELECT count(*) AS steps, round(max(rel), 6) AS max_rel, arg_max(step, row(rel, -step)) AS at_step, max(rel) <= 0.01 AS within FROM j""",
    "fit_power": f"""WITH p AS (SELECT n::DOUBLE AS n, loss::DOUBLE AS loss FROM ({POINTS})), f AS (SELECT regr_slope(ln(loss), ln(n)) AS s, regr_intercept(ln(loss), ln(n)) AS i FROM p)
        SELECT round(-any_value(s), 6) AS alpha, round(any_value(i), 6) AS log_a, round(max(abs(exp(i + s * ln(n)) - loss)), 6) AS max_resid FROM p, f""",
    "fit_scaling": f"""WITH p AS (SELECT n::DOUBLE AS n, loss::DOUBLE AS loss FROM ({POINTS})), g AS (SELECT 0.01 + k * (1.49 / 2999.0)::DOUBLE AS alpha FROM range(0, 3000) r(k)),
        x AS (SELECT alpha, pow(n, -alpha) AS x, loss FROM g, p), f AS (SELECT alpha, regr_intercept(loss, x) AS floor, regr_slope(loss, x) AS a, regr_syy(loss, x) - regr_sxy(loss, x) * regr_sxy(loss, x) / regr_sxx(loss, x) AS r FROM x GROUP BY alpha)
        SELECT round(alpha, 2) AS alpha, round(floor, 2) AS floor, round(a, 2) AS a FROM f ORDER BY r, alpha LIMIT 1""",
    "mfu": f"SELECT run, round(batch_tokens / step_s::DOUBLE, 6) AS tok_s, round(flops::DOUBLE * (batch_tokens / step_s::DOUBLE) / (peak_flops::DOUBLE * world), 6) AS mfu FROM ({SPEED})",
    "param_counts": _PARAMS,
    "flops": f"""WITH m AS ({MODELS}), l AS (SELECT *, (2 * d_model * d_model + 2 * d_model * n_kv_heads * head_dim + (CASE activation WHEN 'swiglu' THEN 3 ELSE 2 END) * d_model * ffn_hidden + 2 * d_model + CASE WHEN qk_norm THEN 2 * head_dim ELSE 0 END)::BIGINT * n_layers + d_model AS n FROM m)
        SELECT name, (6 * n + 6 * d_model::BIGINT * vocab_size + 12 * n_layers::BIGINT * seq_len * d_model)::BIGINT AS flops FROM l""",
    "lr_wsd": "SELECT k AS id, round(CASE WHEN k < 50 THEN 3e-4 * (k + 1) / 50 WHEN k < 900 THEN 3e-4 ELSE 3e-4 + (3e-5 - 3e-4) * (k - 900) / 100 END, 9) AS lr FROM range(0, 1000) r(k)",
    "lr_cosine": "SELECT k AS id, round(CASE WHEN k < 50 THEN 3e-4 * (k + 1) / 50 ELSE 3e-5 + (3e-4 - 3e-5) * 0.5 * (1 + cos(pi() * (k - 50) / 950)) END, 9) AS lr FROM range(0, 1000) r(k)",
    "job_plan": f"SELECT run, greatest(1, ceil(train_min / 285))::BIGINT AS jobs, least(300, ceil(train_min / greatest(1, ceil(train_min / 285))) + 15)::BIGINT AS job_min FROM ({JOBS})",
    "ckpt_retention": f"SELECT run, step FROM ({CKPTS}) QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 2 OR step % 250 = 0",
    "ablation_subset": f"""WITH x AS ({SUBSET_LOSS}), n AS (SELECT subset, avg(loss::DOUBLE) AS mean, stddev_samp(loss::DOUBLE) AS sigma FROM x WHERE name LIKE 's%' GROUP BY subset)
        SELECT name, subset, round(loss - mean, 6) AS delta, abs(loss - mean) > 2 * sigma AS significant FROM x JOIN n USING (subset) WHERE name = 'muon'""",
    "group_mean": f"WITH x AS ({SUBSET_LOSS}) SELECT name, round(avg(loss::DOUBLE) FILTER (subset LIKE 'en%'), 6) AS en, round(avg(loss::DOUBLE) FILTER (subset LIKE 'zh%'), 6) AS zh FROM x GROUP BY name",
    "macro_val": f"WITH x AS ({SUBSET_LOSS}), g AS (SELECT name AS run, subset, avg(loss::DOUBLE) AS l FROM x GROUP BY ALL) SELECT run, round(avg(l), 6) AS val_loss FROM g GROUP BY run",
    "params_check": f"""WITH t AS ({_PARAMS}) SELECT name, t.total, expected::INT AS expected, round(abs(t.total - expected) / expected::DOUBLE, 6) AS off, abs(t.total - expected) / expected::DOUBLE <= 0.01 AS ok
        FROM t JOIN ({EXPECTED}) USING (name)""",
    "grad_accum": f"SELECT run, CASE WHEN batch_tokens % (micro_batch * seq_len * world) = 0 THEN batch_tokens // (micro_batch * seq_len * world) ELSE 0 END::BIGINT AS steps FROM ({ACCUMULATION})",
    "rms_norm": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v) + 1e-5) AS r FROM e)
        SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x / r))), 4) AS l1 FROM q""",
}
