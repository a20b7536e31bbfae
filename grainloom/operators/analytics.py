"""Run analytics and sizing: summaries of metric logs, noise and ablations, scaling fits, parameters, schedules, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_summary(metrics: DataFrame) -> DataFrame:
    """Of each run: its last evaluation by line, greatest gradient norm (in all, after step 200), and hours."""
    last = metrics.where("type = 'eval'").groupBy("run").agg(F.max_by(F.struct("step", "tokens", "val_loss"), F.col("line_no")).alias("e"))
    norm = F.coalesce("grad_norm", F.lit(0.0))
    train = metrics.where("type <> 'eval'").groupBy("run").agg(F.max(norm).alias("grad_norm_max"), F.max(F.when(F.col("step") > 200, norm)).alias("late"), F.avg("step_s").alias("s"))
    out = last.join(train, "run", "left")
    return out.select("run", "e.step", "e.tokens", "e.val_loss", F.coalesce("grad_norm_max", F.lit(0.0)).alias("grad_norm_max"), F.coalesce("late", F.lit(0.0)).alias("grad_norm_late_max"), F.coalesce(F.col("s") * F.col("e.step") / 3600, F.lit(0.0)).alias("hours"))


def seed_noise(seeds: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of the loss over seeds; without two there is no noise to speak of."""
    return seeds.agg(F.count("*").alias("n"), F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sigma"), (F.max("loss") - F.min("loss")).alias("spread")).where("n >= 2")


def ablation(planned: DataFrame, runs: DataFrame, noise: DataFrame) -> DataFrame:
    """Difference of each planned run to the mean of the seeds, and whether it exceeds two deviations; missing runs stay."""
    one = noise.first()
    mean, sigma = (F.lit(one[c] if one else None).cast("double") for c in ("mean", "sigma"))
    delta = F.col("loss") - mean
    return planned.join(runs, "name", "left").select("name", "loss", delta.alias("delta"), (F.abs(delta) > 2 * sigma).alias("significant"))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Common steps, the step of the greatest relative difference, and whether it is tolerable; the last record of a step
    counts."""
    last = lambda df: df.groupBy("step").agg(F.max_by("loss", "line_no").alias("loss"))
    both = last(a).withColumnRenamed("loss", "x").join(last(b).withColumnRenamed("loss", "y"), "step")
    rel = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.lit(1e-12))
    return both.withColumn("rel", rel).agg(F.count("*").alias("steps"), F.max("rel").alias("max_rel"), F.max_by("step", F.struct("rel", -F.col("step"))).alias("at_step")).withColumn("within", F.col("max_rel") <= tolerance)


def fit_power(points: DataFrame) -> DataFrame:
    """``loss = A * n^-alpha`` by least squares of the logarithms, with the greatest absolute residual."""
    fit = points.agg(F.regr_slope(F.ln("loss"), F.ln("n")).alias("slope"), F.regr_intercept(F.ln("loss"), F.ln("n")).alias("log_a"))
    slope, log_a = (F.lit(x).cast("double") for x in fit.first())
    resid = F.max(F.abs(F.exp(log_a + slope * F.ln("n")) - F.col("loss")))
    return points.agg(resid.alias("max_resid")).select((-slope).alias("alpha"), log_a.alias("log_a"), "max_resid")


def fit_scaling(points: DataFrame, low: float = 0.01, high: float = 1.5, steps: int = 3000) -> DataFrame:
    """``loss = floor + A * n^-alpha``: of a grid of exponents the one whose linear fit has the least squared residual,
    the first among equals. The points, at most 10,000, are put beside each exponent."""
    spark = points.sparkSession
    grid = spark.range(steps).select((F.lit(low) + F.col("id") * ((high - low) / (steps - 1))).alias("alpha"))
    few = points.select("n", "loss").limit(10_001).collect()
    if not 0 < len(few) <= 10_000:
        raise ValueError("no points, or more than 10,000")
    pairs = F.array(*[F.struct(F.lit(float(r["n"])).alias("n"), F.lit(float(r["loss"])).alias("loss")) for r in few])
    x = grid.select("alpha", F.inline(pairs)).withColumn("x", F.pow("n", -F.col("alpha")))
    fit = x.groupBy("alpha").agg(F.regr_intercept("loss", "x").alias("floor"), F.regr_slope("loss", "x").alias("a"), F.regr_sxx("x", "loss").alias("syy"), F.regr_syy("x", "loss").alias("sxx"), F.regr_sxy("loss", "x").alias("sxy"))
    return fit.withColumn("resid", F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).agg(F.min_by(F.struct("alpha", "floor", "a"), F.struct("resid", "alpha")).alias("f")).select("f.alpha", "f.floor", "f.a")


def param_counts(models: DataFrame) -> DataFrame:
    """Parameters of each decoder configuration."""
    d, kv = F.col("d_model"), F.col("n_kv_heads") * F.col("head_dim")
    mlp = F.when(F.col("activation") == "swiglu", 3).otherwise(2) * d * F.col("ffn_hidden")
    per_layer = 2 * d * d + 2 * d * kv + mlp + 2 * d + F.when(F.col("qk_norm"), 2 * F.col("head_dim")).otherwise(0)
    non_embedding, embedding = per_layer * F.col("n_layers") + d, F.col("vocab_size") * d
    total = non_embedding + embedding + F.when(F.col("tied"), 0).otherwise(embedding)
    cast = lambda c, n: c.cast("bigint").alias(n)
    return models.select("name", cast(per_layer, "per_layer"), cast(non_embedding, "non_embedding"), cast(embedding, "embedding"), cast(total, "total"), cast(2 * total, "bf16_bytes"))


def flops_per_token(models: DataFrame) -> DataFrame:
    """Training operations a token: six a weight, the output layer's, and attention's, which grows with the length."""
    n = param_counts(models).select("name", "non_embedding")
    f = 6 * F.col("non_embedding") + 6 * F.col("d_model") * F.col("vocab_size") + 12 * F.col("n_layers") * F.col("seq_len") * F.col("d_model")
    return models.join(n, "name").select("name", f.cast("bigint").alias("flops"))


def learning_rate(step: Column, kind: str, peak: float, floor_ratio: float, warmup: int, total: int, decay_start: int | None = None) -> Column:
    """Rate at a step: linear warm-up, then constant with a linear decay (``wsd``) or half a cosine, then the floor."""
    floor, start = peak * floor_ratio, int(0.9 * total) if decay_start is None else decay_start
    if kind == "wsd":
        later = F.when(step < start, F.lit(peak)).otherwise(peak + (floor - peak) * (step - start) / max(1, total - start))
    else:
        later = floor + (peak - floor) * 0.5 * (1 + F.cos(F.pi() * (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).when(step >= total, F.lit(floor)).otherwise(later)


def utilisation(runs: DataFrame) -> DataFrame:
    """Tokens a second, and the share of the peak operations that they are."""
    tok_s = F.col("batch_tokens") / F.col("step_s")
    return runs.select("run", tok_s.alias("tok_s"), (F.col("flops") * tok_s / (F.col("peak_flops") * F.col("world"))).alias("mfu"))


def job_plan(runs: DataFrame, limit_min: int = 300, startup_min: int = 10) -> DataFrame:
    """Jobs and minutes that each run's training minutes need under a time limit."""
    budget = limit_min - startup_min - 5
    jobs = F.greatest(F.lit(1), F.ceil(F.col("train_min") / budget))
    return runs.select("run", jobs.cast("bigint").alias("jobs"), F.least(F.lit(limit_min), F.ceil(F.col("train_min") / jobs) + startup_min + 5).cast("bigint").alias("job_min"))


def checkpoint_retention(ckpts: DataFrame, keep_last: int, every: int) -> DataFrame:
    """Checkpoints kept: the last ones of each run, and those at multiples of a step."""
    order = Window.partitionBy("run").orderBy(F.desc("step"))
    return ckpts.withColumn("r", F.row_number().over(order)).where((F.col("r") <= keep_last) | (F.col("step") % every == 0)).drop("r")


def rms_norm(vector: Column, eps: float = 1e-5) -> Column:
    """A vector over the root of its mean square."""
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x) / F.size(vector)
    return F.transform(vector, lambda x: x * (1 / F.sqrt(mean + eps)))


def ablation_by_subset(losses: DataFrame, seeds: DataFrame) -> DataFrame:
    """Difference of each run's loss on each subset to the seeds' mean there, flagged beyond two of that subset's own
    deviations. Subsets without seeds have none."""
    noise = seeds.groupBy("subset").agg(F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sigma"))
    delta = F.col("loss") - F.col("mean")
    return losses.join(noise, "subset").select("name", "subset", delta.alias("delta"), (F.abs(delta) > 2 * F.col("sigma")).alias("significant"))


def prefix_mean(losses: DataFrame, *prefixes: str) -> DataFrame:
    """Mean loss of each run over the subsets whose names begin alike; null where there are none."""
    return losses.groupBy("name").agg(*[F.avg(F.when(F.col("subset").startswith(p), F.col("loss"))).alias(p) for p in prefixes])


def macro_average(batches: DataFrame) -> DataFrame:
    """Mean over subsets, each counting once, of their mean losses."""
    return batches.groupBy("run", "subset").agg(F.avg("loss").alias("l")).groupBy("run").agg(F.avg("l").alias("val_loss"))


def check_params(counted: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether each model's counted total lies within a tolerance of the expected one."""
    off = F.abs(F.col("total") - F.col("expected")) / F.col("expected")
    return counted.join(expected, "name").select("name", "total", "expected", off.alias("off"), (off <= tolerance).alias("ok"))


def accumulation(configs: DataFrame) -> DataFrame:
    """Gradient accumulation steps of each configuration; null where the batch does not divide."""
    step = F.col("micro_batch") * F.col("seq_len") * F.col("world")
    return configs.select("run", F.when(F.col("batch_tokens") % step == 0, F.floor(F.col("batch_tokens") / step)).alias("steps"))
