from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from grainloom.operators import analytics as an
from grainloom.operators import packing as pk
from grainloom.operators import tokens as tk
from grainloom.plans import registry
from grainloom.sources import catalogue as sc
from grainloom.streaming.ingest import ingest_parts


def lengths(spark, n=400):
    return spark.createDataFrame([("ab"[i % 2], 0, i, i, 10 + i % 7) for i in range(n)], "subset string, part bigint, ord bigint, doc_id bigint, n_tokens bigint")


def test_validation_split_is_disjoint_complete_and_large_enough(spark):
    split = pk.split_validation(lengths(spark), 300).collect()
    assert len(split) == 400 and len({r["doc_id"] for r in split}) == 400
    for s in "ab":
        val = [r["n_tokens"] for r in split if r["subset"] == s and r["split"] == "val"]
        assert sum(val) >= 300 and sum(val) - max(val) < 300


def test_running_totals_against_a_plain_sum(spark):
    rows = pk.running_totals(lengths(spark).withColumn("key", pk.shuffle_key(5, "subset", "doc_id")), "subset", "key", "n_tokens").collect()
    for s in "ab":
        total = 0
        for r in sorted((r for r in rows if r["subset"] == s), key=lambda r: r["key"]):
            assert r["before"] == total
            total += r["n_tokens"]


def test_mix_keeps_its_shares_in_every_prefix(spark):
    weights = spark.createDataFrame([("a", 70.0), ("b", 30.0)], "subset string, weight double")
    rows = pk.cut_shards(pk.mix_order(lengths(spark, 2000), weights, 40_000), 1_000).orderBy("start").collect()
    a = b = 0
    for k, r in enumerate(rows):
        assert r["start"] == a + b and r["shard"] == (a + b) // 1_000
        a, b = (a + r["n_tokens"], b) if r["subset"] == "a" else (a, b + r["n_tokens"])
        if k > 200:
            assert abs(a / (a + b) - 0.7) < 0.02
    assert 40_000 <= a + b < 40_040
    # what is drawn again is drawn in whole epochs first, and no document twice in one
    for s in "ab":
        uses = [(r["epoch"], r["doc_id"]) for r in rows if r["subset"] == s]
        assert len(set(uses)) == len(uses)
        last = max(e for e, _ in uses)
        assert all(sum(e == k for e, _ in uses) == 1000 for k in range(last))
    assert max(r["epoch"] for r in rows if r["subset"] == "a") == 2


def test_batch_plan_equals_the_loop(spark):
    sizes = [0, 1, 8, 9, 16, 17, 100]
    shards = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "subset string, part bigint, n_tokens bigint")
    got = sorted((r["part"], r["offset"]) for r in pk.batch_plan(shards, 2, 4).collect())
    ideal = [(i, o) for i, n in enumerate(sizes) for o in range(0, n, 8) if o + 9 <= n]
    assert got == ideal


def test_shifted_pairs(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [1])], "doc_id bigint, tokens array<int>")
    rows = pk.shifted_pairs(df, 3).orderBy("row").collect()
    assert [(r["x"], r["y"]) for r in rows] == [([0, 1, 2], [1, 2, 3]), ([3, 4, 5], [4, 5, 6]), ([6, 7, 8], [7, 8, 9])]


def test_token_shards_round_trip(spark, tmp_path):
    rows = [(0, 0, [1, 2, 65535]), (0, 1, [3]), (1, 0, [])]
    df = spark.createDataFrame(rows, "shard bigint, ord bigint, tokens array<int>")
    assert dict(sc.write_token_shards(df, str(tmp_path)).collect()) == {0: 4, 1: 0}
    back = {r["path"][-8:-4]: r["tokens"] for r in sc.read_token_shards(spark, str(tmp_path)).collect()}
    assert back == {"0000": [1, 2, 65535, 3]}  # files without a byte are no shards
    bad = spark.createDataFrame([(0, 0, [70000])], "shard bigint, ord bigint, tokens array<int>")
    with pytest.raises(Exception, match="16 bits"):
        sc.write_token_shards(bad, str(tmp_path / "bad")).collect()


def test_jsonl_zst_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("one\ntwo",), ("三",), (None,)], "text string")
    assert sum(r["docs"] for r in sc.write_jsonl_zst(df, str(tmp_path / "x")).collect()) == 3
    assert {r[0] for r in sc.read_jsonl_zst(spark, str(tmp_path / "x")).collect()} == {"one\ntwo", "三", None}


def test_plans_are_prefixes(spark):
    plan = lambda groups, need: [tuple(r) for r in sc.plan_tasks(spark.createDataFrame(list(enumerate(groups)), "file int, groups bigint"), need).orderBy("part").collect()]
    small, large = plan([20, 5, 12], 10), plan([20, 5, 12], 30)
    assert large == [(0, 0, 0, 8), (1, 1, 0, 5), (2, 2, 0, 8), (3, 0, 8, 8), (4, 2, 8, 4)] and large[: len(small)] == small
    assert sum(t[3] for t in plan([3, 2, 0], 99)) == 5


def test_stream_goes_on_through_shards_and_epochs(spark):
    shards = spark.createDataFrame([("a", 0, 100), ("a", 1, 150), ("b", 0, 9), ("b", 1, 120)], "subset string, part bigint, n_tokens bigint")
    rows = pk.loader_stream(shards, 2, 2, 5).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(len(rows))) and len(rows) == 2 * (9 + 14 + 11)
    assert [r["epoch"] for r in rows] == sorted(r["epoch"] for r in rows)
    for x, y in zip(rows, rows[1:]):
        assert y["offset"] == (x["offset"] + 10 if x["turn"] == y["turn"] else 0)
    with pytest.raises(ValueError):
        pk.usable_shards(shards, 20, 50)


def test_even_pick(spark):
    for n, k in ((10, 4), (3, 4), (7, 7), (9, 2)):
        files = spark.createDataFrame([(f"f{i:02d}",) for i in range(n)], "path string")
        got = sorted(r[0] for r in sc.even_file_pick(files, k).collect())
        m = min(n, k)
        assert got == [f"f{i * n // m:02d}" for i in range(m)]


def test_markov_chains_have_few_successors(spark):
    rows = sc.markov_corpus(spark, 50, 40, 30, 4).collect()
    path = {(r["chain"], r["pos"]): r["state"] for r in rows}
    after = {}
    for (c, p), s in path.items():
        if (c, p + 1) in path:
            after.setdefault(s, set()).add(path[c, p + 1])
    assert all(path[c, 0] == 0 for c in range(50)) and max(map(len, after.values())) <= 4


def test_scaling_fit_recovers_known_constants(spark):
    points = spark.createDataFrame([(n, 1.9 + 12 * n**-0.28) for n in (9.44e6, 22.55e6, 74.34e6)], "n double, loss double")
    fit = an.fit_scaling(points).first()
    assert fit["alpha"] == pytest.approx(0.28, abs=0.01) and fit["floor"] == pytest.approx(1.9, abs=0.05)


def test_parameter_counts_and_flops(spark):
    rows = [("250m", 32768, 1024, 18, 4, 64, 2816, "swiglu", False, True, 2048)]
    models = spark.createDataFrame(rows, "name string, vocab_size bigint, d_model bigint, n_layers bigint, n_kv_heads bigint, head_dim bigint, ffn_hidden bigint, activation string, qk_norm boolean, tied boolean, seq_len bigint")
    got = an.param_counts(models).first()
    assert (got["total"], got["non_embedding"], got["bf16_bytes"]) == (236_491_776, 202_937_344, 472_983_552)
    assert an.flops_per_token(models).first()["flops"] == pytest.approx(1.872e9, rel=0.001)


def test_learning_rate_ends(spark):
    lr = {r[0]: r[1] for r in spark.range(0, 101).select("id", an.learning_rate(F.col("id"), "cosine", 1.0, 0.1, 10, 100)).collect()}
    assert lr[0] == pytest.approx(0.1) and lr[9] == pytest.approx(1.0) and lr[100] == pytest.approx(0.1) and lr[55] == pytest.approx(0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * 0.5)))


def test_encode_decode_round_trip(spark):
    texts = ["", None, "plain words", "汉字 and <|endoftext|>", " \n\t ", "é \U0001f33f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in tk.decode(tk.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_texts_are_encoded_a_bounded_stretch_at_a_time(spark):
    texts = ["ab" * 50, "", "x" * 300_000, "one", "two", "y" * (1 << 18)] + ["some words"] * 60_000
    cuts = list(tk._slices(texts))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts)
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= tk.AT_ONCE for a, b in cuts) and list(tk._slices([])) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["some words", None, "", "汉字 text", "x y z"] * 9)], "doc_id bigint, text string")
    whole = sorted(map(tuple, tk.encode(df).select("doc_id", F.array_join("ids", " ")).collect()))
    assert len(whole) == 45 and whole[1][1] == whole[2][1] == "" and whole[0][1] == whole[5][1] != ""
    named = df.withColumn("subset", F.when(F.col("doc_id") % 3 > 0, "s"))
    assert sorted(tk.fertility(named).collect(), key=str) == sorted(tk.fertility(named, tk.encode(df)).collect(), key=str)


def test_stream_ingest_takes_each_file_once(spark, tmp_path):
    schema = "doc_id bigint, subset string, text string"
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    for part in range(2):
        spark.createDataFrame([(part, "code", "x = 1\n" * 20), (part + 10, "code", "short")], schema).coalesce(1).write.mode("append").parquet(src)
        ingest_parts(spark, src, schema, sink, ckpt)
    assert sorted((r["doc_id"], r["reason"]) for r in spark.read.parquet(sink).collect()) == [(0, None), (1, None), (10, "code_short"), (11, "code_short")]


REPETITIVE = "\n".join(f"The old miller of the valley went down to the river on day {i} and that is all of it." for i in range(40))


def test_ingest_and_pipeline_take_the_n_gram_rules(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    schema = "doc_id bigint, subset string, text string"
    spark.createDataFrame([(1, "en_web", REPETITIVE)], schema).write.parquet(src)
    ingest_parts(spark, src, schema, sink, ckpt)
    reason = spark.read.parquet(sink).first()["reason"]
    assert "gram" in (reason or "")
    rows = [(1, "en_web", 0, 0, REPETITIVE)]
    spark.createDataFrame(rows, "doc_id bigint, subset string, part bigint, pos bigint, text string").write.parquet(f"{tmp_path}/clean.parquet")
    assert registry.QUERIES["stage_fetch"](spark, str(tmp_path)).count() == 0
    assert registry.QUERIES["stage_fetch_plain"](spark, str(tmp_path)).count() == 1
    assert [r["reason"] for r in registry.QUERIES["top_reasons"](spark, str(tmp_path)).collect()] == [reason]
    assert [r["reason"] for r in registry.QUERIES["filter_calib"](spark, str(tmp_path)).collect()] == [reason]


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
