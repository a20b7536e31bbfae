from __future__ import annotations

import random

import numpy as np

from grainloom.llm import ORACLE, QUERIES, bm25_packing, curriculum_mix

IDX = "subset string, doc_id bigint, start_off bigint, end_off bigint, tokens bigint, terms string"


def packed(spark, lengths, capacity=100, texts=None):
    rows = [("s" if i % 3 else None, i, 0, n, n if i % 5 else None, "clash") for i, n in enumerate(lengths)]
    docs_idx = spark.createDataFrame(rows + rows[:3], IDX)
    clean = spark.createDataFrame([(i, (texts or {}).get(i, f"word{i % 7} text about topic{i % 3}")) for i in range(len(lengths)) if i % 11], "doc_id bigint, text string")
    specs = spark.createDataFrame([("c", capacity), ("c", capacity), ("bad", 0), ("none", None)], "spec string, capacity bigint")
    return bm25_packing.pack_documents(docs_idx, clean, specs)


def test_every_document_is_placed_once_and_whole(spark):
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 7, 20, 35, 60, 99, 100, 101, 250]) for _ in range(300)]
    rows = packed(spark, lengths).collect()
    held, boxes = {}, {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append(r["tokens"])
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["tokens"]
    assert {i: sum(x) for i, x in held.items()} == dict(enumerate(lengths))
    assert all(len(held[i]) == 1 for i, n in enumerate(lengths) if n <= 100)
    assert all(sorted(held[i], reverse=True)[: n // 100] == [100] * (n // 100) for i, n in enumerate(lengths))
    assert max(boxes.values()) <= 100
    assert len(boxes) <= 1.06 * sum(lengths) / 100 + 2


def test_neighbours_share_containers(spark):
    texts = {i: ("apple orchard harvest cider" if i % 2 else "engine piston gearbox valve") for i in range(40)}
    rows = packed(spark, [24] * 40, texts=texts).collect()
    boxes = {}
    for r in rows:
        if r["doc_id"] % 11 and r["doc_id"] % 3:
            boxes.setdefault(r["container"], []).append(r["doc_id"] % 2)
    pure = sum(len(set(b)) == 1 for b in boxes.values() if len(b) > 1)
    assert pure >= 0.7 * sum(len(b) > 1 for b in boxes.values())


def test_documents_are_dealt_by_content_to_bounded_shards(spark):
    rows = [(i, 1 if i < 400 else 2 + i % 50, (7 if i < 200 else i % 9) if i < 400 else -1) for i in range(1000)] + [(2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, first int, second int")
    shards = {}
    for r in bm25_packing.dealt_to_shards(docs, shard=60).collect():
        shards.setdefault(r["shard"], []).append(r["doc_id"])
    assert sorted(i for s in shards.values() for i in s) == sorted(r[0] for r in rows)
    assert max(map(len, shards.values())) <= 125
    together = {i: s for s, ids in shards.items() for i in ids}
    assert all(len({together[i] for i in range(400 + k, 1000, 50)}) == 1 for k in range(50))


def test_the_index_finds_neighbours_of_the_same_topic(spark):
    rng = random.Random(12)
    topics = [["".join(rng.choices("abcdefgh", k=8)) for _ in range(120)] for _ in range(12)]
    texts = [(i, " ".join(rng.choices(topics[i % 12], k=150) + rng.choices(topics[rng.randrange(12)], k=30))) for i in range(240)]
    vectors = bm25_packing.term_vectors(spark.createDataFrame(texts, "doc_id bigint, text string"))
    rows = bm25_packing.indexed_vectors(vectors).orderBy("doc_id").collect()
    index = bm25_packing.ShardIndex([np.array(r["terms"], np.int32) for r in rows], [np.array(r["impacts"], np.float32) for r in rows])
    near = 0
    for k in range(240):
        unused = np.ones(240, bool)
        unused[k] = False
        near += sum(j % 12 == k % 12 for j in index.neighbours(k, unused)[:10])
    assert near >= 0.9 * 2400


def test_the_index_holds_weak_terms_and_large_counts_too(spark):
    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(400)]
    # the rare words of both come first by impact; what they share are 60 words that other documents have too
    texts = [(0, " ".join(words[:60] + words[100:200])), (1, " ".join(words[:60] + words[200:300])), (2, " ".join(["word"] * 40_000 + words[300:]))]
    texts += [(10 + k, " ".join(words[k : 60 : 6])) for k in range(6)]
    vectors = bm25_packing.term_vectors(spark.createDataFrame(texts, "doc_id bigint, text string"))
    rows = bm25_packing.indexed_vectors(vectors).orderBy("doc_id").collect()
    assert [len(r["terms"]) for r in rows[:3]] == [160, 160, 101]
    index = bm25_packing.ShardIndex([np.array(r["terms"], np.int32) for r in rows], [np.array(r["impacts"], np.float32) for r in rows])
    unused = np.ones(len(rows), bool)
    unused[0] = False
    assert sorted(index.neighbours(0, unused)) == [1, *range(3, 9)]
    n, vector = vectors.where("doc_id = 2").select("n", "vector").first()
    assert bm25_packing.unpacked_vector(vector, n)[1].max() == 40_000


def test_lengths_that_nobody_recorded_are_measured(spark):
    idx = spark.createDataFrame([("s", 1, 0, 9, None), ("s", 2, None, None, None), ("s", 3, None, None, None), ("s", 4, None, None, -5)], "subset string, doc_id bigint, start_off bigint, end_off bigint, tokens bigint")
    clean = spark.createDataFrame([(1, "x"), (2, "one two three"), (2, "one two three")], "doc_id bigint, text string")
    assert dict(bm25_packing.document_lengths(idx, clean).collect()) == {1: 9, 2: 4, 3: 0, 4: 0}


def test_nothing_to_pack(spark):
    assert packed(spark, []).collect() == []


def plan(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_epochs bigint, priority bigint, draw_share double")


def sized(spark, groups):
    rows, n = [], 0
    for source, sizes in groups.items():
        for s in sizes:
            rows.append((n, source, s))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_epochs_and_positions(spark):
    rng = random.Random(8)
    docs = sized(spark, {"a": [rng.randint(1, 50) for _ in range(2000)], "b": [rng.randint(1, 50) for _ in range(300)], "tiny": [10] * 5, "other": [20] * 50})
    p = plan(spark, [(" A ", 60.0, 1, 2, 0.5), ("b", 30.0, 3, 1, 0.5), ("tiny", 10.0, 4, 3, 0.5), ("absent", 20.0, 2, 4, 0.5), (None, None, None, None, None)])
    shares = {r["source"]: r for r in curriculum_mix.mixture_shares(docs, p).collect()}
    assert abs(shares["a"]["drawn_tokens"] - shares["a"]["target_tokens"]) <= 50 and shares["a"]["epochs"] <= 1
    assert abs(shares["b"]["drawn_tokens"] - shares["b"]["target_tokens"]) <= 50 and shares["b"]["epochs"] <= 3
    assert shares["tiny"]["drawn_tokens"] == 200 and shares["tiny"]["lacking"] and shares["absent"]["drawn_tokens"] == 0
    rows = curriculum_mix.draw_mixture(docs, p).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and 0 <= rows[0]["position"] and rows[-1]["position"] <= 1
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    first = sum(r["n_tokens"] for r in rows if r["source"] == "b" and r["position"] < 0.5)
    assert first < 0.5 * shares["b"]["drawn_tokens"]  # priority 1 comes late


def test_positions_invert_the_integrated_schedule(spark):
    docs = sized(spark, {"a": [10] * 1000, "b": [10] * 1000})
    p = plan(spark, [("a", 1.0, 1, 1, 1.0), ("b", 1.0, 1, 2, 1.0)])
    rows = curriculum_mix.draw_mixture(docs, p).collect()
    for source, tilt in (("a", -0.8), ("b", 0.8)):
        u = sorted(r["position"] for r in rows if r["source"] == source)
        for k, x in enumerate(u):
            assert abs((x + tilt * (x - x * x)) - (k + 0.5) / len(u)) < 1e-6


def test_every_prefix_has_the_shares_of_given_schedules(spark):
    rng = random.Random(3)
    docs = sized(spark, {s: [rng.randint(1, 20) for _ in range(3000)] for s in "abc"})
    p = plan(spark, [("a", 50.0, 1, 1, 0.4), ("b", 30.0, 1, 2, 0.4), ("c", 20.0, 1, 3, 0.4)])
    knots = spark.createDataFrame([("a", 0.0, 4.0), ("a", 0.5, 1.0), ("a", 1.0, 1.0), (" B", 0.0, 0.0), ("b", 1.0, 2.0), ("c", None, 1.0)], "source string, time double, factor double")
    rows = curriculum_mix.draw_mixture(docs, p, schedules=knots).collect()
    total = sum(r["n_tokens"] for r in rows)
    used, by = 0, {"a": 0, "b": 0, "c": 0}
    for r in rows:
        used += r["n_tokens"]
        by[r["source"]] += r["n_tokens"]
        # the position is the share of all tokens consumed
        assert abs(used / total - r["position"]) < 0.01
    assert all(abs(by[s] / total - w) < 0.005 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    early = [r for r in rows if r["position"] < 0.1]
    assert sum(r["n_tokens"] for r in early if r["source"] == "a") > 0.6 * sum(r["n_tokens"] for r in early)
    assert sum(r["n_tokens"] for r in early if r["source"] == "b") < 0.1 * sum(r["n_tokens"] for r in early)


def test_empty_documents_and_plan(spark):
    docs = sized(spark, {}), sized(spark, {"a": [1]})
    assert curriculum_mix.draw_mixture(docs[0], plan(spark, [("a", 1.0, 1, 1, 1.0)])).collect() == []
    assert curriculum_mix.draw_mixture(docs[1], plan(spark, [])).collect() == []
    raw = spark.createDataFrame([(1, "a", None), (2, " A", "some text"), (2, "a", "some text"), (None, "a", "x")], "doc_id bigint, source string, text string")
    assert [(r["doc_id"], r["source"]) for r in curriculum_mix.sized_documents(raw).collect()] == [(2, "a")]


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
