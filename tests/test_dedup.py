from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import decontam as dc
from grainloom.operators import dedup as dd
from grainloom.operators import paragraphs as pg


def docs_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_rank bigint, text string")


def edited(words, share, rng):
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in words)


def test_labels_of_edited_documents(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 2999)}" for _ in range(400)] for _ in range(3)]
    texts = [" ".join(base[0]), " ".join(base[1]), edited(base[0], 0.01, rng), " ".join(base[2]), edited(base[0], 0.6, rng), " ".join(base[2]), None, ""]
    got = {r["doc_rank"]: r["rep"] for r in dd.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 3, 6: 6, 7: 6}


def test_signature_matches_big_integers(spark):
    a, b = dd.coefficients()
    assert (int(a[0]), int(b[0])) == (2032329983, 1750752463)
    rng = random.Random(6)
    sets = [[0, 1, 2**32 - 1, zlib.crc32(b"some words of a shingle")], [7], [rng.randrange(2**32) for _ in range(3000)], [0]]
    got = dd.sign_values(np.array([v for x in sets for v in x], np.uint64), np.cumsum([0, *map(len, sets)]))
    for values, sig in zip(sets, got.tolist()):
        assert sig == [min((int(x) * v + int(y)) % (2**61 - 1) & (2**32 - 1) for v in values) for x, y in zip(a, b)]


def test_shingle_values_are_those_of_the_shingles(spark):
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f g é 漢", "漢字 混ぜ text 12", "x" * 30]
    df = spark.createDataFrame([(i, t, z) for i, t in enumerate(texts) for z in (False, True)], "doc_rank bigint, n string, zh boolean")
    rows = dd.with_shingles(df, "n", "s", by_char=F.col("zh")).select("n", "zh", "s", F.transform("s", lambda s: dd.base_hash(s, "crc32")).alias("c"), F.transform("s", lambda s: dd.base_hash(s, "md5")).alias("m")).collect()
    for r in rows:
        assert set(dd.shingle_values(r["n"], r["zh"], "crc32").tolist()) == set(r["c"])
        assert set(dd.shingle_values(r["n"], r["zh"], "md5").tolist()) == set(r["m"])


def test_rows_of_shingles_are_the_shingles(spark, monkeypatch):
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f g é 漢", "漢字 混ぜ text 12 𠀀 x y", "x" * 30, "a a a a a a a a a", " ".join(map(str, range(300)))]
    df = spark.createDataFrame([(2 * i + z, t, bool(z)) for i, t in enumerate(texts) for z in (0, 1)], "doc_rank bigint, n string, zh boolean")
    ideal = dd.with_shingles(df, "n", "s", by_char=F.col("zh")).select("doc_rank", F.explode("s").alias("shingle"))
    assert dd.shingle_rows(df).schema.simpleString() == ideal.schema.simpleString()
    for most in (1 << 16, 7):
        monkeypatch.setattr(dd, "_SHINGLE_ROWS", most)
        assert sorted(map(tuple, dd.shingle_rows(df).collect())) == sorted(map(tuple, ideal.collect()))


def test_large_bucket_is_a_star(spark):
    banded = spark.createDataFrame([(0, 7, r) for r in range(40)], "band int, key bigint, doc_rank bigint")
    pairs = dd.candidate_pairs(banded).collect()
    assert sorted(pairs) == [(0, r) for r in range(1, 40)]


def test_links_that_a_star_misses_are_found(spark):
    rng = random.Random(8)
    family = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    # every text shares most of the family's words, its own part tells it from the others; one has a near duplicate
    texts = [" ".join([*family, *(f"own{k}x{rng.randint(0, 9999)}" for _ in range(110))]) for k in range(80)]
    words = texts[60].split()
    texts.append(" ".join([*words[:-3], "one", "two", "three"]))
    docs = docs_frame(spark, texts)
    signed = dd.sign_documents(docs)
    banded = dd.bands(signed)
    pairs = dd.verified_edges(dd.candidate_pairs(banded), signed).select("a", "b").collect()
    roots = spark.createDataFrame([], "node bigint, root bigint")
    large = spark.createDataFrame([(0, 7, r) for r in range(81)], "band int, key bigint, doc_rank bigint")
    assert (60, 80) not in dd.verified_edges(dd.candidate_pairs(large), signed).select("a", "b").collect()
    found = {(r["a"], r["b"]) for r in dd.links_across(large, signed, roots).collect()}
    assert (60, 80) in found and found >= {tuple(p) for p in pairs}
    sigs = {r["doc_rank"]: np.frombuffer(r["sig"], np.uint32) for r in signed.collect()}
    assert found == {(i, j) for i in sigs for j in sigs if i < j and (sigs[i] == sigs[j]).mean() >= dd.ALIKE}
    one = spark.createDataFrame([(r, 0) for r in range(81)], "node bigint, root bigint")
    assert dd.links_across(large, signed, one).count() == 0


def test_verification_rejects_chance_collisions(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, 256).tolist()
    b = a[:8] + rng.integers(0, 2**32, 248).tolist()
    rows = [(i, bytearray(np.array(x, np.uint32).tobytes()), [hash(tuple(x[k : k + 8])) for k in range(0, 256, 8)]) for i, x in enumerate((a, b))]
    signed = spark.createDataFrame(rows, "doc_rank bigint, sig binary, keys array<bigint>")
    assert dd.candidate_pairs(dd.bands(signed)).count() == 1
    assert dd.verified_edges(dd.candidate_pairs(dd.bands(signed)), signed).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = dict(dd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 130)}
    assert dd.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_pairs_against_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(60)] for _ in range(4)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-2], "end", "end"]) for b in base] + [" ".join(b[:30]) for b in base]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    ideal = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    got = {(r["a"], r["b"]) for r in dd.exact_near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == ideal and len(ideal) == 4


def test_frequent_shingles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dd, "HOT", 5)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([*base[:70], *(f"v{rng.randint(0, 3)}" for _ in range(10))]) for _ in range(40)]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    first = {t: texts.index(t) for t in texts}
    ideal = {(i, j) for i in first.values() for j in first.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert {(r["a"], r["b"]) for r in dd.exact_near_duplicates(docs_frame(spark, texts)).collect()} == ideal and len(ideal) > 30


def test_sets_of_shingle_values_are_those_of_the_shingles(spark):
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f", "a b c d e f g é 漢", "漢字 混ぜ text 12 𠀀 x y", "x" * 30, "a a a a a a a a a", "漢", "b c d e f"]
    rows = [(2 * i + z, t, bool(z)) for i, t in enumerate(texts) for z in (0, 1)]
    ideal = dict(dd.with_shingles(spark.createDataFrame(rows, "k bigint, n string, zh boolean"), "n", "s", by_char=F.col("zh")).select("k", "s").collect())
    values, bounds = dd.shingle_sets([t for _, t, _ in rows], [z for _, _, z in rows])
    made = {k: set(values[bounds[k] : bounds[k + 1]].tolist()) for k, _, _ in rows}
    assert all(len(made[k]) == bounds[k + 1] - bounds[k] == len(ideal[k]) for k in made)
    assert all(len(made[i] & made[j]) == len(set(ideal[i]) & set(ideal[j])) for i in made for j in made)


def test_exact_pairs_write_less_than_their_shingles(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(2000)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-9], "end"]) for b in base[:4]] + [" ".join(base[5])]
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")) if dd.shared_checkpoint(spark.range(1)) else None
    held = sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    assert sorted((r["a"], r["b"]) for r in dd.exact_near_duplicates(docs_frame(spark, texts)).collect()) == [(k, 40 + k) for k in range(4)]
    assert sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()) - held < 2000 * len(texts)
    packed = dd._postings(dd.normalized_documents(docs_frame(spark, texts)), dd.ALIKE).select(F.sum(F.length("postings"))).first()[0]
    assert packed < 9 * 0.22 * 2000 * len(texts)


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    folders = [Path(str(p)) for p in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for f in folders for p in f.rglob("shuffle_*.data")}
    before = files()
    made = dd.shared_checkpoint(spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n")))
    assert not files() - before and made.count() == 100


def test_only_candidates_signatures_are_joined(spark):
    signed = dd.sign_documents(docs_frame(spark, ["one two three four five six seven"] * 2 + [f"other text {k}" for k in range(9)]))
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a bigint, b bigint")
    assert dd.verified_edges(pairs, signed).collect() == [(0, 1, 1.0)]


def test_least_of_each_key(spark):
    rows = [(k % 50 if k > 40 else None if k < 3 else 1000 + k, f"t{k % 7}", f"s{k % 5}" if k % 3 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, subset string")
    ideal = df.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("subset").alias("subset"))
    assert sorted(map(repr, dd.least_of_each(df, "doc_id").collect())) == sorted(map(repr, ideal.collect()))


def test_edited_chinese_reposts_are_near_duplicates(spark):
    rng = random.Random(4)
    clauses = ["".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(20)) for _ in range(8)]
    text = "，".join(clauses)
    edited_text = "，".join("变" + c[1:] if i in (1, 5) else c for i, c in enumerate(clauses))
    rows = [(0, "zh_web", text), (1, "zh_wiki", edited_text), (2, "en_web", "some words of another text"), (3, None, "more words that stand alone")]
    docs = spark.createDataFrame(rows, "doc_rank bigint, subset string, text string")
    assert dict(dd.near_duplicates(docs, subset="subset").select("doc_rank", "rep").collect()) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert [(r["a"], r["b"]) for r in dd.exact_near_duplicates(docs, subset="subset").collect()] == [(0, 1)]
    assert dd.exact_near_duplicates(docs).count() == 0


def test_normalize(spark):
    df = spark.createDataFrame([("ＡＢ_c-ﬁ  x!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.normalize("t")).collect()] == ["ab c fi x", None, ""]


def test_windows_weigh_han_half():
    assert T.windows_of([f"w{i}" for i in range(12)]) == []
    assert len(T.windows_of([f"w{i}" for i in range(15)])) == 3
    assert len(T.windows_of(list("汉" * 27))) == 2
    assert len(T.windows_of(list("汉" * 25))) == 0
    rng = random.Random(1)
    for _ in range(200):
        units = [rng.choice(["汉", "word"]) for _ in range(rng.randint(0, 60))]
        brute = []
        for i in range(len(units)):
            held = 0
            for e in range(i, len(units)):
                held += 1 if units[e] == "汉" else 2
                if held >= 26:
                    brute.append(" ".join(units[i : e + 1]))
                    break
        assert T.windows_of(units) == brute


def test_contamination_names_the_first_bench(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = spark.createDataFrame([("b2", 1, item), ("b1", 2, item), ("b1", 3, "too short"), ("b3", 4, None)], "bench string, item_id bigint, text string")
    index = dc.eval_index(items)
    assert {r["bench"] for r in index.collect()} == {"b1"}
    docs = spark.createDataFrame([(1, f"Intro. {item.upper()}!"), (2, "nothing here"), (3, None)], "doc_id bigint, text string")
    assert dc.contaminated(docs, index).collect() == [(1, "b1")]
    exclude = index.select(F.col("gram").alias("ngram"))
    assert dc.contaminated(docs, dc.without_generic(index, exclude)).count() == 0
    assert {r["bench"]: r["too_short"] for r in dc.item_counts(items).collect()} == {"b1": 1, "b2": 0, "b3": 1}


def test_common_paragraphs_keep_their_first_occurrence(spark):
    notice = "this notice stands in each of the documents"
    texts = [f"one\n\n{notice}\n\nend", f"{notice}\n\n\ntwo\n\n{notice}", f"three\n\n{notice}", "four alone", None]
    got = {r["doc_rank"]: (r["text"], r["removed"]) for r in pg.strip_paragraphs(docs_frame(spark, texts)).collect()}
    assert got == {0: (f"one\n\n{notice}\n\nend", 0), 1: ("two", 2), 2: ("three", 1), 3: ("four alone", 0)}
    assert pg.common_paragraphs(pg.paragraph_keys(docs_frame(spark, texts[:2]))).count() == 0


def test_window_values_are_those_of_the_windows():
    rng = random.Random(5)
    made = dc.WindowValues()
    for _ in range(100):
        units = [rng.choice(["汉", "字", "word", "other", "third"]) for _ in range(rng.randint(0, 70))]
        got, ends, values = made.windows(" ".join(units))
        grams = [" ".join(got[i:e]) for i, e in enumerate(ends.tolist())]
        assert got == units and grams == T.windows_of(units)
        assert values.tolist() == [made.of_gram(g) for g in grams]
