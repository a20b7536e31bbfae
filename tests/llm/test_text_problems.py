from __future__ import annotations

import base64
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainloom.llm import encode_corpus, generated_code, hidden_event_sentences, leak_tiling, text_stats, token_budget
from grainloom.llm.common import tokenizer_file

ITEM = "without warning the falconer spins around a quartz typewriter after somebody holding ninety tokens stares at the violet canoe, and a crowd claps. Why?"
ZH_ITEM = "把硫磺放入盛有玄武岩的容器并观察浮力，实验组样本的线粒体与对照组相比密度偏低，把石英放入盛有硫磺的容器。"


# -- tokenizer trie ---------------------------------------------------------------------------------------------------


def reference_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb"))}
    from grainloom.llm.bpe_trie import PIECE_PATTERN

    return tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_counts_equal_a_plain_encoder(spark):
    rng = random.Random(2)
    alphabet = "aàb 1²½_'sté 中文ไทยका　\n\t\x1c\x85 ..!!\U0001f33f̀ＡＢ<|endoftext|>"
    texts = ["", None, "   \n ", "<|endoftext|>", "a" * 3000, " " * 500] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "", "x")], "doc_id bigint, text string, ids string")
    plain = reference_encoder()
    ideal = {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}
    rows = encode_corpus.encode_corpus(df).collect()
    assert len(rows) == len(texts) + 1 and all(r["ids"] == ideal[r["doc_id"]] for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_budget.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in ideal.items()}
    assert encode_corpus.encode_corpus(df.limit(0)).collect() == []


def test_audit_of_recorded_totals(spark):
    clean = spark.createDataFrame([(1, "one two"), (2, "three"), (2, "three"), (3, None)], "doc_id bigint, text string")
    idx = [("s", 0, 1, 0, 3, 3), ("s", 0, 2, 3, 5, None), ("s", 0, 2, 3, 5, None), ("s", 1, 3, None, None, None), ("s", 2, 1, 0, 3, 3)]
    docs_idx = spark.createDataFrame(idx, "subset string, part bigint, doc_id bigint, start_off bigint, end_off bigint, tokens bigint")
    recs = [("r1", "s", 0, 2, 99, 1), ("r2", "s", 0, 2, 5, 2), ("r1", "s", 1, 1, 1, 1), ("r1", "s", 2, 1, None, 1), ("r1", "s", 9, 0, 4, 1), ("r1", "s", 9, 0, 4, 1)]
    docs = spark.createDataFrame(recs, "run_id string, subset string, part bigint, docs bigint, tokens bigint, written_at bigint")
    got = {r["part"]: (r["status"], r["unindexed"]) for r in token_budget.audit_parts(clean, docs_idx, docs).collect()}
    # a document without a recorded length adds nothing: its tokens under another tokenizer are no part of the total
    assert got == {0: ("ok", 0), 1: ("differs", 1), 2: ("missing", 0), 9: ("differs", 0)}


def test_lengths_that_do_not_fit_their_text(spark):
    clean = spark.createDataFrame([(i, "one two three four five six " * 10) for i in range(20)] + [(None, "x"), (99, None)], "doc_id bigint, text string")
    idx = [("s", 0, i, 0, 60, 400 if i == 7 else 9 if i == 8 else None if i == 9 else 60) for i in range(20)] + [("s", 0, 99, None, None, None), ("s", 0, None, 0, 3, 3)]
    docs_idx = spark.createDataFrame(idx, "subset string, part bigint, doc_id bigint, start_off bigint, end_off bigint, tokens bigint")
    assert sorted(r["doc_id"] for r in token_budget.odd_lengths(clean, docs_idx).collect()) == [7, 8]
    assert token_budget.odd_lengths(clean.limit(0), docs_idx).collect() == []


def test_deliveries_of_an_id_give_one_whole_row(spark):
    df = spark.createDataFrame([(1, None, "d1", "one two"), (1, "en", "d2", "one two"), (1, "de", None, "one"), (None, "a", "b", "x"), (None, "a", "b", "x")], "doc_id bigint, lang string, domain string, text string")
    rows = token_budget.once_per_document(token_budget.count_tokens(df, ["doc_id", "lang", "domain"])).collect()
    assert sorted(((r["doc_id"] or 0), r["lang"], r["domain"]) for r in rows) == [(0, "a", "b"), (0, "a", "b"), (1, "en", "d2")]


# -- leaks ------------------------------------------------------------------------------------------------------------


def alter(kind):
    words = ITEM.split()
    if kind == "typos":
        return " ".join(w[0] + w[2] + w[1] + w[3:] if i % 6 == 3 and len(w) > 4 else w for i, w in enumerate(words))
    return {
        "plain": ITEM,
        "capitals": ITEM.upper(),
        "markup": " ".join(f"**{w}**" if i % 3 else f"<b>{w}</b>" for i, w in enumerate(words)),
        "invisible": "".join(c + ("​" if i % 5 == 0 else "") for i, c in enumerate(ITEM)),
        "lookalikes": ITEM.replace("a", "а").replace("o", "о"),
        "lines": ITEM.replace(" ", "\n> "),
        "notes": " ".join(f"{w} [{i}]" if i % 5 == 0 else w for i, w in enumerate(words)),
        "dropped": " ".join(w for i, w in enumerate(words) if i % 7 != 6),
        "put in": " ".join(f"{w} very" if i % 7 == 6 else w for i, w in enumerate(words)),
        "part": " ".join(words[2:18]),
    }[kind]


KINDS = ["plain", "capitals", "markup", "invisible", "lookalikes", "lines", "notes", "dropped", "put in", "part", "typos"]


def test_leaks_of_every_alteration_and_no_others(spark):
    around = "The meadow stood beside the mill for years. {} Then the bakers went home and slept."
    docs = [(i, around.format(alter(k))) for i, k in enumerate(KINDS)]
    negatives = [ITEM.split(" after ")[0], " ".join(reversed(ITEM.split())), "Quite suddenly that bird handler twirled near an old machine made of stone.", "", None, " ".join(ITEM.split()[:11])]
    docs += [(100 + i, around.format(t) if t else t) for i, t in enumerate(negatives)] + [(0, docs[0][1]), (200, ZH_ITEM.replace("与", "與").replace("组", "組")), (None, ITEM)]
    items = [(1, ITEM), (2, ITEM), (3, ZH_ITEM), (4, "too short an item"), (5, None), (6, ""), (None, ITEM)]
    found = leak_tiling.leaked_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame([], "ngram string")
    ).collect()
    assert sorted(found) == sorted([(i, k) for i in range(len(KINDS)) for k in (1, 2)] + [(200, 3)])


def slipped(word):
    return word[0] + word[2] + word[1] + word[3:]


def test_no_passage_that_tiling_accepts_is_dropped_before_it(spark):
    words = "falconer marble typewriter juniper canoe violet squirrel ninety tokens harbour crowd lantern pickle velvet".split()
    other = lambda places, w: " ".join("zzz" if i in places else slipped(x) if i in w else x for i, x in enumerate(words[:13], 1))
    docs = [(1, other({3, 6}, ())), (2, other({3, 11}, ())), (3, other({8, 11}, ())), (4, other({4, 7, 10}, ())), (5, other((), {3, 6, 9})), (6, other((), {3, 4, 7, 8, 11})), (7, other({3, 6, 9, 12}, ()))]
    tail = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    docs += [(8, " ".join(tail[-9:] + words[:5]))]
    fragments = [(" ".join(tail[i : i + 13]),) for i in range(2)]
    items = [(1, " ".join(words)), (2, " ".join(tail + words[:6]))]
    found = leak_tiling.leaked_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(fragments, "ngram string")
    ).collect()
    assert sorted(found) == [(i, 1) for i in range(1, 7)] + [(8, 2)]


def test_every_item_of_an_exact_run_counts_whatever_its_rivals(spark):
    a = "falconer marble typewriter juniper canoe violet squirrel ninety tokens harbour crowd lantern pickle velvet orchard thimble walnut saddle copper meadow".split()
    b = [*a[:14], "zeppelin", *a[15:19], "end"]
    short = [*a[:9], "zeppelin", "anchor", *a[11:15], "end"]
    generic = "read the short passage below with care and then choose the one option that best completes the final sentence".split()
    fragments = [(" ".join(generic[i : i + 13]),) for i in range(len(generic) - 12)]
    fourth = [*generic, "xylophone", "gravel", *a[5:19]]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(short)), (4, " ".join(fourth))]
    docs = [(1, " ".join(a)), (2, " ".join([*generic, "one", "two", "three", "four", "five", "six", *a[5:19]]))]
    found = leak_tiling.leaked_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(fragments, "ngram string")
    ).collect()
    assert sorted(found) == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 4)]


def test_a_part_of_a_chain_that_holds_is_found():
    words = [f"word{x}" for x in "abcdefghijklmn"]
    item = [*words[:6], "altered", *words[7:], "xx", "yy", "pp", "qq", "vv", "ww", "rr", "ss", "uu", "zz"]
    window = [*words[:6], "other", *words[7:], "k1", "k2", "pp", "qq", "k3", "k4", "rr", "ss", "k5", "k6", "zz"]
    _, found = leak_tiling.passages(item, window, np.zeros(len(item), bool))
    assert any(p.span == 14 and p.matched == 13 for p in found)


def test_blocks_of_items_give_what_one_block_gives(spark):
    rng = random.Random(11)
    vocab = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    templates = [[rng.choice(vocab) for _ in range(20)] for _ in range(6)]
    items, docs = [], []
    for k in range(40):
        words = list(rng.choice(templates))
        for place in rng.sample(range(20), 3):
            words[place] = rng.choice(vocab)
        items.append((k, " ".join(words)))
    for k in range(60):
        words = items[rng.randrange(40)][1].split()
        for place in rng.sample(range(20), rng.randint(0, 5)):
            words[place] = rng.choice(vocab)
        docs.append((k, " ".join([*(rng.choice(vocab) for _ in range(5)), *words])))
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame([], "ngram string")
    one = sorted(leak_tiling.leaked_items(*frames).collect())
    assert one and one == sorted(leak_tiling.leaked_items(*frames, block_units=150).collect())
    # tiling every pair, whatever its runs, finds the same
    index = leak_tiling.ItemIndex([leak_tiling.Item(x.split(), np.zeros(20, bool)) for _, x in items])
    for _, text in docs:
        window = text.split()
        every = {i for i, x in enumerate(index.items) if leak_tiling.passages(x.tokens, window, x.generic)[1]}
        assert every == {x.item for x in leak_tiling.examine(window, index)[0]}


def test_reordered_blocks_are_covered(spark):
    words = "falconer marble typewriter juniper canoe violet squirrel ninety tokens harbour crowd lantern pickle velvet orchard thimble walnut saddle copper meadow ribbon candle garden".split()
    words += "sparrow kettle bishop magnet pepper".split()
    docs = [(1, "Before. " + " ".join(words[18:]) + " between these " + " ".join(words[9:18]) + " and then some more " + " ".join(words[:9]) + " after."), (2, " ".join(words[:9])), (3, None), (4, "")]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short"), (3, None)], "item_id bigint, text string")
    frame, none = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "ngram string")
    assert leak_tiling.item_coverage(frame, items, none).collect() == [(1, 1, 1.0)]
    assert leak_tiling.leaked_items(frame, items, none).collect() == []


def test_markup_of_any_length_is_taken_out():
    words = ITEM.split()
    for n in (100, 260, 5000):
        address = "http://x.example/" + "a" * n
        text = " ".join(f'<a href="{address}" title="one two three">{w}</a> <!-- {"x " * n} -->' for w in words)
        assert leak_tiling.units(text) == leak_tiling.units(ITEM)
        assert leak_tiling.units(" ".join(f"[{w}]({address})" for w in words)) == leak_tiling.units(ITEM)
    assert leak_tiling.units("if x <y then " + "word " * 100 + "z> 2 end").count("word") == 100
    began = time.time()
    for bad in ("<a ", "<!-- ", "](", "<b x="):
        leak_tiling.units(bad * 100_000)
    assert time.time() - began < 20


def test_generic_fragments_do_not_count(spark):
    generic = "read the short passage below with care and then choose the one option that best completes the final sentence"
    words = generic.split()
    fragments = spark.createDataFrame([(" ".join(words[i : i + 13]),) for i in range(len(words) - 12)], "ngram string")
    items = spark.createDataFrame([(1, f"{generic} of {ITEM}")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"Well: {generic}."), (2, f"Well: {ITEM}")], "doc_id bigint, text string")
    assert leak_tiling.leaked_items(docs, items, fragments).collect() == [(2, 1)]


def test_tiles_cover_reordered_blocks_and_never_overlap():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 30))]
        found = leak_tiling.tiles(a, b, 2)
        used_a = [p + k for p, _, n in found for k in range(n)]
        used_b = [t + k for _, t, n in found for k in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[p + k] == b[t + k] for p, t, n in found for k in range(n))
        free_a, free_b = set(range(len(a))) - set(used_a), set(range(len(b))) - set(used_b)
        assert not any({i, i + 1} <= free_a and {j, j + 1} <= free_b and a[i : i + 2] == b[j : j + 2] for i in range(len(a) - 1) for j in range(len(b) - 1))
    assert sum(n for _, _, n in leak_tiling.tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3], 2)) == 6


def test_very_long_documents_are_searched_whole():
    import numpy as np

    bitmap = np.full(1 << (leak_tiling.FILTER_BITS - 3), 255, np.uint8)
    windows = leak_tiling.document_windows(["word " * 10_000, None, ""], bitmap)
    assert len(windows) > 5 and all(i == 0 for i, _ in windows) and max(len(w.split()) for _, w in windows) <= leak_tiling.BLOCK


# -- text statistics --------------------------------------------------------------------------------------------------

COMMON = [("the",), ("of",), ("and",), ("in",), ("is",), ("that",), ("的",), ("了",), (None,)]
PROSE = "The house of the miller stood in the valley, and the river ran past it. Nobody knew that it is old.\n\nIn the morning the bakers came and sat down."


@pytest.mark.parametrize(
    "text, kind",
    [
        (None, "blank"),
        ("", "blank"),
        (" \n\t", "blank"),
        (PROSE, "prose"),
        ("Short note.", "prose"),
        (PROSE.replace(". ", " ").replace(".", "").replace(",", "").lower(), "prose"),
        (PROSE.replace(" the ", "\nthe "), "prose"),
        (PROSE + "\n\n- one\n- two\n", "prose"),
        ("\n".join(f"- item {i}" for i in range(20)), "list"),
        ("\n".join(f"Chapter {i}\nNotes on the loom" for i in range(10)), "list"),
        ("\n".join(f"row{i},{i},{i * 2},n/a" for i in range(20)), "table"),
        ("\n".join(f"| a | {i} |" for i in range(20)), "table"),
        ("\n".join(f"2026-01-0{i} 10:00 INFO id={i}2345 rc=0" for i in range(1, 9)), "junk"),
        ("0af21aac609c6afab97f6f766ffce3e51d2b3d59b46e320da23765160414097e\n" * 5, "junk"),
        ("house river " * 60, "junk"),
        ("#$%^ &*( )_+ $%^&* " * 10, "junk"),
    ],
)
def test_kinds(spark, text, kind):
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    words = spark.createDataFrame(COMMON, "word string")
    rows = text_stats.text_statistics(text_stats.text_counts(df, words)).collect()
    assert [r["kind"] for r in rows] == [kind]


def test_chunks_merge_to_the_whole():
    from dataclasses import asdict

    rng = random.Random(7)
    common = frozenset(w for (w,) in COMMON if w)
    pool = ["the", "of", "house", "汉", "的", " ", "  ", "\n", "- x", ".", "1,2,3", "|", "\t", "longerword", "It ends. ", "why?” ", "a1b2c3d4", "....... 12", " > ", "2026-01-01 10:00:00", "n/a", "名字：值", "。", "_"]
    for k in range(400):
        # half of the texts are one line, which every cut goes through
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 80)))
        text = text.replace("\n", " ") if k % 2 else text
        whole = text_stats.Chunk.of(text, common).total()
        size = rng.choice([17, 23, 31, rng.randint(1, 9)])
        parts = [text_stats.Chunk.of(text[i : i + size], common) for i in range(0, len(text), size)]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [parts[at].merge(parts[at + 1], common)]
        assert asdict(parts[0].total()) == asdict(whole), (text, size)


def test_long_documents_take_the_chunked_way(spark):
    rows = [(1, PROSE * 30), (2, PROSE), (None, PROSE), (None, PROSE * 31), (3, (PROSE * 200).replace("\n", " ")), (3, PROSE), (4, "a,1,2\r\n" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = spark.createDataFrame(COMMON, "word string")
    one = sorted(map(tuple, text_stats.text_counts(df, words).collect()), key=str)
    cut = sorted(map(tuple, text_stats.text_counts(df, words, chunk=200).collect()), key=str)
    assert len(one) == len(rows)
    # the two line signs of a break count as one where a text is cut
    assert [r for r in one if r[0] != 4] == [r for r in cut if r[0] != 4]
    shown = text_stats.text_statistics(text_stats.text_counts(df, words, chunk=200)).collect()
    assert sorted((r["doc_id"] or 0, r["chars"]) for r in shown) == sorted([(1, len(PROSE) * 30), (2, len(PROSE)), (0, len(PROSE)), (0, len(PROSE) * 31), (3, len(PROSE) * 200), (4, 1800)])


def test_a_huge_line_is_counted_in_linear_time():
    common = frozenset(w for (w,) in COMMON if w)

    def seconds(n):
        text = (PROSE.replace("\n", " ") + " ") * n
        began = time.process_time()
        parts = [text_stats.Chunk.of(text[i : i + 4096], common) for i in range(0, len(text), 4096)]
        while len(parts) > 1:
            parts = [parts[i].merge(parts[i + 1], common) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return time.process_time() - began

    assert seconds(8000) < 16 * max(seconds(1000), 0.05)


def test_lines_counted_together_give_what_each_gives():
    from dataclasses import asdict

    rng = random.Random(11)
    common = frozenset(w for (w,) in COMMON if w)
    pool = ["the ", "of ", "house", "The ", "汉", "的", "了", " ", "  ", "- x", ".", ". ", "1,2,3", ",-3.5%,", "|", "\t", "N/A", "It ends. ", "why?” ", "Ab0=" * 9, "....... 12", "… 7", " > ", "2026-01-01 10:00:00", "名字：值", "。", "_", "İ", "ΑΣ", "Ⅷ", "\u2028", "ไทย", "।", "क", "😀", "$%", "(a) ", ":", "!"]
    for _ in range(600):
        lines = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        apart = text_stats.Counts(chars=len(lines) - 1, spaces=len(lines) - 1)
        for line in lines:
            # a single line is summarised as a piece, with every measure taken
            apart.add(text_stats.Chunk.of(line, common).total())
        assert asdict(text_stats.count_lines("\n".join(lines), common)) == asdict(apart), lines


def test_lines_take_few_passes_over_their_text(monkeypatch):
    common = frozenset(w for (w,) in COMMON if w)
    scanned = []

    class Counted:
        def __init__(self, pattern):
            self.match = pattern.match
            for name in ("findall", "search", "split"):
                setattr(self, name, lambda text, *at, scan=getattr(pattern, name): scanned.append(len(text)) or scan(text, *at))
            self.sub = lambda new, text: scanned.append(len(text)) or pattern.sub(new, text)

    for name, value in list(vars(text_stats).items()):
        if isinstance(value, re.Pattern):
            monkeypatch.setattr(text_stats, name, Counted(value))
    for line in (PROSE, "Никто не знал, что дом старый, и река текла мимо.", "- item, with no end", "Notes on the loom"):
        scanned.clear()
        text = f"{line}\n" * 200
        text_stats.Chunk.of(text, common).total()
        # all measures of each line take seven passes or more
        assert sum(scanned) < 5 * len(text), line


# -- code -------------------------------------------------------------------------------------------------------------

HAND = "import os\n\n# the report below is generated by the nightly job\ndef carry(row, limit=3):\n    total = limit\n    for x in row:\n        total += x\n    return total\n"


@pytest.mark.parametrize(
    "path, code, kind",
    [
        ("a.py", HAND, None),
        ("vendor_portal/a.py", HAND, None),
        ("a.min.js", HAND, None),
        ("a.py", "# writes the 'do not edit' banner into its output\n" + HAND, None),
        ("a.py", None, None),
        ("vendor/x/a.py", " \n", None),
        (None, "// Code generated by gen 1.2. DO NOT EDIT.\n" + HAND, "generated"),
        ("a.py", HAND + "# Machine written; source of truth: schema.yaml\n", "generated"),
        ("a.rs", "// 本文件由工具自动生成，请勿手动修改\n" + HAND, "generated"),
        ("a.js", "\n".join(f"  Loom.prototype.loom_{i} = function (v) {{ return this._f[{i}] = v; }};" for i in range(12)), "generated"),
        ("poetry.lock", HAND, "generated"),
        ("third_party/x/a.py", HAND, "vendored"),
        ("a.py", "# @license x - see upstream for terms; @version 1.2\n" + HAND, "vendored"),
        ("a.js", "!function(t,e){" + "if(a&&!b)c(1,d);var x=t(j[3]);" * 30 + "}", "minified"),
        ("a.c", "static const short t[] = {\n" + "  1, 22, 333, -4, 55, 6, 777, 88,\n" * 12 + "};\n", "data"),
        ("a.py", 'X = """\n' + ("4RSWK5CBmJ4y77Hocr6UKpgGDnr2VFOBfr3HKib4pfLQ8nm8T6uwCIs6Tw15hu6pd1k4g\n" * 6) + '"""\n', "data"),
    ],
)
def test_file_kinds(spark, path, code, kind):
    df = spark.createDataFrame([(1, path, code), (1, path, code)], "file_id bigint, path string, code string")
    assert [r["kind"] for r in generated_code.not_hand_written(df).collect()] == ([kind] if kind else [])


def test_unmarked_changed_copies_are_found(spark):
    names = "abcdefghijkl"
    library = "\n".join(f"def helper_{i}(value_{i}):\n    return value_{i} * scale_{i} + offset_{i}" for i in names)
    other = "\n".join(f"def mine_{i}(thing_{i}):\n    return thing_{i} - rate_{i} + shift_{i}" for i in names)
    changed = library.replace("offset_c", "moved").replace("def helper_e", "def renamed").replace("\n", "\r\n")
    rows = [(1, "vendor/x/x.py", library), (2, "app/util.py", changed), (3, "app/own.py", other), (4, "app/half.py", "\n".join(library.split("\n")[:4]) + "\n" + other)]
    found = generated_code.not_hand_written(spark.createDataFrame(rows, "file_id bigint, path string, code string")).collect()
    assert {r["file_id"] for r in found} == {1, 2}
    assert generated_code.not_hand_written(spark.createDataFrame([], "file_id bigint, path string, code string")).collect() == []


@pytest.mark.parametrize("times", [1, 5])
def test_a_library_with_many_unmarked_copies_is_found(spark, times):
    names = "abcdefghijkl"
    library = [f"    return value_{i} * scale_{i} + offset_{i}" for i in names]
    idiom = ["import argparse, logging", "def main(arguments):", "if __name__ == '__main__':", "    main(sys.argv[1:])"]
    hand = [idiom + [f"    rate_{k} = thing_{i} - shift_{k}" for i in "abcdef"] for k in range(20 * times)]
    marked = [("vendor/x/x.py", [*idiom, *library])] * (2 * times)
    copies = [("app/util.py", [*idiom, *library[: k % 12], f"changed_line = {k}", *library[k % 12 + 1 :]]) for k in range(20 * times)]
    part = [("app/part.py", library[:6] + ["own_line_of_code = 1"])]
    files = marked + copies + part + [("app/own.py", x) for x in hand]
    rows = [(i, path, "\n".join(x)) for i, (path, x) in enumerate(files)]
    found = generated_code.not_hand_written(spark.createDataFrame(rows, "file_id bigint, path string, code string")).collect()
    assert {r["file_id"] for r in found} == set(range(22 * times + 1))


# -- sentences --------------------------------------------------------------------------------------------------------

SENTENCES = [
    ["Dr. Ash met Prof. Lee at 3.5 km.", "It cost $1.2 million, i.e. more.", "See Fig. 2 and Sec. 4."],
    ['"We go. We never stay," said Ann, and left.', "(He saw it.)", "Is it “not old.”", "Yes!"],
    ["And so it ended...", "The bakers waited... and then slept.", "Really?!", "A. B. Lee wrote it."],
    ["如果需求下降，就得重新讨论。", "“别动！”他喊了一声，没有人听见。", "价格是3.5元。", "《书！》是一本好书。", "这个结果……有点意外。"],
    ["Am 1. März kamen 20 Leute.", "„Sie sind weg!“, rief er.", "Das kostet ca. 5 Taler."],
    ["«Не трогайте!» — крикнул он.", "Дом на ул. Речной, и др. дома."],
    ["¿Quién fue?", "—No toques eso —dijo la Sra. Paz.", "¡Qué cosa!"],
    ["गाँव के लोग आए।", "डॉ. Lee ने 5 गिने।"],
]


def test_copies_of_a_library_that_an_earlier_file_bundles_are_found(spark):
    rng = random.Random(21)
    line = lambda: f"value_{rng.randrange(10**9)} = call_{rng.randrange(10**9)}(argument)"
    library, other = [line() for _ in range(20)], [line() for _ in range(90)]
    # all lines of the small library lead to the bundle, of which they are less than half
    rows = [(1, "vendor/bundle.py", "\n".join(other + library)), (2, "vendor/small.py", "\n".join(library))]
    rows += [(10 + k, f"src/a{k}.py", "\n".join([*library[:18], line(), line()])) for k in range(15)]
    rows += [(50 + k, f"src/b{k}.py", "\n".join([*library[:6], *(line() for _ in range(14))])) for k in range(15)]
    lines = spark.createDataFrame([(i, i < 10, x) for i, _, text in rows for x in generated_code.line_prints(text)], "file_id bigint, marked boolean, line bigint")
    whole = generated_code._whole_copies(lines, lines.where("NOT marked")).collect()
    prints = {i: set(generated_code.line_prints(text)) for i, _, text in rows}
    agree = {i for i in prints if i > 9 and any(2 * len(prints[i] & prints[m]) >= max(len(prints[i]), len(prints[m])) for m in (1, 2))}
    assert sorted(r["file_id"] for r in whole) == sorted(agree) == list(range(10, 25))
    found = generated_code.not_hand_written(spark.createDataFrame(rows, "file_id bigint, path string, code string")).collect()
    assert {r["file_id"] for r in found} == {1, 2, *range(10, 25)}


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_of_a_line(parts):
    model = hidden_event_sentences.train([" ".join(p) for p in SENTENCES])
    joiner = "" if parts[0][0] in "如" else " "
    text = joiner.join(parts)
    assert [text[a:b] for a, b in hidden_event_sentences.split_sentences(text, model)] == parts


def test_layout_and_unpunctuated_scripts(spark):
    rows = [
        (1, "# A heading\n- one (2.5 kg)\n- two\n\nPlain text here.\r\nAnother line", "web"),
        (2, "the first line of a paragraph that is merely\nwrapped to a certain width goes on here and\ncontinues up to its end in the fourth of the\nlines of it.", "web"),
        (3, "第一个句子没有标点 第二个句子也没有 价格是 25 元", "web"),
        (4, "ช่างไม้กลับบ้าน ราคา 85 บาท", "web"),
        (5, "int main() { return 0; }", " Code"),
        (6, None, "web"),
        (7, " \n ", None),
        (8, "Same.", None),
        (8, "Same.", None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {}
    text = {r[0]: r[1] for r in rows}
    for r in sorted(hidden_event_sentences.sentence_units(df).collect()):
        got.setdefault(r["doc_id"], []).append(text[r["doc_id"]][r["sent_start"] : r["sent_end"]])
    assert got[1] == ["# A heading", "- one (2.5 kg)", "- two", "Plain text here.", "Another line"]
    assert got[2] == [text[2]]
    assert got[3] == ["第一个句子没有标点", "第二个句子也没有", "价格是 25 元"]
    assert got[4] == ["ช่างไม้กลับบ้าน", "ราคา 85 บาท"]
    assert got[8] == ["Same."] * 2 and set(got) == {1, 2, 3, 4, 8}
    assert hidden_event_sentences.sentence_units(df.limit(0)).collect() == []


@pytest.mark.parametrize("words, mark", [(("我们 他们 这个老人 村里的孩子 那位老师", "喜欢 看见了 带来了 忘记了 找到了", "苹果 一条大河 新的书本 古老的故事 白色的马"), "。"), (("ช่างไม้ ครู เด็กชาย แม่ค้า", "กลับบ้าน ขายดอกไม้ อ่านหนังสือ ทำอาหาร", "เมื่อวาน ทุกเช้า ตอนเย็น"), " ")])
def test_scripts_without_marks_and_blanks_are_split(words, mark):
    rng = random.Random(1)
    lists = [w.split() for w in words]
    sentence = lambda: "".join(rng.choice(x) for x in lists)
    model = hidden_event_sentences.train([mark.join(sentence() for _ in range(20)) + mark.strip() for _ in range(200)])
    right = found = true = 0
    for _ in range(40):
        parts = [sentence() for _ in range(8)]
        text = "".join(parts)
        got = {b for _, b in hidden_event_sentences.split_sentences(text, model)}
        ideal = {sum(map(len, parts[: k + 1])) for k in range(8)}
        right, found, true = right + len(got & ideal), found + len(got), true + len(ideal)
    assert right >= 0.95 * found and right >= 0.9 * true


def test_open_quotations_hide_nothing_and_cost_no_time():
    assert hidden_event_sentences._spans("(" * 300 + "“x”", 0, 303) == [(300, 303, "“")]
    assert hidden_event_sentences._spans('“a” (b "c" d)', 0, 13) == [(0, 3, "“"), (4, 13, "(")]
    began = time.time()
    hidden_event_sentences._spans('("' * 200_000, 0, 400_000)
    assert time.time() - began < 20


def test_time_grows_with_the_text_in_a_script_without_blanks():
    text = "村里的人都来了。" * 20_000
    began = time.process_time()
    model = hidden_event_sentences.train([text])
    spans = hidden_event_sentences.split_sentences(text, model)
    assert time.process_time() - began < 10
    assert spans == [(k, k + 8) for k in range(0, len(text), 8)]


def test_characters_of_texts_counted_together_do_not_meet():
    texts = ["我们来了。", "他们", "\n村里的人 都来了", "ascii. ", "", "Été.", "ก", "了"]
    slots = (len(hidden_event_sentences.CHAR_TABLES), hidden_event_sentences.CHAR_SLOTS)
    together, single = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    hidden_event_sentences.char_counts(texts, together)
    for text in texts:
        hidden_event_sentences.char_counts([text], single)
    assert together.sum(axis=1).tolist() == [15, 2, 2, 9, 2]
    assert (together == single).all()


def test_every_character_is_in_one_sentence():
    rng = random.Random(3)
    pool = ["Dr.", "word", "Word", "。", "汉字", "“", "”", '"', "(", ")", "!", "?", "...", "\n", "\r\n", "\n\n", " ", "  ", "1.", "- ", "3.5", "»", "«", " ", "ก"]
    model = hidden_event_sentences.train(["One. Two. Three e.g. four. " * 3])
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        spans = hidden_event_sentences.split_sentences(text, model)
        covered = [i for a, b in spans for i in range(a, b)]
        assert covered == sorted(set(covered))
        assert {i for i, c in enumerate(text) if not c.isspace()} <= set(covered)
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_columns_with_clashing_names_are_ignored(spark):
    df = spark.createDataFrame([(1, "One. Two.", "web", 9, 9)], "doc_id bigint, text string, source string, sent_start int, ids int")
    assert hidden_event_sentences.sentence_units(df).count() == 2
    assert encode_corpus.encode_corpus(df.withColumn("ids", F.lit(1))).count() == 1
