"""Queries of near-duplicate detection, with their SQL. The SQL has no compatibility form, so both sides leave it out, and
takes the MD5 form of the base hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import dedup as dd
from grainloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]


#: Planted copies: the rank that is added to their original's, and what tells which documents have one.
PLANTED = 1_000_000_000_000
SPOTS = {"0": [0.5], "1": [0.25, 0.75], "2": [x / 11 for x in range(1, 11)]}


def planted(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of which a copy is planted, with the copy's text: one, two or ten characters are another sign, by hash.

    The tables hold equal texts but no near ones, so without these the queries below would compare empty results.
    """
    way, size = F.substring(F.md5(F.col(key).cast("string")), 1, 1), F.length(text)
    changed = F.col(text)
    for kind, shares in SPOTS.items():
        at = [F.floor(size * F.lit(x)).cast("int") for x in shares]
        parts = [F.substring(text, F.lit(1), at[0] - 1), *(F.substring(text, x + 1, y - x - 1) for x, y in zip(at, at[1:])), F.substring(text, at[-1] + 1, size)]
        made = F.concat(*[p for part in parts[:-1] for p in (part, F.lit("x"))], parts[-1])
        changed = F.when(way == kind, made).otherwise(changed)
    return rows.where(way.isin(*SPOTS) & (size > 400)).withColumn(text, changed)


def planted_sql(key: str, text: str = "text") -> tuple[str, str]:
    """The condition and the text of `planted`."""
    cases = []
    for kind, shares in SPOTS.items():
        at = [f"floor(length({text}) * {x!r}::DOUBLE)::INT" for x in shares]
        parts = [f"substr({text}, 1, {at[0]} - 1)", *(f"substr({text}, {x} + 1, {y} - {x} - 1)" for x, y in zip(at, at[1:])), f"substr({text}, {at[-1]} + 1)"]
        cases.append(f"WHEN '{kind}' THEN " + " || 'x' || ".join(parts))
    way = f"substr(md5({key}::VARCHAR), 1, 1)"
    return f"{way} IN ('{"', '".join(SPOTS)}') AND length({text}) > 400", f"CASE {way} {' '.join(cases)} END"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document once, and the planted copies."""
    docs = dd.least_of_each(t(spark, d, "clean", "doc_id", "text", "subset"), "doc_id")
    return docs.unionByName(planted(docs, "doc_id").withColumn("doc_id", F.col("doc_id") + PLANTED)).withColumn("doc_rank", F.col("doc_id"))


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each normalised text; copies are its class, not pairs."""
    norm = dd.normalized_documents(documents(spark, d), compatibility=False, subset="subset")
    return norm.groupBy("n").agg(F.min("doc_rank").alias("doc_rank"), F.min_by("zh", "doc_rank").alias("zh"))


def signed(spark: SparkSession, d: str) -> DataFrame:
    return dd.shared_checkpoint(dd.sign_texts(distinct_texts(spark, d), "md5").select("doc_rank", "sig", "keys"))


def _jaccard(s: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of each document and its planted copy."""
    sets = dd.with_shingles(dd.normalized_documents(documents(s, d), compatibility=False, subset="subset"), "n", "s", by_char=F.col("zh")).select("doc_rank", "s")
    copies = sets.where(F.col("doc_rank") >= PLANTED).select((F.col("doc_rank") - PLANTED).alias("doc_rank"), F.col("s").alias("c"))
    return sets.join(copies, "doc_rank").select("doc_rank", F.round(dd.jaccard(F.col("s"), F.col("c")), 6).alias("similarity"))


def _estimated(s: SparkSession, d: str) -> DataFrame:
    """Estimated similarity of each document and its planted copy."""
    sigs = dd.sign_documents(documents(s, d), compatibility=False, kind="md5", subset="subset").select("doc_rank", dd.signature_values("sig").alias("sig"))
    copies = sigs.where(F.col("doc_rank") >= PLANTED).select((F.col("doc_rank") - PLANTED).alias("doc_rank"), F.col("sig").alias("c"))
    return sigs.join(copies, "doc_rank").select("doc_rank", F.round(dd.estimated_jaccard(F.col("sig"), F.col("c")), 6).alias("similarity"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    sig = signed(s, d)
    return dd.verified_edges(dd.candidate_pairs(dd.bands(sig)), sig)


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return dd.near_duplicates(documents(s, d), compatibility=False, kind="md5", subset="subset").select(F.col("doc_rank").alias("doc_id"), F.col("rep").alias("rep_id"))


def _exact(s: SparkSession, d: str) -> DataFrame:
    return dd.exact_near_duplicates(documents(s, d), compatibility=False, subset="subset").select("a", "b", F.round("similarity", 6).alias("similarity"))


def _exact_dups(s: SparkSession, d: str) -> DataFrame:
    """Documents that are not the first of their exact class, over representatives."""
    return dd.components(dd.exact_near_duplicates(documents(s, d), compatibility=False, subset="subset")).where("node <> root").select(F.col("node").alias("doc_rank"))


def _lsh_dups(s: SparkSession, d: str) -> DataFrame:
    return dd.components(_edges(s, d)).where("node <> root").select(F.col("node").alias("doc_rank"))


def _precision(s: SparkSession, d: str) -> DataFrame:
    ideal = _exact_dups(s, d)  # first, while no signatures are kept
    pr = dd.precision_recall(_lsh_dups(s, d), ideal)
    return pr.select("got", "ideal", "common", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _buckets(s: SparkSession, d: str) -> DataFrame:
    sizes = dd.bands(signed(s, d)).groupBy("band", "key").agg(F.count("*").alias("n")).where("n >= 2")
    return sizes.groupBy("band").agg(F.count("*").alias("buckets"), F.sum("n").alias("members"), F.max("n").alias("largest"))


NORM_SQL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_COPIED, _COPY = planted_sql("doc_id")
_DOCS = f"""raw0 AS (SELECT doc_id, min(text) AS text, min(subset) AS subset FROM clean GROUP BY doc_id),
    raw1 AS (SELECT doc_id, text, subset FROM raw0 UNION ALL SELECT doc_id + {PLANTED}, {_COPY}, subset FROM raw0 WHERE {_COPIED}),
    docs AS (SELECT doc_id, coalesce(starts_with(subset, 'zh'), false) AS zh, {NORM_SQL.format('coalesce(text, chr(32))')} AS n FROM raw1)"""


def shingles_sql(docs: str = "docs", every: bool = False) -> str:
    """``once(n, doc_rank, zh)`` (the first, or every, document of a text) and ``sh(doc_rank, s)`` of ``docs(doc_id, zh, n)``."""
    once = "n, doc_id AS doc_rank, zh" if every else "n, min(doc_id) AS doc_rank, arg_min(zh, doc_id) AS zh"
    return f"""once AS (SELECT {once} FROM {docs} {"" if every else "GROUP BY n"}),
    words AS (SELECT doc_rank, zh, string_split(n, ' ') AS w, replace(n, ' ', '') AS c FROM once),
    sh AS (SELECT doc_rank, list_distinct(CASE WHEN zh THEN list_transform(range(1, greatest(length(c) - 4, 1) + 1), lambda i: substr(c, i, 5))
        ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)"""


_SHINGLES = f"{_DOCS}, {shingles_sql()}"


def _signature_sql() -> str:
    a, b = dd.coefficients()
    perms = ", ".join(f"({i}, {x}::UBIGINT, {y}::UBIGINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""perm(p, a, b) AS (VALUES {perms}),
    x AS (SELECT doc_rank, ('0x' || substr(md5(unnest(s)), 1, 8))::UBIGINT AS x FROM sh),
    mins AS (SELECT doc_rank, p, min(((a * x + b) % 2305843009213693951::UBIGINT) & 4294967295::UBIGINT) AS h FROM x, perm GROUP BY ALL),
    sig AS (SELECT doc_rank, list(h ORDER BY p) AS sig FROM mins GROUP BY doc_rank)"""


#: From ``sh`` on.
_SIGNING = _signature_sql()
_SIG = f"{_SHINGLES}, {_SIGNING}"
_BANDING = "bands AS (SELECT doc_rank, k AS band, sig[k * 8 + 1:k * 8 + 8] AS key FROM sig, range(0, 32) r(k))"
_BUCKETS = f"{_SIG}, {_BANDING}, buckets AS (SELECT band, key, count(*) AS n, min(doc_rank) AS first FROM bands GROUP BY ALL HAVING count(*) >= 2)"
_MEMBERS = """member AS (SELECT b.*, n, first FROM bands b JOIN buckets USING (band, key)),
    pairs AS (SELECT x.doc_rank AS a, y.doc_rank AS b FROM member x JOIN member y USING (band, key) WHERE x.doc_rank < y.doc_rank AND x.n <= 32
        UNION SELECT first, doc_rank FROM member WHERE n > 32 AND doc_rank <> first)"""
_PAIRS = f"{_BUCKETS}, {_MEMBERS}"
_VERIFIED = """edges AS (SELECT a, b, similarity FROM (SELECT a, b, len(list_filter(range(1, 257), lambda i: x.sig[i] = y.sig[i])) / 256.0::DOUBLE AS similarity
        FROM pairs JOIN sig x ON x.doc_rank = a JOIN sig y ON y.doc_rank = b) WHERE similarity >= 0.8)"""
_EDGES = f"{_PAIRS}, {_VERIFIED}"
_EXACT = f"""{_SHINGLES}, g AS (SELECT doc_rank, len(s) AS size, unnest(s) AS g FROM sh),
    shared AS (SELECT x.doc_rank AS a, y.doc_rank AS b, x.size AS sa, y.size AS sb, count(*) AS n FROM g x JOIN g y USING (g) WHERE x.doc_rank < y.doc_rank GROUP BY ALL),
    exact AS (SELECT a, b, n / (sa + sb - n)::DOUBLE AS similarity FROM shared WHERE n / (sa + sb - n)::DOUBLE >= 0.8)"""


def components_sql(edges: str, name: str) -> str:
    """Components by reachability; ``name`` has node and root."""
    return f"""{name}_sym AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
    {name}_walk AS (SELECT a AS node, a AS root FROM {name}_sym UNION SELECT s.b, w.root FROM {name}_walk w JOIN {name}_sym s ON s.a = w.node),
    {name} AS (SELECT node, min(root) AS root FROM {name}_walk GROUP BY node)"""


def classes_sql(docs: str) -> str:
    """``c(node, root)``, the classes of alike documents, and ``once``, of ``docs(doc_id, zh, n)``."""
    buckets = "buckets AS (SELECT band, key, count(*) AS n, min(doc_rank) AS first FROM bands GROUP BY ALL HAVING count(*) >= 2)"
    return ", ".join([shingles_sql(docs), _SIGNING, _BANDING, buckets, _MEMBERS, _VERIFIED, components_sql("edges", "c")])


QUERIES: dict[str, Query] = {
    "normalize_text": lambda s, d: documents(s, d).select("doc_id", T.normalize("text").alias("normalized")),
    "normalize_text_plain": lambda s, d: documents(s, d).select("doc_id", T.normalize("text", False).alias("normalized")),
    "shingles": lambda s, d: dd.shingle_rows(distinct_texts(s, d)),
    "shingles_by_char": lambda s, d: dd.with_shingles(distinct_texts(s, d), "n", "s", by_char=True).select("doc_rank", F.size("s").cast("bigint").alias("shingles")),
    "minhash_sig": lambda s, d: signed(s, d).select("doc_rank", F.array_join(dd.signature_values("sig").cast("array<string>"), ",").alias("sig")),
    "jaccard": _jaccard,
    "estimated_jaccard": _estimated,
    "lsh_buckets": _buckets,
    "lsh_pairs": lambda s, d: dd.candidate_pairs(dd.bands(signed(s, d))),
    "near_dup_edges": lambda s, d: _edges(s, d).select("a", "b", F.round("similarity", 6).alias("similarity")),
    "near_dup_clusters": _clusters,
    "dedup_docs": lambda s, d: _clusters(s, d).where("doc_id <> rep_id").select("doc_id"),
    "exact_near_dup": _exact,
    "dedup_pr": _precision,
    "lsh_curve": lambda s, d: s.range(0, 21).select((F.col("id") / 20).alias("j"), F.round(dd.candidate_probability(F.col("id") / 20), 6).alias("p")),
}

ORACLE: dict[str, str] = {
    "normalize_text_plain": f"WITH {_DOCS} SELECT doc_id, {NORM_SQL.format('text')} AS normalized FROM raw1",
    "jaccard": f"""WITH {_DOCS}, {shingles_sql("docs", every=True)}
        SELECT a.doc_rank, round(len(list_intersect(a.s, b.s)) / greatest(1, len(list_distinct(list_concat(a.s, b.s))))::DOUBLE, 6) AS similarity FROM sh a JOIN sh b ON b.doc_rank = a.doc_rank + {PLANTED}""",
    "shingles": f"WITH {_SHINGLES} SELECT doc_rank, unnest(s) AS shingle FROM sh",
    "shingles_by_char": f"""WITH {_SHINGLES}, c AS (SELECT doc_rank, replace(n, ' ', '') AS c FROM once)
        SELECT doc_rank, len(list_distinct(list_transform(range(1, greatest(length(c) - 4, 1) + 1), lambda i: substr(c, i, 5))))::BIGINT AS shingles FROM c""",
    "minhash_sig": f"WITH {_SIG} SELECT doc_rank, array_to_string(sig, ',') AS sig FROM sig",
    "estimated_jaccard": f"""WITH {_DOCS}, {shingles_sql("docs", every=True)}, {_SIGNING}
        SELECT a.doc_rank, round(len(list_filter(range(1, 257), lambda i: a.sig[i] = b.sig[i])) / 256.0::DOUBLE, 6) AS similarity FROM sig a JOIN sig b ON b.doc_rank = a.doc_rank + {PLANTED}""",
    "lsh_buckets": f"WITH {_BUCKETS} SELECT band, count(*) AS buckets, sum(n)::BIGINT AS members, max(n) AS largest FROM buckets GROUP BY band",
    "lsh_pairs": f"WITH {_PAIRS} SELECT a, b FROM pairs",
    "near_dup_edges": f"WITH {_EDGES} SELECT a, b, round(similarity, 6) AS similarity FROM edges",
    "near_dup_clusters": f"""WITH RECURSIVE {_EDGES}, {components_sql("edges", "c")}
        SELECT d.doc_id, coalesce(c.root, o.doc_rank) AS rep_id FROM docs d JOIN once o USING (n) LEFT JOIN c ON c.node = o.doc_rank""",
    "dedup_docs": f"""WITH RECURSIVE {_EDGES}, {components_sql("edges", "c")}
        SELECT d.doc_id FROM docs d JOIN once o USING (n) LEFT JOIN c ON c.node = o.doc_rank WHERE d.doc_id <> coalesce(c.root, o.doc_rank)""",
    "exact_near_dup": f"WITH {_EXACT} SELECT a, b, round(similarity, 6) AS similarity FROM exact",
    "dedup_pr": f"""WITH RECURSIVE {_EDGES}, {components_sql("edges", "c")}, {_EXACT[len(_SHINGLES) + 2 :]}, {components_sql("exact", "e")},
        g1 AS (SELECT node FROM c WHERE node <> root), i1 AS (SELECT node FROM e WHERE node <> root),
        n AS (SELECT (SELECT count(*) FROM g1) AS got, (SELECT count(*) FROM i1) AS ideal, (SELECT count(*) FROM g1 JOIN i1 USING (node)) AS common)
        SELECT got, ideal, common, round(common / greatest(got, 1)::DOUBLE, 6) AS precision, round(common / greatest(ideal, 1)::DOUBLE, 6) AS recall FROM n""",
    "lsh_curve": "SELECT k / 20.0::DOUBLE AS j, round(1 - pow(1 - pow(k / 20.0::DOUBLE, 8), 32), 6) AS p FROM range(0, 21) r(k)",
}
