"""Queries of decontamination and of repeated paragraphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import decontam as dc
from grainloom.operators import paragraphs as pg
from grainloom.plans.dedup_queries import NORM_SQL
from grainloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]


def clean_docs(s: SparkSession, d: str) -> DataFrame:
    """Each document of the cleaned corpus once."""
    return t(s, d, "clean", "doc_id", "subset", "text").groupBy("doc_id").agg(F.min("subset").alias("subset"), F.min("text").alias("text"))


def items(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "eval_sets", "item_id", "bench", "text")


def index(s: SparkSession, d: str) -> DataFrame:
    return dc.without_generic(dc.eval_index(items(s, d), False), t(s, d, "decontam_exclude"))


def _contaminated(s: SparkSession, d: str) -> DataFrame:
    return dc.contaminated(clean_docs(s, d), index(s, d), compatibility=False)


def _summary(s: SparkSession, d: str) -> DataFrame:
    found = _contaminated(s, d).join(clean_docs(s, d).select("doc_id", "subset"), "doc_id")
    return found.rollup("subset", "bench").agg(F.count("*").alias("docs"))


def _paras(s: SparkSession, d: str) -> DataFrame:
    docs = clean_docs(s, d).where("subset <> 'code'").withColumn("doc_rank", F.col("doc_id"))
    return pg.paragraphs(docs, compatibility=False)


def _stripped(s: SparkSession, d: str) -> DataFrame:
    docs = clean_docs(s, d).where("subset <> 'code'").withColumn("doc_rank", F.col("doc_id"))
    return pg.strip_paragraphs(docs, compatibility=False).select(F.col("doc_rank").alias("doc_id"), "text", "removed")


def windows_sql(source: str, name: str) -> str:
    """The thirteen-word windows of ``source(key, t)``: ``name(key, i, gram)``, places from 1."""
    return f"""{name}_u AS (SELECT key, regexp_extract_all({NORM_SQL.format("t")}, '{T.UNIT}') AS u FROM {source}),
    {name}_x AS (SELECT *, sum(h) OVER (PARTITION BY key ORDER BY i) AS cum FROM (
        SELECT key, i, CASE WHEN regexp_full_match(x, '{T.HAN}') THEN 1 ELSE 2 END AS h FROM (SELECT key, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {name}_u))),
    {name}_e AS (SELECT a.key, a.i, min(b.i) AS e FROM {name}_x a JOIN {name}_x b ON a.key = b.key AND b.i BETWEEN a.i + 12 AND a.i + 25
        WHERE b.cum - a.cum + a.h >= 26 GROUP BY ALL),
    {name} AS (SELECT key, i, array_to_string(u[i:e], ' ') AS gram FROM {name}_e JOIN {name}_u USING (key))"""


_ITEMS = f"""it AS (SELECT item_id AS key, text AS t FROM eval_sets WHERE text IS NOT NULL), {windows_sql("it", "iw")},
    full_index AS (SELECT gram, arg_min(bench, row(bench, item_id)) AS bench FROM iw JOIN eval_sets ON item_id = key GROUP BY gram),
    idx AS (SELECT * FROM full_index WHERE gram NOT IN (SELECT ngram FROM decontam_exclude WHERE ngram IS NOT NULL))"""
_CLEAN = "cd AS (SELECT doc_id, min(subset) AS subset, min(text) AS text FROM clean GROUP BY doc_id), ct AS (SELECT doc_id AS key, text AS t FROM cd WHERE text IS NOT NULL)"
_HITS = f"{_ITEMS}, {_CLEAN}, {windows_sql('ct', 'cw')}, hits AS (SELECT key AS doc_id, gram, bench, min(i) - 1 AS pos FROM cw JOIN idx USING (gram) GROUP BY ALL)"
_CONTAM = f"{_HITS}, contam AS (SELECT doc_id, arg_min(bench, pos) AS bench FROM hits GROUP BY doc_id)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+\\z', '', 'g')"


PARAS_SQL = f"""pd AS (SELECT doc_id AS doc_rank, string_split_regex(text, '\\n{{2,}}') AS p, regexp_extract_all(text, '\\n{{2,}}') AS s FROM cd WHERE subset <> 'code' AND text IS NOT NULL),
    pr AS (SELECT doc_rank, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS para, coalesce(s[generate_subscripts(p, 1)], '') AS sep FROM pd),
    paras AS (SELECT *, CASE WHEN length({strip_sql("para")}) >= 30 THEN md5({NORM_SQL.format("para")}) END AS key FROM pr),
    common AS (SELECT key, count(DISTINCT doc_rank) AS docs FROM paras WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_rank) >= 3)"""
STRIPPED_SQL = f"""{PARAS_SQL}, mark AS (SELECT p.*, c.key IS NOT NULL AND row_number() OVER (PARTITION BY p.key ORDER BY doc_rank, idx) > 1 AS gone FROM paras p LEFT JOIN common c USING (key)),
    stripped AS (SELECT doc_rank AS doc_id, regexp_replace(coalesce(string_agg(para || sep, '' ORDER BY idx) FILTER (NOT gone), ''), '^\\n+|\\n+\\z', '', 'g') AS text,
        count(*) FILTER (gone) AS removed FROM mark GROUP BY doc_rank)"""

QUERIES: dict[str, Query] = {
    "decontam_units": lambda s, d: items(s, d).where("text IS NOT NULL").select("item_id", F.array_join(T.units(T.normalize("text", False)), "|").alias("units")),
    "ngrams13": lambda s, d: items(s, d).where("text IS NOT NULL").select("item_id", F.posexplode(dc.grams("text", False)).alias("pos", "gram")),
    "eval_index": lambda s, d: dc.eval_index(items(s, d), False),
    "too_short_items": lambda s, d: dc.item_counts(items(s, d), False),
    "index_excluded": lambda s, d: index(s, d),
    "decontam_hits": lambda s, d: dc.hits(clean_docs(s, d), index(s, d), compatibility=False),
    "contaminated": _contaminated,
    "contaminated_nfkc": lambda s, d: dc.contaminated(clean_docs(s, d), dc.without_generic(dc.eval_index(items(s, d)), t(s, d, "decontam_exclude"))),
    "generic_ngrams": lambda s, d: dc.generic_grams(clean_docs(s, d), dc.eval_index(items(s, d), False), compatibility=False),
    "contam_summary": _summary,
    "paragraphs": lambda s, d: _paras(s, d).select("doc_rank", "idx", "para", "sep"),
    "para_keys": lambda s, d: _paras(s, d).where("key IS NOT NULL").select("doc_rank", "idx", "key"),
    "common_paras": lambda s, d: pg.common_paragraphs(_paras(s, d)),
    "strip_paras": _stripped,
    "para_short": lambda s, d: _stripped(s, d).where(F.length(T.strip("text")) < pg.LEAST_KEPT).select("doc_id"),
}

ORACLE: dict[str, str] = {
    "decontam_units": f"SELECT item_id, array_to_string(regexp_extract_all({NORM_SQL.format('text')}, '{T.UNIT}'), '|') AS units FROM eval_sets WHERE text IS NOT NULL",
    "ngrams13": f"WITH {_ITEMS} SELECT key AS item_id, i - 1 AS pos, gram FROM iw",
    "eval_index": f"WITH {_ITEMS} SELECT gram, bench FROM full_index",
    "too_short_items": f"""WITH w AS (SELECT bench, list_sum(list_transform(regexp_extract_all({NORM_SQL.format("coalesce(text, '')")}, '{T.UNIT}'),
        lambda x: CASE WHEN regexp_full_match(x, '{T.HAN}') THEN 0.5 ELSE 1 END)) AS w FROM eval_sets)
        SELECT bench, count(*) AS items, count(*) FILTER (coalesce(w, 0) < 13) AS too_short FROM w GROUP BY bench""",
    "index_excluded": f"WITH {_ITEMS} SELECT gram, bench FROM idx",
    "decontam_hits": f"WITH {_HITS} SELECT doc_id, gram, bench, pos FROM hits",
    "contaminated": f"WITH {_CONTAM} SELECT doc_id, bench FROM contam",
    "generic_ngrams": f"""WITH {_ITEMS}, {_CLEAN}, bt AS (SELECT row(doc_id, i) AS key, t FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n{{2,}}')) AS t,
        generate_subscripts(string_split_regex(text, '\\n{{2,}}'), 1) AS i FROM cd WHERE text IS NOT NULL)), {windows_sql("bt", "bw")},
        f AS (SELECT DISTINCT key, gram FROM bw) SELECT gram, bench, count(*) AS n FROM f JOIN full_index USING (gram) GROUP BY ALL HAVING count(*) >= 3""",
    "contam_summary": f"WITH {_CONTAM} SELECT subset, bench, count(*) AS docs FROM contam JOIN cd USING (doc_id) GROUP BY ROLLUP (subset, bench)",
    "paragraphs": f"WITH {_CLEAN}, {PARAS_SQL} SELECT doc_rank, idx, para, sep FROM paras",
    "para_keys": f"WITH {_CLEAN}, {PARAS_SQL} SELECT doc_rank, idx, key FROM paras WHERE key IS NOT NULL",
    "common_paras": f"WITH {_CLEAN}, {PARAS_SQL} SELECT key, docs FROM common",
    "strip_paras": f"WITH {_CLEAN}, {STRIPPED_SQL} SELECT doc_id, text, removed FROM stripped",
    "para_short": f"WITH {_CLEAN}, {STRIPPED_SQL} SELECT doc_id FROM stripped WHERE length({strip_sql('text')}) < 200",
}
