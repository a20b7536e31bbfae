"""Queries of the quality filters, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.functions import text as T
from grainloom.operators import filters as fl
from grainloom.sources.tables import read_table as t

Query = Callable[[SparkSession, str], DataFrame]

#: Subsets of each family of rules.
FAMILIES = {"english": ("en_web", "en_web_dclm"), "chinese": ("zh_web",), "code": ("code",), "math": ("math",), "en_wiki": ("en_wiki",), "zh_wiki": ("zh_wiki",)}


def clean_rows(spark: SparkSession, d: str, *subsets: str) -> DataFrame:
    df = t(spark, d, "clean", "doc_id", "subset", "text")
    return df.where(F.col("subset").isin(*subsets)) if subsets else df


# -- the same metrics in DuckDB's SQL -------------------------------------------------------------------------------

_W = f"list_filter(string_split_regex(t, '{T.SPACE}+'), lambda x: x <> '')"
_LINES = f"list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{T.SPACE}+', '', 'g') <> '')"
_STRIP = f"regexp_replace(t, '^{T.SPACE}+|{T.SPACE}+\\z', '', 'g')"


def _sum_len(xs: str) -> str:
    return f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"


def _times(needle: str) -> str:
    return f"((length(t) - length(replace(t, '{needle}', ''))) // {len(needle)})"


_BULLETS = ", ".join(f"'{b}'" for b in fl.BULLETS)
_STOPS = ", ".join(f"'{w}'" for w in fl.STOP_WORDS)

BASE_SQL = f"""
    base AS (SELECT doc_id, subset, coalesce(text, '') AS t FROM clean),
    parts AS (SELECT *, {_W} AS w, {_LINES} AS l, string_split(t, chr(10)) AS cl,
        list_filter(string_split_regex({_STRIP}, '\\n{{2,}}'), lambda x: x <> '') AS p,
        list_filter(string_split_regex(t, '\\n+'), lambda x: x <> '') AS r,
        regexp_replace(t, '{T.SPACE}+', '', 'g') AS solid_t FROM base),
    m AS (SELECT doc_id, subset, t,
        len(w)::BIGINT AS words,
        {_sum_len("w")} / nullif(len(w), 0)::DOUBLE AS mean_word_len,
        ({_times("#")} + {_times("...")} + {_times("…")}) / nullif(len(w), 0)::DOUBLE AS symbols,
        len(list_filter(l, lambda x: regexp_replace(x, '^{T.SPACE}+', '')[1] IN ({_BULLETS}))) / nullif(len(l), 0)::DOUBLE AS bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…){T.SPACE}*\\z'))) / nullif(len(l), 0)::DOUBLE AS ellipsis_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]'))) / nullif(len(w), 0)::DOUBLE AS alpha_words,
        len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{_STOPS}]))::BIGINT AS stop_words,
        (len(p) - len(list_distinct(p))) / nullif(len(p), 0)::DOUBLE AS dup_para_n,
        ({_sum_len("p")} - {_sum_len("list_distinct(p)")}) / nullif(length(t), 0)::DOUBLE AS dup_para_c,
        (len(r) - len(list_distinct(r))) / nullif(len(r), 0)::DOUBLE AS dup_line_n,
        ({_sum_len("r")} - {_sum_len("list_distinct(r)")}) / nullif(length(t), 0)::DOUBLE AS dup_line_c,
        length(solid_t)::BIGINT AS solid,
        length(regexp_replace(t, '[^{T.HAN_SET}]+', '', 'g')) / nullif(length(solid_t), 0)::DOUBLE AS zh_han,
        length(t)::BIGINT AS chars, length({_STRIP})::BIGINT AS stripped,
        list_max(list_transform(cl, lambda x: length(x)))::BIGINT AS code_longest,
        {_sum_len("cl")} / len(cl)::DOUBLE AS code_mean_line,
        length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) / nullif(length(t), 0)::DOUBLE AS code_alnum,
        regexp_matches(array_to_string(cl[1:5], chr(10)), '{fl.AUTOGENERATED}') AS code_autogen
      FROM parts)"""

_REPEAT_SQL = [("dup_para_n > 0.30", "dup_para_n"), ("dup_para_c > 0.20", "dup_para_c"), ("dup_line_n > 0.30", "dup_line_n"), ("dup_line_c > 0.20", "dup_line_c")]
_ENGLISH_SQL = [
    ("words < 50", "too_short_words"), ("words > 100000", "too_long_words"), ("mean_word_len < 3 OR mean_word_len > 10", "mean_word_len"), ("symbols > 0.1", "symbols"),
    ("bullets > 0.9", "bullets"), ("ellipsis_lines > 0.3", "ellipsis_lines"), ("alpha_words < 0.8", "alpha_words"), ("stop_words < 2", "stop_words"),
]
_CHINESE_SQL = [("solid < 100", "zh_short"), ("solid > 300000", "zh_long"), ("zh_han < 0.4", "zh_han"), ("ellipsis_lines > 0.3", "ellipsis_lines")]
_CODE_SQL = [("chars < 50", "code_short"), ("code_longest > 1000", "code_long_line"), ("code_mean_line > 100", "code_mean_line"), ("code_alnum < 0.25", "code_alnum"), ("code_autogen", "code_autogen")]


def _light_sql(least: int, by_count: bool = True) -> list[tuple[str, str]]:
    return [(f"stripped < {least}", "light_short"), ("stripped > 1000000", "light_long"), *(_REPEAT_SQL if by_count else _REPEAT_SQL[1::2])]


RULES_SQL = {
    "english": [*_ENGLISH_SQL, *_REPEAT_SQL],
    "chinese": [*_CHINESE_SQL, *_REPEAT_SQL],
    "code": _CODE_SQL,
    "math": _light_sql(100, by_count=False),
    "en_wiki": _light_sql(200),
    "zh_wiki": _light_sql(100),
}


def case_sql(chain: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for c, code in RULES_SQL[chain]) + " END"


def subset_case_sql() -> str:
    return "CASE subset " + " ".join(f"WHEN '{s}' THEN {case_sql(c)}" for s, c in fl.CHAINS.items()) + " END"


def _in(subsets: tuple[str, ...]) -> str:
    return ", ".join(f"'{s}'" for s in subsets)


# -- registration ---------------------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Of each rule's query: metric, condition in both dialects.
_RULES = {
    "f_too_short_words": ("words", "words < 50"),
    "f_too_long_words": ("words", "words > 100000"),
    "f_mean_word_len": ("mean_word_len", "mean_word_len < 3 OR mean_word_len > 10"),
    "f_symbols": ("symbols", "symbols > 0.1"),
    "f_bullets": ("bullets", "bullets > 0.9"),
    "f_ellipsis_lines": ("ellipsis_lines", "ellipsis_lines > 0.3"),
    "f_alpha_words": ("alpha_words", "alpha_words < 0.8"),
    "f_stop_words": ("stop_words", "stop_words < 2"),
    "f_dup_para_n": ("dup_para_n", "dup_para_n > 0.30"),
    "f_dup_para_c": ("dup_para_c", "dup_para_c > 0.20"),
    "f_dup_line_n": ("dup_line_n", "dup_line_n > 0.30"),
    "f_dup_line_c": ("dup_line_c", "dup_line_c > 0.20"),
    "f_zh_length": ("solid", "solid < 100 OR solid > 300000"),
    "f_zh_han": ("zh_han", "zh_han < 0.4"),
    "f_code_short": ("chars", "chars < 50"),
    "f_code_long_line": ("code_longest", "code_longest > 1000"),
    "f_code_mean_line": ("code_mean_line", "code_mean_line > 100"),
    "f_code_alnum": ("code_alnum", "code_alnum < 0.25"),
    "f_code_autogen": ("code_autogen", "code_autogen"),
}


def _rule_query(metric: str, condition: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = fl.prepare(clean_rows(spark, d)).withColumn(metric, fl.metrics()[metric])
        shown = F.round(F.col(metric).cast("double"), 6)
        return df.select("doc_id", shown.alias("value"), F.coalesce(F.expr(condition), F.lit(False)).alias("dropped"))

    return run


for _name, (_metric, _condition) in _RULES.items():
    QUERIES[_name] = _rule_query(_metric, _condition)
    _shown = f"CASE WHEN {_metric} THEN 1.0 ELSE 0.0 END" if _metric == "code_autogen" else f"round({_metric}::DOUBLE, 6)"
    ORACLE[_name] = f"WITH {BASE_SQL} SELECT doc_id, {_shown} AS value, coalesce({_condition}, false) AS dropped FROM m"


def _chain_query(chain: str) -> Query:
    return lambda s, d: fl.filter_chain(clean_rows(s, d, *FAMILIES[chain]), chain, grams=False).select("doc_id", "reason")


for _chain in FAMILIES:
    _name = f"filter_{_chain}_plain"
    QUERIES[_name] = _chain_query(_chain)
    ORACLE[_name] = f"WITH {BASE_SQL} SELECT doc_id, {case_sql(_chain)} AS reason FROM m WHERE subset IN ({_in(FAMILIES[_chain])})"

QUERIES |= {
    "filter_english": lambda s, d: fl.filter_chain(clean_rows(s, d, *FAMILIES["english"]), "english").select("doc_id", "reason"),
    "filter_chinese": lambda s, d: fl.filter_chain(clean_rows(s, d, *FAMILIES["chinese"]), "chinese").select("doc_id", "reason"),
    "apply_filters": lambda s, d: fl.apply_filters(clean_rows(s, d)).select("doc_id", "subset", "reason"),
    "apply_filters_plain": lambda s, d: fl.apply_filters(clean_rows(s, d), grams=False).select("doc_id", "subset", "reason"),
    "filter_funnel": lambda s, d: fl.filter_funnel(fl.apply_filters(clean_rows(s, d)), "subset"),
    "filter_funnel_plain": lambda s, d: fl.filter_funnel(fl.apply_filters(clean_rows(s, d), grams=False), "subset"),
    "top_reasons": lambda s, d: fl.top_reasons(fl.apply_filters(clean_rows(s, d))),
    "top_reasons_plain": lambda s, d: fl.top_reasons(fl.apply_filters(clean_rows(s, d), grams=False)),
    "filter_calib": lambda s, d: _calibration(fl.apply_filters(clean_rows(s, d))),
    "filter_calib_plain": lambda s, d: _calibration(fl.apply_filters(clean_rows(s, d), grams=False)),
}


def _calibration(filtered: DataFrame) -> DataFrame:
    """Share of each reason within its subset."""
    counts = fl.filter_funnel(filtered, "subset")
    totals = counts.groupBy("subset").agg(F.sum("docs").alias("all_docs"))
    return counts.join(totals, "subset").select("subset", "reason", "docs", F.round(F.col("docs") / F.col("all_docs"), 6).alias("share"))


_FILTERED = f"WITH {BASE_SQL}, f AS (SELECT doc_id, subset, {subset_case_sql()} AS reason FROM m)"
ORACLE |= {
    "apply_filters_plain": f"{_FILTERED} SELECT doc_id, subset, reason FROM f",
    "filter_funnel_plain": f"{_FILTERED} SELECT subset, coalesce(reason, 'kept') AS reason, count(*) AS docs FROM f GROUP BY ALL",
    "top_reasons_plain": f"""{_FILTERED}, c AS (SELECT subset, reason, count(*) AS docs FROM f WHERE reason IS NOT NULL GROUP BY ALL)
        SELECT subset, reason, docs, row_number() OVER (PARTITION BY subset ORDER BY docs DESC, reason) AS rank FROM c QUALIFY rank <= 6""",
    "filter_calib_plain": f"""{_FILTERED}, c AS (SELECT subset, coalesce(reason, 'kept') AS reason, count(*) AS docs FROM f GROUP BY ALL)
        SELECT subset, reason, docs, round(docs / sum(docs) OVER (PARTITION BY subset), 6) AS share FROM c""",
}


# n-gram rules over all rows: the most common gram is plain SQL, the jumping scan is tested against brute force
_ZH = [s for s, c in fl.CHAINS.items() if c == "chinese"]


def _gram_query(kind: str, sizes: dict[int, float]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        shares = clean_rows(spark, d).where("text IS NOT NULL").withColumn("g", fl.gram_shares("text", F.col("subset").isin(_ZH)))
        return shares.select("doc_id", *[F.round(F.coalesce(F.col(f"g.{kind}_{n}"), F.lit(0.0)), 6).alias(f"{kind}_{n}") for n in sizes])

    return run


def _top_grams_sql() -> str:
    parts = []
    for n in fl.TOP_GRAMS:
        parts.append(f"""g{n} AS (SELECT id, gram, count(*) AS c, min(i) AS first FROM (
            SELECT id, i, CASE WHEN k = 3 THEN array_to_string(w[i:i + {n} * k - 1], '') ELSE array_to_string(w[i:i + {n} * k - 1], ' ') END AS gram FROM (SELECT id, w, k, unnest(range(1, len(w) - {n} * k + 2)) AS i FROM d)) GROUP BY ALL),
          b{n} AS (SELECT id, arg_min(length(gram) * c, row(-c, first)) AS s FROM g{n} GROUP BY id)""")
    joins = " ".join(f"LEFT JOIN b{n} USING (id)" for n in fl.TOP_GRAMS)
    cols = ", ".join(f"round(coalesce(b{n}.s / nullif(length(t), 0)::DOUBLE, 0), 6) AS top_{n}" for n in fl.TOP_GRAMS)
    zh = f"subset IN ({_in(tuple(_ZH))})"
    chars = f"string_split(regexp_replace(text, '{T.SPACE}+', '', 'g'), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, text AS t, CASE WHEN {zh} THEN 3 ELSE 1 END AS k,
        CASE WHEN {zh} THEN list_filter({chars}, lambda x: x <> '') ELSE {_W.replace("(t,", "(text,")} END AS w FROM clean WHERE text IS NOT NULL), {", ".join(parts)}
        SELECT doc_id, {cols} FROM d {joins}"""


QUERIES["f_top_ngram_2_3_4"] = _gram_query("top", fl.TOP_GRAMS)
ORACLE["f_top_ngram_2_3_4"] = _top_grams_sql()
QUERIES["f_dup_ngram_5_10"] = _gram_query("dup", fl.DUP_GRAMS)
