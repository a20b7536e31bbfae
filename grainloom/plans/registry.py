"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainloom.plans import decontam_queries, dedup_queries, filter_queries, pipeline_queries, source_queries

_MODULES = (filter_queries, dedup_queries, decontam_queries, pipeline_queries, source_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
