"""Registry of named queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries; each has QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("plans.relational", "operators.rewrites", "operators.ordered", "functions.scalars", "operators.merge", "operators.search", "operators.postings", "operators.vectors", "operators.lists", "operators.late", "operators.fusion", "operators.graph", "operators.medallion", "operators.ingest", "operators.alike", "sources.readers", "plans.meetings", "plans.session_sql", "streaming.changes", "streaming.bounded", "sources.round_trips", "plans.assistants")


def _modules():
    return [importlib.import_module(f"lodestrata.{m}") for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rrf_hybrid"](spark, sf_dir)
