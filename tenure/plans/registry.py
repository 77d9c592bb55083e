"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenure.plans import assessment, chunks, entities, findings, results, retrieval, text, timeline

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (timeline, text, entities, retrieval, chunks, assessment, findings, results)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
