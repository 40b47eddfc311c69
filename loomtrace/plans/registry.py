"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtrace.plans import events, graph, logs, problems, sources

_PARTS = [problems, logs, events, graph, sources]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _PARTS for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _PARTS for k, s in m.oracle_sql().items()}
