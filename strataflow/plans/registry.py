"""All queries of the library's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from strataflow.plans import alert_rules, files, gathers, headers, images, job_history, more, series, signal, stacks, transfers, velocities, whole_volumes

_MODULES = (stacks, headers, gathers, series, signal, job_history, files, more, whole_volumes, transfers, images, velocities, alert_rules)


def _entries() -> Iterator[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]]:
    for m in _MODULES:
        for name, (query, sql) in m.QUERIES.items():
            yield name, query, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}
