"""All registered queries, gathered from the per-topic modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TOPICS = [
    "scoring",
    "filters",
    "history",
    "imputation",
    "joins",
    "reports",
    "windows",
    "scalars",
    "evaluation",
    "health",
    "labelling",
    "sourcing",
    "structure",
    "training",
    "streams",
]


class Topic:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function
        return keep


def _topics() -> list[Topic]:
    return [importlib.import_module(f"deployrisk.plans.{name}").TOPIC for name in TOPICS]


def queries() -> dict[str, Query]:
    return {name: q for topic in _topics() for name, q in topic.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for topic in _topics() for name, q in topic.sql.items()}
