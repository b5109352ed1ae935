"""Where queries start: tables by name, from a store, views or frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.plan_io import from_plan
from tessera.plans.query import Query
from tessera.plans.sql import parse

Provider = Callable[[str], DataFrame]


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | Provider | None = None):
        self.spark = spark
        self._tables = tables

    def table(self, name: str) -> DataFrame:
        if isinstance(self._tables, dict):
            return self._tables[name]
        return self._tables(name) if self._tables else self.spark.table(name)

    def scan_table(self, name: str) -> Query:
        return Query(lambda: self.table(name), name)

    def scan_schema(self, name: str) -> Query:
        return Query(lambda: self.table(name), name, is_schema=True)

    def sql(self, name: str, text: str) -> Query | str:
        """The query that text describes over a table; with EXPLAIN, its plan's text."""
        parsed = parse(text, lambda: self.table(name), name)
        return parsed.query.explain() if parsed.explain else parsed.query

    def plan(self, plan: dict) -> Query:
        return from_plan(plan, self.scan_table, self.scan_schema)
