"""How a query and its oracle are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry.tables import Tables, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a function of Tables; ``sql`` may use the derived tables named in ``uses``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            body = sql.strip()
            head = duckdb_with(*uses.split())
            if head and body[:4].lower() == "with" and body[4].isspace():
                body = "," + body[4:]
                head = head.rstrip() + "\n"
            ORACLES[name] = head + body
        return build

    return wrap
