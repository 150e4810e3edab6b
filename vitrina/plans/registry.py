"""Where runnable queries and their equivalent SQL meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import ansi_ctes, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, uses: tuple[str, ...] = (), sql: str | None = None, more: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``key``.

    ``uses`` names the derived tables the SQL text needs; ``more`` adds its own leading common tables.
    """

    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            head = ansi_ctes(*uses) if uses else ""
            if more:
                head = f"{head},\n{more}" if head else f"with {more}"
            SQL[key] = f"{head}\n{sql}".strip()
        return fn

    return wrap
