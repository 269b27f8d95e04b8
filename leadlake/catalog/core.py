"""Registration of queries with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlake.catalog.fixtures import Fixtures, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(fx)`` under a name; ``oracle`` may use the view placeholders."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return register


def values(rows: list[str]) -> str:
    """A fixed word list as a SQL list body."""
    return ", ".join("'" + r.replace("'", "''") + "'" for r in rows)
