"""The registered queries of the ten operators and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def keep(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql is not None:
            _SQL[run.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from sparkweave.llm import queries as registered  # noqa: F401  registers on import

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
