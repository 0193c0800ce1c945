"""The registered queries of the graph operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sparkweave.model import Declared
from sparkweave.sources.tables import Source

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("structural", "travel", "loops", "derived", "searches", "cycles", "communities", "goals", "rounds", "sparser", "cuts")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``, with the SQL that gives the same rows."""

    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def declare(name: str, operator: Declared, source: Source, /, **values: object) -> None:
    """Register a declared operator over a derived graph; its SQL is the same plan over the graph's tables."""
    register(name, f"WITH {source.sql()} SELECT * FROM ({operator.sql(**values)}) AS result")(lambda spark, sf_dir: operator(source.graph(spark, sf_dir), **values))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _load() -> None:
    for module in MODULES:
        import_module(f"sparkweave.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
