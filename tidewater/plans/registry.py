"""The registered queries of the core: name, Spark query, SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of the named tables as a query over the whole of them."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*[table(spark, sf_dir, t) for t in tables])

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return add
