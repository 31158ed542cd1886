"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        if name in self.queries:
            raise ValueError(f"query {name!r} is registered twice")

        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


REGISTRY = Registry()
query = REGISTRY.add


def r6(df: DataFrame, *skip: str) -> DataFrame:
    """Round every double column to 6 places, as the SQL twins do."""
    def one(name: str, kind: str) -> Column:
        return F.round(F.col(name), 6).alias(name) if kind == "double" and name not in skip \
            else F.col(name)
    return df.select(*[one(n, k) for n, k in df.dtypes])
