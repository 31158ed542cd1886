"""All registered queries."""

from __future__ import annotations

from functools import wraps

from verigauge.plans import (  # noqa: F401
    file_queries, image_queries, label_queries, metric_queries, sampling_queries, stream_queries,
    sweep_queries, vector_queries)
from verigauge.plans.registry import REGISTRY, Query
from verigauge.session import ship_package


def _shipped(fn: Query) -> Query:
    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(fn) for name, fn in REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(REGISTRY.sql)
