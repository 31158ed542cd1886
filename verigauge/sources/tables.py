"""Table-shaped sources: feature caches and hub-style rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def readable_features(df: DataFrame, label: str = "label") -> DataFrame:
    """Label -1 marks an item that could not be read; such rows are dropped."""
    return df.where(F.col(label) >= 0)


def read_feature_cache(spark: SparkSession, path: str) -> DataFrame:
    return readable_features(spark.read.parquet(path))


def read_hub_rows(spark: SparkSession, path: str, label: str = "label",
                  others: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """A local copy of a hub data set. Columns in ``drop`` are never read from disk."""
    df = spark.read.parquet(path)
    require_columns(df, [label, *others])
    return df.drop(*drop)


def preview(df: DataFrame, rows: int = 3) -> tuple[list[tuple[str, str]], list[dict]]:
    """Column names with types and the first few rows."""
    return df.dtypes, [r.asDict(recursive=True) for r in df.limit(rows).collect()]
