"""Attach a one-row result to every row of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``row`` must be a global aggregate: exactly one row, so broadcasting it is safe."""
    one = F.lit(1)
    return (df.withColumn("_one", one)
            .join(F.broadcast(row.withColumn("_one", one)), "_one").drop("_one"))


def attach_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str],
                   how: str = "inner", few: bool = False) -> DataFrame:
    """Join a table with one row per key back on; NULL keys match each other.

    Without keys the right side is one row. ``few`` says that the keys are a
    closed list (classes, cells of a grid), so the right side can be broadcast and
    the left side is not shuffled. Otherwise the strategy is left to the optimizer,
    which also splits skewed keys.
    """
    keys = list(keys)
    if not keys:
        return attach_row(df, per_key)
    right = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in per_key.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(F.broadcast(right) if few else right, cond, how).drop(*[f"_k_{k}" for k in keys])
