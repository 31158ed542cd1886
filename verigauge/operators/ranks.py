"""Positions within groups without a window over a whole group.

A ``row_number`` over a group is one task per group. Here rows are dealt by range of (group, order), so a
hot group spans many partitions; rows are counted per partition and group, the counts before a
partition come back as offsets, and a row's number is its place in the partition plus the offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.session import shared_folder

#: monotonically_increasing_id keeps the row's place in its partition in the low bits.
_ROW_BITS = (1 << 33) - 1


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows as a table in the shared folder, so that a lost executor repeats no earlier step."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], position: str = "position",
           size: str = "size") -> DataFrame:
    """All columns, the 0-based ``position`` of each row in its group and the ``size`` of the group.

    Nulls of a group column are one group; nulls of an order column come first unless the caller's expression
    says otherwise. Rows that tie get successive positions in no particular order: give an order that
    tells different rows apart. No group is gathered in one task, not even one of equal rows: the number of the
    reading task is the last key of the range. ``df`` is computed twice (ranges are sampled first), so
    store it beforehand where it is dear. The names ``_dealt_*`` are used in between.
    """
    keys = [F.col(f"`{g}`") for g in group]
    by = [k.asc_nulls_first() for k in keys] + [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    by.append(F.col("_dealt_from").asc())
    placed = stored(
        df.withColumn("_dealt_from", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by)
        .drop("_dealt_from").withColumns({
            "_dealt_part": F.spark_partition_id(),
            "_dealt_row": F.monotonically_increasing_id().bitwiseAND(_ROW_BITS)}), "ranked")
    counts = placed.groupBy(*keys, "_dealt_part").agg(F.count(F.lit(1)).alias("_dealt_n"), F.min("_dealt_row").alias("_dealt_first"))
    every = Window.partitionBy(*keys)
    offsets = counts.select(
        *[k.alias(f"_dealt_k{i}") for i, k in enumerate(keys)], F.col("_dealt_part").alias("_dealt_at"),
        (F.sum("_dealt_n").over(every.orderBy("_dealt_part")) - F.col("_dealt_n") - F.col("_dealt_first")).alias("_dealt_shift"),
        F.sum("_dealt_n").over(every).alias(size))
    found = reduce(lambda x, y: x & y, [k.eqNullSafe(F.col(f"_dealt_k{i}")) for i, k in enumerate(keys)],
                   F.col("_dealt_part") == F.col("_dealt_at"))
    return placed.join(offsets, found).select(
        *[f"`{c}`" for c in df.columns], (F.col("_dealt_row") + F.col("_dealt_shift")).alias(position), size)
