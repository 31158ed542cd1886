"""Incremental scoring: only items that have not been scored yet, safe to run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from verigauge.operators.scoring import Scorer, score


def scored_stream(items: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """The scorer over a streaming table; rows are independent, so no state is kept."""
    return score(items, scorer, keep)


def score_new_files(spark: SparkSession, source: str, schema: StructType | str, scorer: Scorer,
                    keep: Sequence[str], sink: str, checkpoint: str,
                    files_per_batch: int | None = None, file_format: str = "parquet"
                    ) -> StreamingQuery:
    """Score the files that have arrived since the last run and stop.

    The checkpoint, which belongs in shared storage, remembers what was handled, and
    the Parquet sink commits whole batches: a lost executor or a second run adds no
    duplicates.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = scored_stream(reader.load(source), scorer, keep)
    return (out.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", sink)
            .trigger(availableNow=True).start())


def unseen_items(items: DataFrame, key: str) -> DataFrame:
    """The first row of every id of a streaming table, in this run or any earlier one of the same checkpoint.

    The ids seen so far are keyed state, spread over the shuffle partitions and kept in the stream's checkpoint. It grows
    with the ids; set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider where they
    do not fit in memory. Of rows that share an id within a batch one stays. Rows without an id cannot be told
    apart by it: equal ones count as one item.
    """
    name = "_item_key"
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in items.columns]).cast("string")
    mine = F.when(F.col(key).isNull(), F.concat(F.lit("row "), everything)).otherwise(F.concat(F.lit("id "), F.col(key).cast("string")))
    return items.withColumn(name, mine).dropDuplicates([name]).drop(name)


def score_new_items(spark: SparkSession, source: str, schema: StructType | str, scorer: Scorer,
                    keep: Sequence[str], sink: str, checkpoint: str, key: str,
                    files_per_batch: int | None = None, file_format: str = "parquet") -> StreamingQuery:
    """Score the items that no earlier run has seen, whatever file they come in, and stop.

    Like :func:`score_new_files`, but an id that arrives again in another file does not reach the scorer. An item
    whose score failed counts as seen and keeps its error row. Ids and results are committed together, batch by batch: a run
    that breaks off repeats its last batch and adds nothing twice.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = scored_stream(unseen_items(reader.load(source), key), scorer, keep)
    return (out.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", sink)
            .trigger(availableNow=True).start())


def checkpoint_folder(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A folder for a stream's progress below the cluster's ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", fallback)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set and no folder was given")
    return f"{base.rstrip('/')}/{name}"
