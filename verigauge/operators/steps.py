"""A sweep in steps: progress after every cell, and a stop that keeps what is finished.

:func:`verigauge.operators.images.image_sweep` runs a grid as one job, which is the fastest way but all or nothing. Here the
items are stored once (decoded pictures, say) and every cell is a job of its own over them, in one job group. Its
scores are written before the next cell begins, so a stop, between cells or inside one, loses the cell at work only, and
another run over the same folder goes on behind the finished ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verigauge.operators.conditions import Condition, sweep_cells
from verigauge.operators.jobs import job_group
from verigauge.operators.ranks import stored

SCORES = "y int, s double"


@dataclass(frozen=True)
class CellDone:
    """What a finished cell reports; the counts are observed while its scores are written."""

    cell: int
    of: int
    condition: Condition
    rows: int
    scored: int
    again: bool


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """The scores of a cell, if they have been written; a broken-off job leaves nothing that can be read."""
    try:
        if not spark.read.parquet(path).columns:
            return None
        return spark.read.schema(SCORES).parquet(path)
    except AnalysisException:
        return None


def sweep_in_steps(items: DataFrame, conditions: Sequence[Condition], score_cell: Callable[[DataFrame, Condition], DataFrame],
                   threshold: float, out: str, on_cell: Callable[[CellDone], None] | None = None,
                   should_stop: Callable[[], bool] | None = None, group: str = "sweep", store: bool = True) -> DataFrame | None:
    """Metric rows, with deltas against the clean cell, of the cells that were finished; none of them: no table.

    ``score_cell`` gives columns ``y`` and ``s`` of the items under a condition. ``on_cell`` is called after each cell and may raise
    to end the sweep; ``should_stop`` is asked before each cell and when one was cancelled by
    ``jobs.cancel(spark, group)``. Deltas are null until the clean cell is there. With ``store`` the items are computed once.
    """
    spark = items.sparkSession
    held: DataFrame | None = None
    done: list[tuple[Condition, DataFrame]] = []
    for i, condition in enumerate(conditions):
        path = f"{out.rstrip('/')}/cell={i}"
        scores, again, counts = finished(spark, path), True, {}
        if scores is None:
            if should_stop and should_stop():
                break
            if held is None:
                held = stored(items, "items") if store else items
            seen, again = Observation(f"{group}-{i}"), False
            try:
                with job_group(spark, group, f"{condition.key} {condition.severity}"):
                    (score_cell(held, condition).select(F.col("y").cast("int").alias("y"), F.col("s").cast("double").alias("s"))
                     .observe(seen, F.count(F.lit(1)).alias("rows"), F.count("s").alias("scored")).write.mode("overwrite").parquet(path))
            except Exception:
                if should_stop and should_stop():
                    break
                raise
            scores, counts = spark.read.schema(SCORES).parquet(path), seen.get
        done.append((condition, scores))
        if on_cell:
            if again:
                counts = scores.agg(F.count(F.lit(1)).alias("rows"), F.count("s").alias("scored")).first().asDict()
            on_cell(CellDone(i, len(conditions), condition, counts["rows"], counts["scored"], again))
    if not done:
        return None
    rows = reduce(DataFrame.unionByName, [s.withColumn("cell", F.lit(k)) for k, (_, s) in enumerate(done)])
    return sweep_cells(rows, threshold, [c for c, _ in done])
