"""Watching and stopping a running evaluation through Spark's own job groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def job_group(spark: SparkSession, name: str, description: str = "") -> Iterator[str]:
    """Jobs started inside belong to the group and can be watched and stopped by its name."""
    sc = spark.sparkContext
    sc.setJobGroup(name, description or name, interruptOnCancel=True)
    try:
        yield name
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """Finished and known tasks of the group's jobs so far."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(name):
        info = tracker.getJobInfo(job)
        for stage in (info.stageIds if info else []):
            s = tracker.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total


def cancel(spark: SparkSession, name: str) -> None:
    """Stop the group's running jobs."""
    spark.sparkContext.cancelJobGroup(name)
