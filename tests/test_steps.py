"""Sweeps in steps: progress, stops, and going on."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from verigauge.operators import jobs
from verigauge.operators.conditions import Condition, sweep_cells
from verigauge.operators.steps import sweep_in_steps

GRID = [Condition("clean", "clean", 0, "clean"), *[Condition("fade", "fade", k, f"f{k}") for k in range(1, 6)]]


@pytest.fixture
def items(spark):
    i = F.col("id")
    return spark.range(400).select(i.alias("item_id"), (i % 3 == 0).cast("int").alias("y"),
                                   F.when(i % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(101)) / 101 + 0.2 * (i % 3 == 0).cast("int")).alias("s"))


def faded(df, c):
    return df.withColumn("s", F.col("s") * (1 - c.severity / 10) + F.pmod(F.xxhash64("item_id", F.lit(c.severity)), F.lit(7)) / 50)


def as_rows(df):
    cols = sorted(df.columns)
    return [tuple(r[c] for c in cols) for r in df.orderBy("severity").collect()]


def whole(items, conditions):
    rows = [faded(items, c).withColumn("cell", F.lit(k)) for k, c in enumerate(conditions)]
    df = rows[0]
    for more in rows[1:]:
        df = df.unionByName(more)
    return as_rows(sweep_cells(df, 0.5, conditions))


def test_all_cells_with_progress(items, tmp_path):
    seen = []
    out = sweep_in_steps(items, GRID, faded, 0.5, str(tmp_path), seen.append)
    assert as_rows(out) == whole(items, GRID)
    assert [(d.cell, d.of, d.condition, d.rows, d.scored, d.again) for d in seen] == [(k, 6, c, 400, 392, False) for k, c in enumerate(GRID)]


def test_a_stop_keeps_finished_cells(items, tmp_path):
    seen, ran = [], []

    def score(df, c):
        ran.append(c.severity)
        return faded(df, c)

    out = sweep_in_steps(items, GRID, score, 0.5, str(tmp_path), seen.append, lambda: len(seen) == 3)
    assert out.count() == 3 and ran == [0, 1, 2]
    assert as_rows(out) == whole(items, GRID[:3])
    # another run goes on behind them
    ran.clear()
    out = sweep_in_steps(items, GRID, score, 0.5, str(tmp_path), seen.append)
    assert ran == [3, 4, 5] and [d.again for d in seen[3:]] == [True] * 3 + [False] * 3 and all(d.rows == 400 and d.scored == 392 for d in seen)
    assert as_rows(out) == whole(items, GRID)


def test_nothing_finished(items, tmp_path):
    assert sweep_in_steps(items, GRID, faded, 0.5, str(tmp_path), should_stop=lambda: True) is None


def test_a_cancelled_cell_is_not_there(spark, items, tmp_path):
    stopped = threading.Event()

    @F.udf("double")
    def slow(s):
        time.sleep(0.5)
        return s

    def score(df, c):
        if c.severity < 2:
            return faded(df, c)

        def end():
            time.sleep(3)
            stopped.set()
            jobs.cancel(spark, "mine")
        threading.Thread(target=end, daemon=True).start()
        return faded(df, c).withColumn("s", slow("s"))

    out = sweep_in_steps(items, GRID, score, 0.5, str(tmp_path), None, stopped.is_set, "mine")
    assert stopped.is_set() and as_rows(out) == whole(items, GRID[:2])
    # an error that nobody asked for is an error
    stopped.clear()
    with pytest.raises(Exception, match="broken"):
        sweep_in_steps(items, GRID, lambda df, c: df.withColumn("s", F.raise_error("broken").cast("double")), 0.5, str(tmp_path / "b"), None, stopped.is_set)


def test_cells_without_the_clean_one(items, tmp_path):
    out = sweep_in_steps(items, GRID[1:3], faded, 0.5, str(tmp_path)).collect()
    assert len(out) == 2 and all(r.delta_auc is None and r.auc is not None for r in out)
