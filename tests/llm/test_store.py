"""Files and tables in the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verigauge.llm import store


def test_files_come_whole_and_twice(tmp_path):
    uri = f"file://{tmp_path}/a/b.bin"

    def broken():
        yield b"half"
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        store.put(uri, broken())
    assert not (tmp_path / "a" / "b.bin").exists()
    for _ in range(2):
        store.put(uri, [b"\x01\x00", b"\x02\x00"])
    assert store.mapped(uri, "<u2").tolist() == [1, 2]
    store.put(uri, [])
    assert len(store.mapped(uri, "<u2")) == 0
    assert isinstance(store.mapped(uri, "<u2"), np.ndarray)


def test_tables_cut_the_lineage(spark):
    df = store.kept(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert store.kept(df.limit(0)).count() == 0
    assert store.fresh(spark, "a") != store.fresh(spark, "a")


def test_unused_names(spark):
    df = spark.range(1).select(F.col("id").alias("Node"), F.lit(1).alias("row"))
    assert store.unused(df, "node", "row", "other") == ["node_", "row_", "other"]
