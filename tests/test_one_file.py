"""One file from many tasks."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from verigauge.sinks import one_file as O
from verigauge.sinks import writers as W
from verigauge.sources import files as FS


def rows(spark, n, parts):
    i = F.col("id")
    return spark.range(0, n, 1, parts).select(
        F.concat(F.lit("/r/real/"), i, F.lit('é",\n.jpg')).alias("image_path"),
        F.when(i % 5 > 0, i / n).alias("pred"), F.when(i % 5 > 0, "real").alias("prediction"), F.struct(i.alias("k")).alias("more"))


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 4), (1000, 7), (3, 8)])
def test_one_list_in_order(spark, tmp_path, n, parts):
    path = str(tmp_path / "p.json")
    df = rows(spark, n, parts)
    W.write_json(df, path)
    W.write_json(df, path)  # again: the same file
    assert os.listdir(tmp_path) == ["p.json"]
    with open(path) as f:
        got = json.load(f)
    assert [g["image_path"] for g in got] == [f'/r/real/{i}é",\n.jpg' for i in range(n)]
    assert all(("pred" in g) and (g["pred"] is None) == (k % 5 == 0) for k, g in enumerate(got))
    if n:
        back = {r.path: r.score for r in FS.read_predictions(spark, path).collect()}
        assert back == {g["image_path"]: g["pred"] for g in got}


def test_one_csv(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    df = rows(spark, 50, 3).select("image_path", "pred", F.lit("").alias("empty"), F.lit(None).cast("string").alias("none"))
    W.write_csv(df, path)
    with open(path, newline="") as f:
        got = list(csv.DictReader(f))
    assert len(got) == 50 and list(got[0]) == ["image_path", "pred", "empty", "none"]
    assert got[7]["image_path"] == '/r/real/7é",\n.jpg' and float(got[7]["pred"]) == 0.14 and got[5]["pred"] == "" and got[5]["none"] == ""


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "p.json")
    good = rows(spark, 100, 4)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error("no")).otherwise("x").cast("string").alias("value"))
    with pytest.raises(Exception, match="no"):
        O.write_lines(bad, path)
    assert os.listdir(tmp_path) == []
    W.write_json(good, path)
    with open(path) as f:
        before = f.read()
    with pytest.raises(Exception, match="no"):
        O.write_lines(bad, path)
    with open(path) as f:
        assert f.read() == before
    assert os.listdir(tmp_path) == ["p.json"]


def test_parts_are_checked(tmp_path):
    writer = O.OneFileWriter(str(tmp_path / "x"), "", "", "")
    (tmp_path / "part").write_bytes(b"abc")
    with pytest.raises(OSError, match="instead of"):
        writer.commit([O.Part(0, str(tmp_path / "part"), 1, 5)])
    writer.abort([])
    assert sorted(os.listdir(tmp_path)) == ["part"]


def test_folders_stay_folders(spark, tmp_path):
    W.write_json(rows(spark, 10, 2), str(tmp_path / "lines"))
    assert os.path.isdir(tmp_path / "lines") and spark.read.json(str(tmp_path / "lines")).count() == 10
