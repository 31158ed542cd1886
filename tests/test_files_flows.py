import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verigauge.functions import labels as N
from verigauge.operators import grids as G
from verigauge.operators import images as I
from verigauge.operators import jobs as JB
from verigauge.operators import labelling as LB
from verigauge.operators import metrics as M
from verigauge.operators import results as R
from verigauge.operators import scoring as SC
from verigauge.plans import flows
from verigauge.sinks import writers as W
from verigauge.sources import files as FS
from verigauge.sources import tables as TB
from verigauge.streaming import incremental as IN


class Bright(I.ImageScorer):
    name = "bright"
    display_name = "Brightness"

    def predict_images(self, images):
        return [float(im.mean()) / 255 for im in images]


def test_listing_and_scan(spark, picture_tree):
    files = FS.skipped_files(spark, picture_tree).first()
    assert (files.images, files.skipped) == (13, 1)
    items = FS.scan_items(spark, picture_tree).collect()
    assert {r.label for r in items} == {0, 1} and {r.label_mode for r in items} == {"subfolder"}
    one = next(r for r in items if r.rel_path == "real/camera1/r0.png")
    assert one.size_bytes > 0 and one.path == f"{picture_tree}/real/camera1/r0.png"
    strict = FS.scan_classes(spark, picture_tree).collect()
    assert {(r.label, r.grp) for r in strict} == {(0, "camera1"), (1, "gen1")}
    with pytest.raises(FileNotFoundError):
        FS.scan_classes(spark, f"{picture_tree}/real")
    assert LB.is_laid_out(FS.list_images(spark, picture_tree))


def test_pictures_are_decoded(spark, picture_tree):
    rows = {r.path.rsplit("/", 1)[1]: r for r in FS.read_pictures(spark, picture_tree).collect()}
    assert len(rows) == 13 and rows["broken.png"].error and rows["broken.png"].pixels is None
    img = np.frombuffer(rows["f0.png"].pixels, np.uint8).reshape(20, 24, 3)
    assert 150 < img.mean() < 210
    small = FS.read_pictures(spark, picture_tree, 12).where("error is null").first()
    assert (small.height, small.width) == (10, 12)


@pytest.mark.parametrize("name,text", [
    ("labels.csv", "﻿Filename,Label\na.jpg,real\nsub/b.jpg,1\n"),
    ("labels.json", json.dumps([{"file": "a.jpg", "is_ai": 0}, {"file": "sub/b.jpg", "is_ai": 1}])),
    ("manifest.json", json.dumps({"records": [{"path": "a.jpg", "y": "real"},
                                              {"path": "sub/b.jpg", "y": "fake"}]})),
    ("labels.json", json.dumps({"a.jpg": 0, "sub/b.jpg": "1"})),
])
def test_manifest_shapes(spark, tmp_path, name, text):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "sub" / "b.jpg").write_bytes(b"x")
    (tmp_path / name).write_text(text, encoding="utf-8")
    assert FS.find_manifest(spark, str(tmp_path)).endswith(name)
    got = {r.rel_path: r.label for r in FS.scan_items(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": 0, "sub/b.jpg": 1}


def test_csv_and_tsv_and_masks(spark, tmp_path):
    (tmp_path / "train.csv").write_text("file_name,label\nx.jpg,1\n")
    assert FS.read_labelled_csv(spark, str(tmp_path / "train.csv")).first().label == "1"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="file_name"):
        FS.read_labelled_csv(spark, str(tmp_path / "bad.csv"))
    for i in range(2):
        (tmp_path / f"photos.tsv00{i}").write_text(
            f"photo_id\tphoto_image_url\tai_description\n{i}\thttp://x/{i}\tA Cat\n")
    shards = FS.read_tsv_shards(spark, str(tmp_path))
    assert shards.count() == 2
    cols = N.text_columns(shards.columns)
    assert cols == ["ai_description"]
    assert shards.where(N.keyword_match(["cat"], *[F.col(c) for c in cols])).count() == 2
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        FS.read_tsv_shards(spark, str(tmp_path / "empty"))
    (tmp_path / "mask_fraction.json").write_text('{"a.jpg": 0.25, "b.jpg": 0.5}')
    masks = FS.read_masks(spark, str(tmp_path / "mask_fraction.json")).collect()
    assert {r.name: r.fraction for r in masks} == {"a.jpg": 0.25, "b.jpg": 0.5}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, b"m"), (2, -1, b"m")], "id int, label int, mask binary")
    df.write.parquet(str(tmp_path / "hub"))
    assert TB.read_feature_cache(spark, str(tmp_path / "hub")).count() == 1
    hub = TB.read_hub_rows(spark, str(tmp_path / "hub"), drop=["mask"])
    assert hub.columns == ["id", "label"]
    with pytest.raises(ValueError, match="Label_A"):
        TB.read_hub_rows(spark, str(tmp_path / "hub"), "Label_A")
    types, rows = TB.preview(hub, 1)
    assert types[0] == ("id", "int") and len(rows) == 1


def test_predictions_round_trip(spark, tmp_path):
    records = [{"image_path": "/data/s/real/a.jpg", "pred": 0.2, "prediction": "real"},
               {"image_path": "/data/s/ai/b.jpg", "pred": "oops", "prediction": None}]
    p = tmp_path / "predictions.json"
    p.write_text(json.dumps(records))
    got = {r.rel_path: r for r in FS.read_predictions(spark, str(p)).collect()}
    assert set(got) == {"real/a.jpg", "ai/b.jpg"}
    assert got["real/a.jpg"].label == 0 and got["ai/b.jpg"].score is None
    p.write_text(json.dumps([{"image_path": "x"}]))
    with pytest.raises(ValueError):
        FS.read_predictions(spark, str(p))


def test_score_folder_writes_and_reads_back(spark, picture_tree, tmp_path):
    out = str(tmp_path / "out")
    rows = flows.score_folder(spark, picture_tree, Bright(), out, 0.45, report=f"{out}/report")
    got = rows.collect()
    assert len(got) == 13
    bad = [r for r in got if r.score is None]
    assert len(bad) == 1 and bad[0].error
    m = M.metrics(rows, 0.45, score="score", truth="label").first()
    assert m.auc == 1.0 and m.n == 12
    back = FS.read_predictions(spark, f"{out}/predictions")
    assert back.count() == 13
    raw = "".join(open(os.path.join(out, "predictions", f)).read()
                  for f in os.listdir(os.path.join(out, "predictions")) if f.endswith(".json"))
    assert '"prediction":null' in raw
    report = spark.read.json(f"{out}/report").first()
    assert report.run.images_failed == 1 and report.metrics.auc == 1.0
    points = flows.calibrate(rows, 0.5)
    W.write_recommendations(points, f"{out}/points")
    assert spark.read.json(f"{out}/points").count() == 7
    W.write_csv(R.predictions_table(rows, 0.45, "path", "score", "label"), f"{out}/csv")
    assert spark.read.option("header", True).csv(f"{out}/csv").where("correct is null").count() == 1


def test_sweep_folder_and_report(spark, picture_tree, tmp_path):
    cells = flows.sweep_folder(spark, picture_tree, Bright(), G.official_grid(), 8,
                               threshold=0.45)
    W.write_json(R.sweep_report(cells), str(tmp_path / "report"))
    view = FS.read_sweep_report(spark, str(tmp_path / "report")).collect()
    assert len(view) == 14 and {r.baseline for r in view} == {1.0}
    assert FS.read_sweep_report(spark, str(tmp_path / "none.json")).count() == 0


def test_layout_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("/d/a.jpg", "train", 1, "g"), ("/d/b.jpg", "val", 0, None)],
                               "path string, split string, y int, grp string")
    for _ in range(2):
        W.write_layout(W.layout_rows(df, F.col("path")), str(tmp_path / "lay"))
    rows = spark.read.parquet(str(tmp_path / "lay")).collect()
    assert {r.target for r in rows} == {"train/fake/g/a.jpg", "val/real/real_root/b.jpg"}
    assert len(rows) == 2
    W.append_history(df.select("split"), str(tmp_path / "hist"))
    W.append_history(df.select("split"), str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 4


class Length(SC.Scorer):
    name = "length"

    def predict_batch(self, rows):
        return [min(1.0, len(t) / 10) for t in rows["text"]]


def test_incremental_scoring_adds_only_new_files(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id int, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def run():
        IN.score_new_files(spark, src, spark.createDataFrame([], schema).schema, Length(), ["id"],
                           sink, state).awaitTermination()
        return spark.read.parquet(sink)
    add([(1, "abc"), (2, "")])
    assert run().count() == 2
    assert run().count() == 2
    add([(3, "x" * 40)])
    rows = {r.id: r.score for r in run().collect()}
    assert rows == {1: 0.3, 2: 0.0, 3: 1.0}


def test_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    got = IN.checkpoint_folder(spark, "x", "/shared")
    assert got == f"{(named or '/shared').rstrip('/')}/x"
    if not named:
        with pytest.raises(ValueError):
            IN.checkpoint_folder(spark, "x")


def test_evaluate_tables(spark):
    from verigauge.plans import fixtures as X
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), f"g{i % 3}", float(rng.random())) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id bigint, y int, grp string, s double")
    out = flows.evaluate(X.condition_grid(items), 0.5, X.table_conditions(), 2.0, -1.0)
    assert {k: v.count() for k, v in out.items()} == {
        "conditions": 9, "families": 4, "drift": 9, "groups": 3, "calibration": 9}


def test_job_groups(spark):
    with JB.job_group(spark, "demo"):
        spark.range(1000).selectExpr("sum(id)").collect()
    done, total = JB.progress(spark, "demo")
    assert 0 < done <= total
    JB.cancel(spark, "demo")
    assert JB.progress(spark, "nothing") == (0, 0)
