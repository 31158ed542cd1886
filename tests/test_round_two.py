"""Whole collections, failed values and files that are never opened."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verigauge.functions import kernels as K
from verigauge.functions import vectors as V
from verigauge.operators import audit as A
from verigauge.operators import grids as G
from verigauge.operators import heads as H
from verigauge.operators import images as I
from verigauge.operators import sampling as S
from verigauge.operators import training as TR
from verigauge.plans import flows
from verigauge.sinks import writers as W
from verigauge.sources import files as FS

NAN = float("nan")


def lambda_bodies(plan: str) -> list[str]:
    """The text of every lambda in a plan."""
    out, at = [], 0
    while (at := plan.find("lambdafunction(", at)) >= 0:
        depth, i = 0, at + len("lambdafunction(") - 1
        for k in range(i, len(plan)):
            depth += {"(": 1, ")": -1}.get(plan[k], 0)
            if depth == 0:
                out.append(plan[i:k])
                break
        at += 1
    return out


def test_no_fold_inside_a_lambda(spark):
    """A norm or maximum inside a lambda would be computed again for every element."""
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    out = df.select(V.l2_normalise(F.col("v")).alias("a"), V.positive_probability(F.col("v"), 1).alias("b"))
    row = out.first()
    assert row.a == pytest.approx([0.6, 0.8], abs=1e-6) and row.b == pytest.approx(1 / (1 + math.exp(-1)))
    bodies = lambda_bodies(out._jdf.queryExecution().optimizedPlan().toString())
    assert bodies and not any("aggregate(" in b or "array_max(" in b for b in bodies)


def test_member_logits(spark):
    rng = np.random.default_rng(1)
    heads = [H.Head(rng.normal(size=5).tolist(), 0.1 * k, rng.normal(size=5).tolist(), [0.5 + k] * 5, name=str(k)) for k in range(3)]
    x = rng.normal(size=(7, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, None), (8, [1.0])]
    df = spark.createDataFrame(rows, "item_id int, v array<double>")
    got = {r.item_id: r.p for r in H.ensemble_scores(df, "v", heads).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.mean([1 / (1 + np.exp(-(((unit - h.mu) / h.sd) @ h.weights + h.bias))) for h in heads], axis=0)
    assert [got[i] for i in range(7)] == pytest.approx(want.tolist(), abs=2e-6)
    assert got[7] is None and got[8] is None
    members = H.member_scores(df, "v", heads)
    assert members.count() == 27 and members.columns == ["item_id", "v", "member", "logit", "p"]


def test_failed_values_do_not_count(spark):
    views = spark.createDataFrame([(1, 0.5), (1, NAN), (1, None), (2, NAN)], "item_id int, p double")
    got = {r.item_id: (r.p, r.views) for r in H.pool_views(views, ["item_id"]).collect()}
    assert got == {1: (0.5, 1), 2: (None, 0)}
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.5).astype(int)
    s = rng.normal(y, 1.0)
    clean = [(float(a), int(b)) for a, b in zip(s, y)]
    df = spark.createDataFrame([*clean, (NAN, 1), (None, 0), (0.5, None)], "s double, y int")
    assert TR.fit_platt(df) == pytest.approx(TR.fit_platt(spark.createDataFrame(clean, "s double, y int")), abs=1e-6)
    rows = [(i, v, int(b), [float(a) * (1 + v), 1.0]) for i, (a, b) in enumerate(zip(s, y)) for v in range(2)]
    rows += [(900, 0, 1, [NAN, 1.0]), (901, 0, 0, None), (902, 0, None, [1.0, 1.0])]
    fit = TR.fit_head(spark.createDataFrame(rows, "item_id int, view_id int, y int, x array<double>"),
                      spark.createDataFrame(rows, "item_id int, view_id int, y int, x array<double>"), rounds=1, views=2)
    assert all(math.isfinite(w) for w in fit.weights)


def test_audits_keep_every_row(spark):
    df = spark.createDataFrame([(0.01, 0.9)] + [(0.3, 0.2)] * 6, "fraction double, s double")
    got = {r.bin: (r.n, r.thin) for r in A.recall_by_fraction(df, 0.5).collect()}
    assert got == {0: (1, True), 4: (6, False)}


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows_of_a_group(spark, n):
    rows = [(i % 2 if i < 4000 else None, (i * 7919) % 5003, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = S.top_per_group(df, ["k"], [F.col("v"), F.col("i")], n, rank="r").collect()
    for k in (0, 1, None):
        want = sorted((v, i) for g, v, i in rows if g == k)[:n]
        assert [(r.v, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r.r)] == want


def test_caps_leave_wide_rows_where_they_are(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0), f"g{i % 3}", "x" * 50) for i in range(600)],
                               "item_id int, y int, grp string, text string")
    capped = S.cap_groups(df, 5, ["item_id"])
    plan = capped._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "broadcast" in plan.lower()
    assert capped.where("y = 1").count() == 15 and capped.where("y = 0").count() == 15


def test_layout_names_do_not_collide(spark):
    df = spark.createDataFrame([("/a/x.jpg", "train", 1, "g"), ("/b/x.jpg", "train", 1, "g"), ("/b/x.jpg", "val", 1, "g")],
                               "path string, split string, y int, grp string")
    got = {(r.source, r.split): (r.target, r.same_name) for r in W.layout_rows(df, F.col("path")).collect()}
    assert got == {("/a/x.jpg", "train"): ("train/fake/g/x.jpg", 2), ("/b/x.jpg", "train"): ("train/fake/g/1_x.jpg", 2),
                   ("/b/x.jpg", "val"): ("val/fake/g/x.jpg", 1)}


class Bright(I.ImageScorer):
    name = "bright"

    def predict_images(self, images):
        return [float(im.mean()) / 255 for im in images]


def test_only_the_sample_is_opened(spark, picture_tree, monkeypatch):
    asked = []
    real = FS.read_pictures
    monkeypatch.setattr(FS, "read_pictures", lambda s, root, *a: asked.append(root) or real(s, root, *a))
    cells = flows.sweep_folder(spark, picture_tree, Bright(), [G.CLEAN], sample=4).collect()
    assert isinstance(asked[0], list) and len(asked[0]) == 4
    assert cells[0].n <= 4
    everything = flows.sweep_folder(spark, picture_tree, Bright(), [G.CLEAN]).collect()
    assert everything[0].n == 12
    # the broken picture is too small to be looked at
    few = flows.sweep_folder(spark, picture_tree, Bright(), [G.CLEAN], least_bytes=100)
    assert few.collect()[0].n == 12


def test_pixel_limit_is_an_option(spark, picture_tree):
    rows = FS.read_pictures(spark, picture_tree, most_pixels=100).collect()
    assert all(r.pixels is None and r.error for r in rows)
    assert sum(r.error is None for r in FS.read_pictures(spark, picture_tree).collect()) == 12


def test_views_that_do_not_exist():
    with pytest.raises(ValueError, match="4 views"):
        Bright().configure(tta_views=5).predict_with_views([np.zeros((4, 4, 3), np.uint8)])


def test_grid_keeps_the_size(spark):
    wide = np.zeros((2, 1000, 3), np.uint8)
    df = spark.createDataFrame([(1, 2, 1000, wide.tobytes())], "item_id int, height int, width int, pixels binary")

    class Width(I.ImageScorer):
        def predict_images(self, images):
            return [float(im.shape[1]) for im in images]
    assert I.score_grid(df, [G.CLEAN], Width()).first().s == 1000
    assert I.score_grid(df, [G.CLEAN], Width(), max_side=100).first().s == 100


def test_cells_without_an_encoder(monkeypatch):
    assert len(G.encodable(G.graded_grid())) == 46 and len(G.encodable(G.all_conditions())) == 27
    monkeypatch.setitem(K.KERNELS, "webp", lambda im, p, r: im)
    assert len(G.encodable(G.graded_grid())) == 51


def test_flat_manifest_stays_narrow(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    with open(path, "w") as f:
        json.dump({f"a/{i}.jpg": i % 2 for i in range(3000)}, f)
    rows = FS.read_manifest(spark, path)
    assert rows.columns == ["image_path", "label", "row_no"]
    assert rows.count() == 3000 and rows.where("label = '1'").count() == 1500
    for name, data in (("list", [{"path": "x", "label": 1}]), ("wrapped", {"items": [{"path": "x", "label": 1}]}),
                       ("single", {"path": "x", "label": 1})):
        p = str(tmp_path / f"{name}.json")
        with open(p, "w") as f:
            json.dump(data, f)
        r = FS.read_manifest(spark, p).first()
        assert (r.path, str(r.label)) == ("x", "1")


def test_broken_manifest_falls_through(spark, picture_tree):
    with open(f"{picture_tree}/labels.json", "w") as f:
        f.write("{broken")
    with open(f"{picture_tree}/manifest.csv", "w") as f:
        f.write("path,label\nreal/camera1/r0.png,1\n")
    got = {r.rel_path: r.label for r in FS.scan_items(spark, picture_tree, "manifest").collect()}
    assert got["real/camera1/r0.png"] == 1


def test_threshold_counts_reuse_the_score_counts(spark):
    from verigauge.operators import conditions as D
    from verigauge.operators import thresholds as T
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("view_id"),
                                  (F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("s"))
    for out in (T.fpr_at_tpr(df), D.view_metrics(df)):
        assert out.count() == 1
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        out._jdf.collectToPython()
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text or text.count("Range (") == 1, plan


def test_given_moments_are_one_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "item_id int, v array<double>")
    one = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "mu array<double>, sd array<double>")
    assert H.with_prepared(df, "v", one, l2=False).first().x == [3.0, 2.0]
    with pytest.raises(Exception, match="exactly one row"):
        H.with_prepared(df, "v", one.union(one), l2=False).collect()
