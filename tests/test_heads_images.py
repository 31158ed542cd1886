import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verigauge.functions import kernels as K
from verigauge.functions import vectors as V
from verigauge.operators import grids as G
from verigauge.operators import heads as H
from verigauge.operators import images as I
from verigauge.operators import scoring as SC
from verigauge.operators import training as TR


def vectors(spark, n=200, d=6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, d)) + 0.8 * y[:, None]
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "item_id int, y int, v array<double>"), x, y


def test_moments_and_preparation(spark):
    df, x, _ = vectors(spark)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    m = H.feature_moments(df, "v").first()
    assert np.allclose(m.mu, unit.mean(0)) and np.allclose(m.sd, unit.std(0) + 1e-6)
    rows = H.with_prepared(df, "v").orderBy("item_id").collect()
    assert np.allclose([r.x for r in rows], (unit - unit.mean(0)) / (unit.std(0) + 1e-6))


def head(d=6, **kw):
    base = dict(weights=[0.5, -1, 0.3, 0.2, 0.1, 1][:d], bias=0.2, mu=[0.01 * i for i in range(d)],
                sd=[1 + 0.1 * i for i in range(d)], platt_a=1.3, platt_b=-0.2, threshold=0.4)
    return H.Head(**{**base, **kw})


def test_linear_and_mlp_heads_agree_with_numpy(spark):
    df, x, _ = vectors(spark)
    h = head()
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    z = (unit - h.mu) / np.array(h.sd)
    got = [r.q for r in df.select("item_id", H.head_logit(F.col("v"), h).alias("q"))
           .orderBy("item_id").collect()]
    assert np.allclose(got, z @ h.weights + h.bias)
    layer = H.Layer(np.eye(6).tolist(), [0.1] * 6, [0.0] * 6, [1.0] * 6, [1.0] * 6, [0.0] * 6)
    deep = head(hidden=(layer,))
    want = np.maximum((z + 0.1) / math.sqrt(1 + 1e-5), 0) @ h.weights + h.bias
    got = df.select("item_id", H.head_logit(F.col("v"), deep).alias("q")).orderBy("item_id")
    assert np.allclose([r.q for r in got.collect()], want)
    odd = spark.createDataFrame([([1.0],), (None,), ([0.0] * 6,)], "v array<double>")
    got = [r.q for r in odd.select(H.head_logit(F.col("v"), deep).alias("q")).collect()]
    assert got[0] is None and got[1] is None and got[2] is not None


def test_ensemble_members(spark):
    df, _, _ = vectors(spark, 20)
    heads = [head(name="a"), head(name="b", bias=-1.0), head(name="c", l2=False)]
    assert [h.name for h in H.compatible(heads)] == ["a", "b"]
    with pytest.raises(ValueError):
        H.compatible([])
    rows = H.ensemble_scores(df, "v", heads).collect()
    each = H.member_scores(df, "v", heads).groupBy("item_id").agg(F.avg("p").alias("p"))
    want = {r.item_id: r.p for r in each.collect()}
    assert all(r.p == pytest.approx(want[r.item_id], abs=1e-6) for r in rows)
    assert H.ensemble_threshold(heads) == pytest.approx(head().operating_point)


def test_class_outputs(spark):
    df = spark.createDataFrame([([2.0],), ([1.0, 3.0, 800.0],)], "o array<double>")
    got = [r.p for r in df.select(V.positive_probability(F.col("o"), 1).alias("p")).collect()]
    assert got[0] == pytest.approx(1 / (1 + math.exp(-2))) and got[1] == pytest.approx(0.0)


def test_health_and_collapse(spark):
    rows = [(i, [1.0, float(i % 3), float("nan") if i == 0 else 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "item_id int, v array<double>")
    dims = {r.dim: r for r in H.dimension_health(df, "v").collect()}
    assert dims[0].constant and not dims[1].constant and dims[2].n_nan == 1
    same = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(10)],
                                 "item_id int, v array<double>")
    assert H.collapse_check(same, "v", "item_id").first().verdict == "collapsed"
    spread, _, _ = vectors(spark, 50)
    assert H.collapse_check(spread, "v", "item_id").first().verdict == "distinct"
    copies = spark.createDataFrame([(i, [1.0]) for i in range(6)] + [(9, [2.0])],
                                   "item_id int, v array<double>")
    assert H.exact_copies(copies, "v", "item_id").first().pairs == 15


def test_head_fit_learns_and_platt_has_positive_slope(spark):
    df, _, _ = vectors(spark, 300)
    rows = H.with_prepared(H.scaled_views(df, "v", (1.0, 0.7, 1.4)), "v", l2=False)
    fit = TR.fit_head(rows.where("item_id % 3 > 0"), rows.where("item_id % 3 = 0"), rounds=2,
                      views=3, iterations=20)
    assert len(fit.history) == 2 and fit.history[fit.best_round]["auc_worst"] > 0.8
    assert fit.best_round == max(range(2), key=lambda r: fit.history[r]["auc_worst"])
    scored = df.select("y", V.dot(F.col("v"), V.literal(fit.weights)).alias("s"))
    a, _ = TR.fit_platt(scored)
    assert a > 0
    assert TR.history_rows(spark, fit).count() == 2


class Broken(SC.Scorer):
    name = "broken"
    batch_size = 5

    def __init__(self, how):
        self.how = how

    def predict_batch(self, rows):
        if self.how == "raise" and (rows["item_id"] == 7).any():
            raise RuntimeError("seven")
        if self.how == "short":
            return [0.5]
        return [0.25] * len(rows)


def test_scoring_failures(spark):
    df = spark.range(40).select(F.col("id").alias("item_id")).coalesce(1)
    rows = SC.score(df, Broken("raise"), ["item_id"]).collect()
    bad = [r for r in rows if r.score is None]
    assert len(rows) == 40 and {r.item_id for r in bad} == {5, 6, 7, 8, 9}
    assert all("seven" in r.error for r in bad)
    assert all(r.score is None and "1 scores" in r.error
               for r in SC.score(df, Broken("short"), ["item_id"]).collect())
    assert SC.score(df, Broken("ok"), ["item_id"]).where("score = 0.25").count() == 40


def test_scorer_registry():
    class First(SC.Scorer):
        name, display_name = "zz_demo", "B"

    class Second(SC.Scorer):
        name, display_name = "zz_demo", "A"
    SC.register(First)
    SC.register(Second)
    assert isinstance(SC.get_scorer("zz_demo"), Second)
    assert Second in SC.available() and First not in SC.available()
    with pytest.raises(KeyError, match="zz_demo"):
        SC.get_scorer("nobody")
    with pytest.raises(ValueError):
        Second().configure(tta_views=2)


@pytest.fixture(scope="module")
def noisy():
    return np.random.default_rng(0).integers(0, 256, (30, 40, 3)).astype(np.uint8)


def test_kernel_properties(noisy):
    flat = np.full((16, 24, 3), 90, np.uint8)
    assert K.blur(noisy, 2.0).std() < K.blur(noisy, 0.5).std() < noisy.std()
    assert abs(K.blur(noisy, 1.0).mean() - noisy.mean()) < 2
    assert (K.blur(flat, 2.0) == 90).all() and (K.rescale(flat, 0.5) == 90).all()
    assert K.rescale(noisy, 0.25).shape == noisy.shape
    assert K.centre_crop(noisy, 0.5).shape == (15, 20, 3)
    assert K.shrink(noisy, 0.5).shape == (15, 20, 3)
    assert K.cap_side(noisy, 20).shape == (15, 20, 3) and K.cap_side(noisy, 99) is noisy
    assert (K.flip(K.flip(noisy)) == noisy).all()
    assert np.abs(K.jpeg(flat, 90).astype(int) - 90).max() <= 2
    err = [np.abs(K.jpeg(noisy, q).astype(int) - noisy).mean() for q in (95, 60, 20)]
    assert err[0] < err[1] < err[2]
    assert (K.brightness(noisy, 1.0) == noisy).all() and K.brightness(noisy, 0.0).max() == 0
    assert K.contrast(noisy, 0.0).std() == 0
    g = K.saturation(noisy, 0.0)
    assert (g[..., 0] == g[..., 1]).all()
    assert K.sharpness(noisy, 1.5).shape == noisy.shape
    assert (K.noise(noisy, 0.0, None) == noisy).all()
    small, big = (np.abs(K.noise(flat, s, np.random.default_rng(1)).astype(int) - 90).mean()
                  for s in (2, 20))
    assert 0 < small < big
    for mode in ("resize", "nativecrop", "square"):
        assert K.tower_input(noisy, mode, np.random.default_rng(0)).shape == (3, 224, 224)
    mask = np.zeros((10, 10), np.uint8)
    mask[:5] = 255
    assert K.mask_fraction(mask) == 0.5


def test_every_condition_gives_an_rgb_image(noisy):
    rng = np.random.default_rng(0)
    for c in G.all_conditions() + G.graded_grid() + G.official_grid():
        if "webp" in c.key:
            with pytest.raises(K.NoCodec):
                K.apply_chain(noisy, c.chain, rng)
            continue
        out = K.apply_chain(noisy, c.chain, rng)
        assert out.dtype == np.uint8 and out.ndim == 3 and out.shape[2] == 3


class Mean(I.ImageScorer):
    name = "mean"
    batch_size = 4

    def predict_images(self, images):
        return [float(im.mean()) / 255 for im in images]


def pictures(spark, n=12):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        img = np.clip(rng.normal(80 + 60 * (i % 2), 10, (10, 14, 3)), 0, 255).astype(np.uint8)
        rows.append((i, i % 2, 10, 14, img.tobytes()))
    rows.append((99, 1, 10, 14, b"short"))
    return spark.createDataFrame(
        rows, "item_id int, y int, height int, width int, pixels binary")


def test_image_sweep(spark):
    grid = G.all_conditions()
    cells = {r.key: r for r in I.image_sweep(pictures(spark), grid, Mean(), 0.42).collect()}
    assert len(cells) == 28
    assert cells["clean"].n == 12 and cells["clean"].auc == 1.0
    assert cells["webp_q50"].n == 0 and cells["webp_q50"].auc is None
    assert cells["color_down"].delta_accuracy <= 0
    rows = I.score_grid(pictures(spark), grid[:2], Mean()).where("item_id = 99").collect()
    assert all(r.s is None and r.error for r in rows) and len(rows) == 2


def test_noise_depends_on_item_not_on_order(spark):
    grid = [c for c in G.evaluation_grid() if c.family in ("clean", "noise")]
    one = {(r.item_id, r.cell): r.s for r in I.score_grid(pictures(spark), grid, Mean()).collect()}
    two = {(r.item_id, r.cell): r.s for r in I.score_grid(
        pictures(spark).orderBy(F.col("item_id").desc()), grid, Mean(), spread=3).collect()}
    assert one == two


def test_view_averaging():
    img = np.zeros((10, 10, 3), np.uint8)
    img[:, :5] = 200

    class Left(Mean):
        def predict_images(self, images):
            return [float(im[:, : im.shape[1] // 2].mean()) / 255 for im in images]
    s = Left()
    assert s.predict_with_views([img])[0] == pytest.approx(200 / 255, abs=1e-6)
    assert s.configure(tta_views=2).predict_with_views([img])[0] == pytest.approx(100 / 255, abs=1e-6)


def test_random_views(spark):
    df = spark.range(400).select(F.col("id").alias("item_id"))
    rows = I.random_views(df, 4, seed=5).collect()
    assert len(rows) == 1600 and all(not r.steps for r in rows if r.view_id == 0)
    rest = [r.steps for r in rows if r.view_id > 0]
    clean = sum(not s for s in rest) / len(rest)
    assert 0.10 < clean < 0.20
    for s in rest:
        ops = {k.split("_")[0] for k in s}
        assert len(ops) <= 3
        for k, v in s.items():
            lo, hi = I.TRAIN_RANGES[k.split("_")[0]]
            assert lo <= v <= hi
        assert ("color_b" in s) == ("color_s" in s)
    again = {(r.item_id, r.view_id): r.steps for r in I.random_views(df, 4, seed=5).collect()}
    assert all(again[(r.item_id, r.view_id)] == r.steps for r in rows)
    chain = I.chain_of({"jpeg": 50.0, "crop": 0.8, "color_b": 1.0, "color_c": 1.0, "color_s": 1.1})
    assert [k for k, _ in chain] == ["crop_rounded", "colour", "jpeg"]


def test_geometry_and_masks(spark):
    g = I.geometry_columns(pictures(spark).where("item_id < 99"), lo=6, hi=9)
    rows = I.cropped(g).collect()
    assert all(r.height == r.width and 6 <= r.height <= 9 for r in rows)
    mask = np.full((10, 14), 255, np.uint8).tobytes()
    full = I.edited_fraction(g.withColumn("mask", F.lit(bytearray(mask))))
    assert {r.fraction for r in full.collect()} == {1.0}


def test_view_features(spark):
    views = I.random_views(pictures(spark), 2)
    rows = I.view_features(views, lambda t: t.mean(axis=(1, 2)), side=8).collect()
    assert len(rows) == 26
    assert all((r.feature is None) == (r.item_id == 99) for r in rows)
    px = I.transform_pixels(pictures(spark), G.official_grid()[:2]).where("item_id = 0").collect()
    assert {(r.key, r.height) for r in px} == {("clean", 10), ("off_jpeg", 10)}


def test_checked_scores_accepts_nan():
    class Half(SC.Scorer):
        def predict_batch(self, rows):
            return [float("nan"), 0.5]
    got, why = SC.checked_scores(Half(), pd.DataFrame({"a": [1, 2]}))
    assert why is None and math.isnan(got[0]) and got[1] == 0.5
