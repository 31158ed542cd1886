"""The ladder and everything folded from it, against plain NumPy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verigauge.functions.numeric import grid_bin, next_above, ordinal_sql
from verigauge.operators import calibration as C
from verigauge.operators import ladder as L
from verigauge.operators import metrics as M
from verigauge.operators import thresholds as T

SCHEMA = "k string, y int, s double"


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum())
                 / (len(pos) * len(neg)))


def brute_ap(y, s):
    if y.min() == y.max():
        return None
    ap, prev = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        hit = s >= t
        r = (hit & (y == 1)).sum() / (y == 1).sum()
        ap += (r - prev) * (hit & (y == 1)).sum() / hit.sum()
        prev = r
    return ap


def frame(spark, y, s, k=None):
    rows = [(None if k is None else k[i], int(y[i]), float(s[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, SCHEMA)


def crowded(rng, n):
    """Scores that crowd into single buckets and parts, next to spread ones and ties."""
    tight = 0.75 + rng.integers(0, n, n) * 2.0 ** -52        # neighbouring doubles
    near = 0.9999 + rng.random(n) * 1e-9
    wide = rng.normal(0, 1e3, n)
    ties = rng.integers(-2, 3, n) / 2.0
    return np.concatenate([tight, near, wide, ties])


def test_ordinal_is_monotone_and_next_above_is_exact(spark):
    vals = [0.0, 5e-324, 1e-310, 1e-300, 0.1, 0.125, math.nextafter(0.125, 0), 8.0,
            math.nextafter(8, 0), math.nextafter(8, 9), 1.0, math.nextafter(1, 0), 1e308, 3.0,
            -0.5, -1e-9, -8.0, -5e-324]
    rows = spark.createDataFrame([(v,) for v in vals], "v double").select(
        "v", F.expr(ordinal_sql("v")).alias("o"), next_above(F.col("v")).alias("n")).orderBy(
        "v").collect()
    assert [r.o for r in rows] == sorted(r.o for r in rows)
    assert all(r.n == math.nextafter(r.v, math.inf) for r in rows)


def test_ladder_matches_cumulative_counts(spark):
    rng = np.random.default_rng(0)
    s = crowded(rng, 300)
    y = rng.integers(0, 2, len(s))
    k = np.where(rng.random(len(s)) < 0.4, "a", None)
    got = L.score_ladder(frame(spark, y, s, k), ["k"], below=True).collect()
    for key in ("a", None):
        m = np.array([x == key for x in k])
        want = []
        for t in np.unique(s[m])[::-1]:
            want.append((t, int((m & (s >= t) & (y == 1)).sum()),
                         int((m & (s >= t) & (y == 0)).sum())))
        mine = sorted(((r.score, r.tp, r.fp) for r in got if r.k == key), reverse=True)
        assert mine == want
        rows = sorted((r for r in got if r.k == key), key=lambda r: -r.score)
        for a, b in zip(rows, rows[1:]):
            assert (a.below.pos, a.below.neg) == (b.pos, b.neg)
        assert rows[-1].below is None
        assert {(r.n_pos, r.n_neg) for r in rows} == {(want[-1][1], want[-1][2])}


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    s = crowded(rng, 120)
    y = (rng.random(len(s)) < 0.3).astype(int)
    row = M.metrics(frame(spark, y, s), 0.75).first()
    hit = s >= 0.75
    tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
    assert (row.tp, row.fp) == (tp, fp)
    assert row.auc == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert row.ap == pytest.approx(brute_ap(y, s), abs=1e-12)
    assert row.f1 == pytest.approx(2 * tp / (2 * tp + fp + (y == 1).sum() - tp))


def test_edge_cases(spark):
    empty = M.metrics(spark.createDataFrame([], SCHEMA)).first()
    assert empty.n == 0 and empty.accuracy is None and empty.auc is None and empty.tp == 0
    one = M.metrics(frame(spark, [1, 1], [0.2, 0.9])).first()
    assert one.auc is None and one.specificity is None
    assert one.balanced_accuracy == one.recall == 0.5
    none = M.metrics(spark.createDataFrame([("a", 1, None), ("a", None, 0.5)], SCHEMA)).first()
    assert none.n == 0
    nan = M.metrics(frame(spark, [1, 0, 1], [float("nan"), 0.1, 0.9])).first()
    assert (nan.n, nan.tp, nan.fp) == (2, 1, 0)
    flat = M.metrics(frame(spark, [1, 0, 0], [0.4, 0.4, 0.4])).first()
    assert flat.auc == 0.5 and flat.f1 is None and flat.precision is None
    single = M.metrics(frame(spark, [0], [0.4])).first()
    assert single.n == 1 and single.accuracy == 1.0


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.floats(-1e6, 1e6)), min_size=2, max_size=40))
def test_auc_properties(spark, pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] for p in pairs])
    plain = M.roc_auc(frame(spark, y, s)).first().auc
    minus = M.roc_auc(frame(spark, y, -s)).first().auc
    assert plain == (pytest.approx(brute_auc(y, s), abs=1e-12) if plain is not None else None)
    if plain is not None:
        assert plain == pytest.approx(1 - minus, abs=1e-12)


def test_curves(spark):
    y = np.array([1, 0, 1, 1, 0, 0, 1, 0])
    s = np.array([0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.4, 0.3])
    full = M.roc_points(frame(spark, y, s), drop_collinear=False).collect()
    assert len(full) == 9
    kept = {(r.fpr, r.tpr) for r in M.roc_points(frame(spark, y, s)).collect()}
    assert (0.25, 0.5) not in kept and {(0.0, 0.0), (1.0, 1.0)} <= kept
    pr = M.pr_points(frame(spark, y, s)).collect()
    assert len(pr) == 9 and any(r.recall == 0.0 and r.precision == 1.0 for r in pr)
    assert M.roc_points(frame(spark, [1, 1], [0.1, 0.2])).count() == 0


def brute_best(y, s, crit):
    best_t, best_v = 0.5, -np.inf
    for t in np.unique(np.round(s, 4)):
        hit = s >= t
        tp, fp = (hit & (y == 1)).sum(), (hit & (y == 0)).sum()
        v = 2 * tp / (tp + fp + (y == 1).sum()) if crit == "f1" else \
            tp / (y == 1).sum() - fp / (y == 0).sum()
        if (crit != "f1" or tp) and v > best_v:
            best_t, best_v = t, v
    return best_t


def test_thresholds(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.4).astype(int)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)
    df = frame(spark, y, s)
    for crit in ("f1", "youden"):
        assert T.best_threshold(df, crit).first().threshold == brute_best(y, s, crit)
    neg, pos = s[y == 0], s[y == 1]
    want = next(t for t in np.unique(s) if (neg >= t).mean() <= 0.05)
    assert T.threshold_for_fpr(df, 0.05).first().threshold == want
    assert T.quantile_threshold(df, 0.03).first().threshold == pytest.approx(
        np.quantile(neg, 0.97), abs=1e-15)
    row = T.fpr_at_tpr(df, 0.95).first()
    assert row.threshold == pytest.approx(np.quantile(pos, 1 - 0.95), abs=1e-15)
    assert row.fpr_at_tpr == pytest.approx((neg >= np.quantile(pos, 1 - 0.95)).mean())


def test_threshold_fallbacks(spark):
    df = frame(spark, [0, 0, 1, 1], [0.9, 0.9, 0.2, 0.9])
    assert T.threshold_for_fpr(df, 0.1).first().threshold == math.nextafter(0.9, 1)
    only = frame(spark, [1, 1], [0.3, 0.6])
    assert T.threshold_for_fpr(only).first().threshold == 0.5
    assert T.best_threshold(only).first().threshold == 0.5
    assert T.quantile_threshold(only).first().threshold == 0.0
    assert T.fpr_at_tpr(only).first().fpr_at_tpr is None


def test_recommendations(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.clip(rng.normal(0.45 + 0.1 * y, 0.15), 0, 1)
    rows = T.recommendations(frame(spark, y, s), 0.5).orderBy("ord").collect()
    assert [r.point for r in rows] == ["deployed", "FPR<=0.5%", "FPR<=1%", "FPR<=2%", "FPR<=5%",
                                       "best F1", "best balanced"]
    assert [r.recommended for r in rows].index(True) == 1
    for r in rows:
        assert r.tp == ((s >= r.threshold) & (y == 1)).sum()
        assert r.auc == pytest.approx(brute_auc(y, s))
    fprs = [r.fpr for r in rows[1:5]]
    assert fprs == sorted(fprs) and all(f <= b for f, b in zip(fprs, (.005, .01, .02, .05)))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, 501), 2)
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    row = L.quantiles(frame(spark, np.ones(501), x), qs).first()
    assert list(row) == pytest.approx(list(np.quantile(x, qs)), abs=1e-14)


def test_grid_bins_settle_on_the_edges(spark):
    edges = np.linspace(0, 1, 31)
    vals = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 1)])
    vals = vals[(vals >= 0) & (vals <= 1)]
    rows = spark.createDataFrame([(float(v),) for v in vals], "v double").select(
        "v", grid_bin(F.col("v"), 30).alias("b")).collect()
    steps = np.array([i * (1.0 / 30) for i in range(30)] + [1.0])
    assert all(r.b == np.searchsorted(steps, r.v, side="right") - 1 for r in rows)


def test_sweep_and_histogram(spark):
    rng = np.random.default_rng(4)
    s, y = np.round(rng.random(200), 2), rng.integers(0, 2, 200)
    rows = {round(r.threshold, 2): r for r in M.threshold_sweep(frame(spark, y, s)).collect()}
    assert len(rows) == 101
    for i in (0, 29, 57, 58, 100):
        t = i * 0.01 if i < 100 else 1.0
        assert rows[round(t, 2)].accuracy == pytest.approx(((s >= t) == (y == 1)).mean())
    hist = M.score_histogram(frame(spark, y, s)).agg(F.sum("items")).first()[0]
    assert hist == 200


def test_calibration_error(spark):
    rng = np.random.default_rng(6)
    p, y = rng.random(500), rng.integers(0, 2, 500)
    p[:3] = [0.0, 1.0, 1 / 15]
    idx = np.clip(np.digitize(p, np.linspace(0, 1, 16)[1:-1]), 0, 14)
    want = sum((idx == b).mean() * abs(p[idx == b].mean() - y[idx == b].mean())
               for b in range(15) if (idx == b).any())
    got = C.expected_calibration_error(frame(spark, y, p), "s").first().ece
    assert got == pytest.approx(want) and 0 <= got <= 1
