"""The minimax head against plain fits and against its own optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verigauge.operators import minimax as MM
from verigauge.operators import training as TR

ROWS = "item_id long, view_id int, y int, x array<double>"


def auc(score, y):
    order = score.argsort(kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def table():
    """Two features. Five views have a strong first one; in the last view it points the wrong way and only the second helps."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        y = i % 2
        for view in range(6):
            strong = (2 * y - 1) * (3.0 if view < 5 else -0.6)
            rows.append((i, view, y, [strong + rng.standard_normal(), (2 * y - 1) * 0.8 + rng.standard_normal(), 0.1 * rng.standard_normal()]))
    return rows


def aucs(rows, weights, bias=0.0):
    view, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    score = np.array([r[3] for r in rows]) @ np.array(weights) + bias
    return [auc(score[view == v], y[view == v]) for v in sorted(set(view.tolist()))]


def test_the_worst_view_is_better_than_by_refits(spark):
    rows = table()
    df = spark.createDataFrame(rows, ROWS)
    fit = MM.fit_minimax(df)
    plain = TR.fit_head(df, df, rounds=3, views=6, iterations=30)
    worst, before = min(aucs(rows, fit.weights, fit.bias)), min(aucs(rows, plain.weights, plain.bias))
    assert worst > before + 0.1 and worst > 0.6
    assert max(fit.view_weights, key=fit.view_weights.get) == 5
    assert fit.gradient < 1e-5 and fit.passes < 100


def test_it_is_the_optimum(spark):
    rows = table()[:900]
    df = spark.createDataFrame([*rows, (1, None, 1, [1.0, 1.0, 1.0]), (1, 0, None, [1.0, 1.0, 1.0]), (1, 0, 1, None), (1, 0, 1, [float("nan"), 0.0, 0.0])], ROWS)
    fit = MM.fit_minimax(df.repartition(5), sharpness=10.0, reg=0.01)
    x, y, view = np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def value(p):
        z = x @ p[:-1] + p[-1]
        loss = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0) * (np.logaddexp(0, z) - y * z)
        return np.log(sum(np.exp(10 * loss[view == v].mean()) for v in range(6))) / 10 + 0.005 * p[:-1] @ p[:-1]

    at = np.array([*fit.weights, fit.bias])
    rng = np.random.default_rng(0)
    best = value(at)
    assert all(value(at + 10.0 ** -k * rng.standard_normal(4)) >= best - 1e-10 for k in (1, 2, 3) for _ in range(50))
    assert abs(sum(fit.view_weights.values()) - 1) < 1e-12


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError, match="both classes"):
        MM.fit_minimax(spark.createDataFrame([(1, 0, 1, [1.0])], ROWS))


def test_lbfgs():
    scale = np.array([1.0, 100.0, 0.01])
    at = MM.lbfgs(lambda p: (float((scale * (p - 3) ** 2).sum()), 2 * scale * (p - 3)), np.zeros(3), 1e-9, 300)
    assert np.allclose(at, 3, atol=1e-5)
