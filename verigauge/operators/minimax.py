"""A linear head for the worst view: minimax over views instead of refits on hard rows.

The objective is the smooth maximum of the views' mean losses, log(sum over views of exp(sharpness * loss)) / sharpness, plus a
ridge. Its gradient is the views' gradients under exponential weights, so views that fare badly weigh more, as much as
the optimum asks for and no more. It is convex, and L-BFGS minimises it: every evaluation is one pass over the rows, in
which tasks sum loss and gradient per view in NumPy, and a row of sums per view reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.operators.near_vectors import matrix
from verigauge.operators.ranks import stored
from verigauge.operators.training import _clean
from verigauge.session import ship_package

#: Correction pairs that L-BFGS keeps.
MEMORY = 10


@dataclass
class MinimaxFit:
    weights: list[float]
    bias: float
    view_weights: dict[int, float]
    losses: dict[int, float]
    gradient: float
    passes: int


def _sums(point: np.ndarray, pos_weight: float) -> Callable:
    """(x, y, view_id) -> per task and view (view_id, sums): rows, loss, gradient with the bias last."""
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("x")), batch.column("y").to_numpy().astype(float)
            view = batch.column("view_id").to_numpy()
            z = x @ point[:-1] + point[-1]
            weight = np.where(y == 1, pos_weight, 1.0)
            loss = weight * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z)
            slope = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)
            for v in np.unique(view).tolist():
                mine = view == v
                s = np.concatenate([[mine.sum(), loss[mine].sum()], slope[mine] @ x[mine], [slope[mine].sum()]])
                totals[v] = totals.get(v, 0) + s
        if totals:
            flat = np.concatenate(list(totals.values()))
            size = len(flat) // len(totals)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.ListArray.from_arrays(
                np.arange(0, len(flat) + 1, size, dtype=np.int32), pa.array(flat))], ["view_id", "sums"])
    return run


def view_sums(rows: DataFrame, point: np.ndarray, pos_weight: float) -> tuple[list[int], np.ndarray]:
    """The views and their (rows, loss, gradient) sums; one row per view comes to the driver."""
    parts = rows.mapInArrow(_sums(point, pos_weight), "view_id int, sums array<double>")
    total = parts.groupBy("view_id").agg(Summarizer.metrics("sum").summary(array_to_vector("sums")).alias("s"))
    found = sorted(total.select("view_id", vector_to_array("s.sum").alias("sums")).collect(), key=lambda r: r.view_id)
    return [r.view_id for r in found], np.array([r.sums for r in found])


def soft_maximum(losses: np.ndarray, sharpness: float) -> tuple[float, np.ndarray]:
    """The smooth maximum and the weights of its gradient."""
    top = losses.max()
    e = np.exp(sharpness * (losses - top))
    return float(top + np.log(e.sum()) / sharpness), e / e.sum()


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """A minimum of a smooth convex function, with backtracking; ``most`` bounds the evaluations."""
    at, (f, g), used = start, value(start), 1
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(g).max() > tolerance and used < most:
        d, alphas = -g, []
        for s, t in reversed(pairs):
            a = s @ d / (s @ t)
            alphas.append(a)
            d = d - a * t
        if pairs:
            s, t = pairs[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - t @ d / (s @ t)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum())
        while used < most:
            new = at + step * d
            f2, g2 = value(new)
            used += 1
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-10:
                break
            step /= 2
        else:
            break
        if (g2 - g) @ (new - at) > 1e-14:
            pairs = [*pairs, (new - at, g2 - g)][-MEMORY:]
        elif step < 1e-10:
            break
        at, f, g = new, f2, g2
    return at


def fit_minimax(train: DataFrame, sharpness: float = 20.0, reg: float = 1e-3, tolerance: float = 1e-6, most_passes: int = 200) -> MinimaxFit:
    """A head on prepared vectors ``x`` with ``y`` and ``view_id``, for the least smooth maximum of the views' mean losses.

    Rows without a label, a view or a whole vector do not count; positives weigh as much as negatives. A greater
    ``sharpness`` comes closer to the true maximum and takes more passes. The rows are stored once. At most ``most_passes`` passes are
    made; ``gradient`` tells how far from the optimum the fit then is.
    """
    ship_package(train.sparkSession)
    rows = stored(_clean(train).where(F.col("view_id").isNotNull()).select(
        F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("view_id").cast("int").alias("view_id")), "views")
    head = rows.agg(F.count(F.when(F.col("y") == 0, 1)).alias("neg"), F.count(F.when(F.col("y") == 1, 1)).alias("pos"),
                    F.max(F.size("x")).alias("dims")).first()
    if not head.neg or not head.pos:
        raise ValueError("both classes are needed to fit a head")
    last: dict = {"passes": 0}

    def value(point: np.ndarray) -> tuple[float, np.ndarray]:
        views, sums = view_sums(rows, point, head.neg / head.pos)
        losses, slopes = sums[:, 1] / sums[:, 0], sums[:, 2:] / sums[:, :1]
        f, q = soft_maximum(losses, sharpness)
        ridge = reg * np.append(point[:-1], 0.0)
        g = q @ slopes + ridge
        last.update(passes=last["passes"] + 1, views=views, q=q, losses=losses, g=g, point=point)
        return f + float(ridge @ point) / 2, g

    at = lbfgs(value, np.zeros(head.dims + 1), tolerance, most_passes)
    if last["point"] is not at:
        value(at)
    return MinimaxFit(at[:-1].tolist(), float(at[-1]), dict(zip(last["views"], last["q"].tolist(), strict=True)),
                      dict(zip(last["views"], last["losses"].tolist(), strict=True)), float(np.abs(last["g"]).max()), last["passes"])
