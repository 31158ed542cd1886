"""Head fitting and Platt scaling on feature tables with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.functions import vectors as V
from verigauge.functions.numeric import nan_to_null
from verigauge.operators.conditions import view_metrics
from verigauge.operators.heads import view_loss
from verigauge.operators.sampling import hardest_views


@dataclass
class Fit:
    weights: list[float]
    bias: float
    history: list[dict]
    best_round: int


def _fit(rows: DataFrame, reg: float, iterations: int):
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight",
                            regParam=reg, maxIter=iterations, standardization=False)
    return lr.fit(rows.withColumn("features", array_to_vector(F.col("x"))))


def _clean(rows: DataFrame) -> DataFrame:
    """Rows with a label and a whole vector; a NaN would end the fit."""
    return rows.where(F.col("y").isNotNull() & F.col("x").isNotNull()
                      & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def fit_head(train: DataFrame, valid: DataFrame, rounds: int = 3, mode: str = "cvar",
             views: int = 6, reg: float = 1e-4, iterations: int = 50, item: str = "item_id",
             clean_view: int = 0) -> Fit:
    """Linear head on prepared vectors ``x`` with ``y`` and ``view_id`` per item.

    Each round refits on the clean views and the views that the last head found
    hardest. The round with the best *worst-view* AUC on the validation rows is kept.
    """
    # every round reads both tables several times; lost blocks are recomputed
    train, valid = _clean(train).persist(), _clean(valid).persist()
    try:
        return _fit_rounds(train, valid, rounds, mode, views, reg, iterations, item, clean_view)
    finally:
        train.unpersist()
        valid.unpersist()


def _fit_rounds(train: DataFrame, valid: DataFrame, rounds: int, mode: str, views: int,
                reg: float, iterations: int, item: str, clean_view: int) -> Fit:
    weight = train.where(F.col("view_id") == clean_view).agg(
        F.count(F.when(F.col("y") == 0, 1)).alias("neg"),
        F.count(F.when(F.col("y") == 1, 1)).alias("pos")).first()
    if weight.neg == 0 or weight.pos == 0:
        raise ValueError("both classes are needed to fit a head")
    pos_weight = weight.neg / max(weight.pos, 1)
    weighted = train.withColumn("weight", F.when(F.col("y") == 1, F.lit(float(pos_weight)))
                                .otherwise(F.lit(1.0)))
    rows, history, best = weighted, [], None
    for r in range(rounds):
        model = _fit(rows, reg, iterations)
        w, b = [float(x) for x in model.coefficients], float(model.intercept)
        logit = V.dot(F.col("x"), V.literal(w)) + b
        scores = valid.select("view_id", "y", logit.alias("s"))
        row = view_metrics(scores, clean_view=clean_view).first().asDict()
        history.append({"round": r, **row})
        worst = row["auc_worst"] if row["auc_worst"] is not None else -1.0
        if best is None or worst > best[0]:
            best = (worst, r, w, b)
        if r + 1 < rounds:
            loss = view_loss(logit, F.col("y"), F.lit(float(pos_weight)))
            hard = hardest_views(
                weighted.where(F.col("view_id") != clean_view).withColumn("loss", loss),
                item, "loss", views, mode).drop("loss")
            rows = weighted.where(F.col("view_id") == clean_view).unionByName(hard)
    return Fit(best[2], best[3], history, best[1])


def fit_platt(df: DataFrame, score: str = "s", truth: str = "y") -> tuple[float, float]:
    """Slope and offset of sigmoid(a * score + b) by unregularised logistic loss.

    Failed scores (NULL or NaN) and unlabelled rows do not count.
    """
    rows = df.select(nan_to_null(F.col(score).cast("double")).alias("s"),
                     F.col(truth).cast("double").alias("y")).where("y IS NOT NULL AND s IS NOT NULL")
    rows = rows.select(F.array("s").alias("x"), "y", F.lit(1.0).alias("weight"))
    model = _fit(rows, 0.0, 200)
    return float(model.coefficients[0]), float(model.intercept)


def history_rows(spark, fit: Fit) -> DataFrame:
    """The rounds of a fit as rows for the history table."""
    cols: Sequence[str] = ("auc_clean", "auc_mean", "auc_worst", "auc_pooled", "fpr95_pooled")
    return spark.createDataFrame(
        [(h["round"], *[h[c] for c in cols], h["round"] == fit.best_round)
         for h in fit.history],
        "round int, " + ", ".join(f"{c} double" for c in cols) + ", best boolean")
