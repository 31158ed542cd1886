"""Decision thresholds: by criterion, by false-positive budget, by quantile.

All searches are folds over one score ladder; counts at a threshold that was
found this way come from a second, unordered pass over the counts per score. Where several thresholds reach
the same value the lowest one is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions.numeric import next_above, ratio
from verigauge.operators.ladder import (
    ladder_from_counts, quantile_of, score_counts, score_ladder)
from verigauge.operators.metrics import (
    METRIC_COLUMNS, ap_fold, auc_fold, rate_columns)
from verigauge.operators.scalars import attach_per_key

NO_CHOICE = 0.5                                   # answer when a class is missing
DEFAULT_BUDGETS = (0.005, 0.01, 0.02, 0.05)


def _recall() -> Column:
    return ratio(F.col("tp"), F.col("n_pos"))


def _fpr() -> Column:
    return ratio(F.col("fp"), F.col("n_neg"))


def _criterion(name: str) -> Column:
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    if name == "f1":
        return F.when(tp > 0, ratio(tp * 2, tp + fp + pos))
    if name == "youden":
        return _recall() - _fpr()
    if name == "acc":
        return ratio(tp + neg - fp, pos + neg)
    if name == "balanced":
        return (ratio(tp, F.greatest(pos, F.lit(1)))
                + ratio(neg - fp, F.greatest(neg, F.lit(1)))) * 0.5
    raise ValueError(f"unknown criterion {name!r}")


def _best_score(value: Column, eligible: Column) -> Column:
    """Aggregate: the lowest score among eligible rows with the highest value."""
    best = F.max(F.when(eligible & value.isNotNull(),
                        F.struct(value.alias("v"), (-F.col("score")).alias("m"))))
    return -best["m"]


def _both() -> Column:
    return (F.max("n_pos") > 0) & (F.max("n_neg") > 0)


def _round4(c: Column) -> Column:
    return F.rint(c * 10000.0) / 10000.0


def candidate_ladder(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
                     truth: str = "y") -> DataFrame:
    """Ladder with extra zero-count rungs at the scores rounded to 4 places, marked ``candidate``."""
    counts = score_counts(df, keys, score, truth)
    zero = F.lit(0).cast("bigint")
    rungs = counts.select(*keys, _round4(F.col("score")).alias("score"), zero.alias("pos"),
                          zero.alias("neg"), F.lit(True).alias("candidate"))
    parts = counts.select(*keys, "score", "pos", "neg",
                          F.lit(False).alias("candidate")).unionByName(rungs)
    merged = parts.groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("candidate").alias("candidate"))
    return ladder_from_counts(merged, keys, extra=["candidate"])


def best_threshold(df: DataFrame, criterion: str = "f1", keys: Sequence[str] = (),
                   score: str = "s", truth: str = "y") -> DataFrame:
    """Best F1 or Youden threshold among the scores rounded to 4 places; 0.5 if one class."""
    lad = candidate_ladder(df, keys, score, truth)
    pick = _best_score(_criterion(criterion), F.col("candidate"))
    return lad.groupBy(*keys).agg(
        F.coalesce(F.when(_both(), pick), F.lit(NO_CHOICE)).alias("threshold"))


def _budget_pick(budget: float) -> Column:
    real_row = (F.col("pos") + F.col("neg")) > 0
    within = F.min(F.when(real_row & (_fpr() <= budget), F.col("score")))
    top = F.max(F.when(real_row, F.col("score")))
    return F.coalesce(F.when(_both(), F.coalesce(within, next_above(top))), F.lit(NO_CHOICE))


def threshold_for_fpr(df: DataFrame, budget: float = 0.01, keys: Sequence[str] = (),
                      score: str = "s", truth: str = "y") -> DataFrame:
    """Lowest observed score whose FPR stays within budget, else just above the maximum."""
    return score_ladder(df, keys, score, truth).groupBy(*keys).agg(
        _budget_pick(budget).alias("threshold"))


def quantile_threshold(df: DataFrame, max_fpr: float = 0.01, keys: Sequence[str] = (),
                       score: str = "s", truth: str = "y") -> DataFrame:
    """The (1 - max_fpr) quantile of the negatives; 0.0 if there are none."""
    return score_ladder(df, keys, score, truth).groupBy(*keys).agg(
        F.coalesce(quantile_of("neg", 1.0 - max_fpr), F.lit(0.0)).alias("threshold"))


def scan_threshold(df: DataFrame, mode: str = "balanced", max_fpr: float = 0.01,
                   keys: Sequence[str] = (), score: str = "s", truth: str = "y") -> DataFrame:
    """Best accuracy or balanced accuracy over every distinct score, or mode ``fpr``."""
    if mode == "fpr":
        return quantile_threshold(df, max_fpr, keys, score, truth)
    value = _criterion(mode)
    return score_ladder(df, keys, score, truth).groupBy(*keys).agg(
        _best_score(value, F.lit(True)).alias("threshold"),
        F.max(value).alias("value"))


def counts_at(df: DataFrame, per_key: DataFrame, thresholds: Sequence[Column],
              keys: Sequence[str] = (), score: str = "s", truth: str = "y",
              few: bool = False) -> DataFrame:
    """Adds ``tps`` and ``fps``: rows of each class at or above thresholds known per key.

    ``thresholds`` are expressions over the columns of ``per_key``. The rows are read as
    counts per score, the same ones a ladder of this table starts from: Spark reuses their
    exchange, so the table behind them (maybe a costly scorer) is computed once.
    """
    return counts_above(score_counts(df, keys, score, truth), per_key, thresholds, keys, few)


def counts_above(counts: DataFrame, per_key: DataFrame, thresholds: Sequence[Column],
                 keys: Sequence[str] = (), few: bool = False) -> DataFrame:
    """:func:`counts_at` over pre-counted ``(keys, score, pos, neg)`` rows."""
    others = [c for c in per_key.columns if c not in keys]
    rows = counts.select(*keys, F.col("score").alias("_s"), F.col("pos").alias("_pos"),
                         F.col("neg").alias("_neg")).where("_pos + _neg > 0")
    # the filter needs both counts, so that this read of them equals that of the ladder
    joined = attach_per_key(rows, per_key, keys, few=few)

    def hits(side: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("_s") >= t, F.col(side))), F.lit(0))
                         for t in thresholds])
    return joined.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in others], hits("_pos").alias("tps"),
        hits("_neg").alias("fps"))


def fpr_at_tpr(df: DataFrame, target: float = 0.95, keys: Sequence[str] = (),
               score: str = "s", truth: str = "y") -> DataFrame:
    """FPR at the threshold where ``target`` of the positives are caught."""
    fold = score_ladder(df, keys, score, truth).groupBy(*keys).agg(
        quantile_of("pos", 1.0 - target).alias("at"), F.max("n_neg").alias("n_neg"))
    hit = counts_at(df, fold, [F.col("at")], keys, score, truth)
    return hit.select(*keys, F.col("at").alias("threshold"),
                      F.when(F.col("at").isNotNull(), ratio(F.col("fps")[0], F.col("n_neg")))
                      .alias("fpr_at_tpr"))


def metrics_at_points(df: DataFrame, points: DataFrame, count: int, keys: Sequence[str] = (),
                      score: str = "s", truth: str = "y") -> DataFrame:
    """Full metrics at several thresholds per key.

    ``points`` holds per key ``n_ai, n_real, auc, ap`` and an array ``points`` of
    ``count`` structs ``(ord, point, threshold)``.
    """
    at = [F.col("points")[i]["threshold"] for i in range(count)]
    rows = counts_at(df, points, at, keys, score, truth).select(
        *keys, "n_ai", "n_real", "auc", "ap", F.inline(F.arrays_zip("points", "tps", "fps"))
    ).select(*keys, "n_ai", "n_real", "auc", "ap", "points.ord", "points.point",
             "points.threshold", F.col("tps").alias("tp"), F.col("fps").alias("fp"))
    rates = rate_columns()
    return rows.select(*keys, "ord", "point", "threshold", "n_real", "n_ai", "auc", "ap", "tp",
                       "fp", *[c.alias(k) for k, c in rates.items()]).select(
        *keys, "ord", "point", *METRIC_COLUMNS)


def _points(ladder: DataFrame, named: Sequence[tuple[str, Column]],
            keys: Sequence[str]) -> DataFrame:
    return ladder.groupBy(*keys).agg(
        F.max("n_pos").alias("n_ai"), F.max("n_neg").alias("n_real"),
        auc_fold().alias("auc"), ap_fold().alias("ap"), F.array(*[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("point"), value.alias("threshold"))
            for i, (name, value) in enumerate(named)]).alias("points"))


def recommendations(df: DataFrame, deployed: float,
                    budgets: Sequence[float] = DEFAULT_BUDGETS, keys: Sequence[str] = (),
                    score: str = "s", truth: str = "y") -> DataFrame:
    """Operating points with full metrics: deployed, each FPR budget, best F1, best balanced.

    ``recommended`` marks the tightest budget listed first.
    """
    lad = candidate_ladder(df, keys, score, truth)

    def best(criterion: str) -> Column:
        pick = _best_score(_criterion(criterion), F.col("candidate"))
        return F.coalesce(F.when(_both(), pick), F.lit(NO_CHOICE))

    named = [("deployed", F.max(F.lit(float(deployed))))]
    named += [(f"FPR<={b * 100:g}%", _budget_pick(b)) for b in budgets]
    named += [("best F1", best("f1")), ("best balanced", best("youden"))]
    points = _points(lad, named, keys)
    out = metrics_at_points(df, points, len(named), keys, score, truth)
    return out.withColumn("recommended", F.col("ord") == (1 if budgets else -1))


def before_and_after(df: DataFrame, old: float, mode: str = "balanced",
                     keys: Sequence[str] = (), score: str = "s",
                     truth: str = "y") -> DataFrame:
    """Metrics at the old threshold and at the one a rescan finds."""
    lad = score_ladder(df, keys, score, truth)
    points = _points(lad, [("old", F.max(F.lit(float(old)))),
                           (f"new ({mode})", _best_score(_criterion(mode), F.lit(True)))], keys)
    return metrics_at_points(df, points, 2, keys, score, truth)
