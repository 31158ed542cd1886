"""Confusion metrics, ranking metrics, curves and histograms from (truth, score) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions.numeric import grid_bin, nan_to_null, ratio
from verigauge.operators.ladder import score_ladder

METRIC_COLUMNS = (
    "n", "n_real", "n_ai", "threshold", "accuracy", "balanced_accuracy", "precision",
    "recall", "specificity", "f1", "fpr", "fnr", "auc", "ap", "tp", "fp", "tn", "fn",
)


def auc_fold() -> Column:
    """Aggregate over ladder rows; ties count half, NULL unless both classes exist."""
    below_twice = F.lit(2) * (F.col("n_neg") - F.col("fp")) + F.col("neg")
    area = F.sum(F.col("pos").cast("double") * below_twice.cast("double"))
    pairs = F.max(F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return F.when(pairs > 0, area / (2.0 * pairs))


def ap_fold() -> Column:
    """Step-wise average precision over ladder rows."""
    steps = F.sum(F.col("pos").cast("double") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    return F.when(both, steps / F.max("n_pos"))


def flagged_fold(side: str, threshold: Column) -> Column:
    """Rows of one class at or above the threshold, over ladder rows."""
    return F.coalesce(F.sum(F.when(F.col("score") >= threshold, F.col(side)).otherwise(0)),
                      F.lit(0)).cast("bigint")


def rate_columns() -> dict[str, Column]:
    """The derived rates over tp/fp/n_ai/n_real; undefined ones are NULL."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "n_ai", "n_real"))
    tn, fn = neg - fp, pos - tp
    recall, spec = ratio(tp, pos), ratio(tn, neg)
    return {
        "n": pos + neg,
        "tn": tn,
        "fn": fn,
        "accuracy": ratio(tp + tn, pos + neg),
        "balanced_accuracy": F.coalesce((recall + spec) / 2.0, recall, spec),
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "specificity": spec,
        "f1": F.when((tp > 0) & (pos > 0), ratio(tp * 2, tp + fp + pos)),
        "fpr": ratio(fp, neg),
        "fnr": ratio(fn, pos),
    }


def confusion(df: DataFrame, threshold: float, keys: Sequence[str] = (), score: str = "s",
              truth: str = "y") -> DataFrame:
    """Threshold metrics only: one partial aggregate, no ordering of the scores."""
    s, y = nan_to_null(F.col(score)), F.col(truth).cast("int")
    valid = df.select(*keys, s.alias("s"), y.alias("y")).where(
        F.col("s").isNotNull() & F.col("y").isNotNull())
    hit = F.col("s") >= threshold

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    agg = valid.groupBy(*keys).agg(
        count(F.col("y") == 1).alias("n_ai"), count(F.col("y") == 0).alias("n_real"),
        count(hit & (F.col("y") == 1)).alias("tp"), count(hit & (F.col("y") == 0)).alias("fp"))
    rates = rate_columns()
    return agg.select(*keys, F.lit(float(threshold)).alias("threshold"), "n_real", "n_ai",
                      "tp", "fp", *[c.alias(k) for k, c in rates.items()])


def metrics_from_ladder(ladder: DataFrame, threshold: float,
                        keys: Sequence[str] = ()) -> DataFrame:
    thr = F.lit(float(threshold))
    agg = ladder.groupBy(*keys).agg(
        F.coalesce(F.max("n_pos"), F.lit(0)).cast("bigint").alias("n_ai"),
        F.coalesce(F.max("n_neg"), F.lit(0)).cast("bigint").alias("n_real"),
        flagged_fold("pos", thr).alias("tp"), flagged_fold("neg", thr).alias("fp"),
        auc_fold().alias("auc"), ap_fold().alias("ap"))
    rates = rate_columns()
    return agg.select(
        *keys, *[c.alias(k) for k, c in rates.items()], thr.alias("threshold"),
        "n_real", "n_ai", "tp", "fp", "auc", "ap").select(*keys, *METRIC_COLUMNS)


def metrics(df: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (),
            score: str = "s", truth: str = "y") -> DataFrame:
    """The full metric row at a threshold: one ladder, one fold over it."""
    return metrics_from_ladder(score_ladder(df, keys, score, truth), threshold, keys)


def roc_auc(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
            truth: str = "y") -> DataFrame:
    return score_ladder(df, keys, score, truth).groupBy(*keys).agg(auc_fold().alias("auc"))


def average_precision(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
                      truth: str = "y") -> DataFrame:
    return score_ladder(df, keys, score, truth).groupBy(*keys).agg(ap_fold().alias("ap"))


def _with_end_point(ladder: DataFrame, keys: Sequence[str], point: Column,
                    end: Column) -> DataFrame:
    """Every ladder row gives its point; the top row gives the curve's end point too."""
    is_top = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    points = F.when(is_top, F.array(end, point)).otherwise(F.array(point))
    return ladder.where(both).select(*keys, F.inline(points))


def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "s", truth: str = "y",
               drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr); the origin has no threshold. Empty unless both classes exist.

    ``drop_collinear`` leaves out inner points on a straight run, that is rows
    whose counts equal those of the next lower score.
    """
    lad = score_ladder(df, keys, score, truth, below=drop_collinear)
    if drop_collinear:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("below.pos") != F.col("pos")) | (F.col("below.neg") != F.col("neg"))
        lad = lad.where(first | F.col("below").isNull() | bend)
    no_threshold = F.lit(None).cast("double")
    point = F.struct(F.col("score").alias("threshold"),
                     ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
                     ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = F.struct(no_threshold.alias("threshold"), F.lit(0.0).alias("fpr"),
                      F.lit(0.0).alias("tpr"))
    return _with_end_point(lad, keys, point, origin)


def pr_points(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
              truth: str = "y") -> DataFrame:
    """(threshold, recall, precision) plus the end point (0, 1)."""
    lad = score_ladder(df, keys, score, truth)
    point = F.struct(F.col("score").alias("threshold"),
                     ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
                     ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                   F.lit(1.0).alias("precision"))
    return _with_end_point(lad, keys, point, end)


def threshold_sweep(df: DataFrame, points: int = 101, keys: Sequence[str] = (),
                    score: str = "s", truth: str = "y") -> DataFrame:
    """Accuracy, F1 and FPR at ``points`` even thresholds over [0, 1].

    Every row falls between two grid points, so counting rows per grid cell is
    enough: one small aggregate and no ordering of scores.
    """
    steps = points - 1
    s, y = nan_to_null(F.col(score)), F.col(truth).cast("int")
    cell = F.when(F.col("s") < 0, -1).otherwise(grid_bin(F.col("s"), steps))
    cells = (
        df.select(*keys, s.alias("s"), y.alias("y"))
        .where(F.col("s").isNotNull() & F.col("y").isNotNull())
        .groupBy(*keys, cell.alias("cell"))
        .agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"),
             F.count(F.when(F.col("y") == 0, 1)).alias("neg")))
    # at most points + 1 cells per key, so they fit into one array
    per_key = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"),
        F.sum("pos").alias("n_ai"), F.sum("neg").alias("n_real")).where("n_ai IS NOT NULL")
    rows = per_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))

    def at_or_above(side: str) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(
            c["cell"] >= F.col("i"), c[side]).otherwise(F.lit(0)))
    rows = rows.withColumn("tp", at_or_above("pos")).withColumn("fp", at_or_above("neg"))
    rates = rate_columns()
    at = F.when(F.col("i") == steps, F.lit(1.0)).otherwise(
        F.col("i").cast("double") * F.lit(1.0 / steps))
    return rows.select(*keys, at.alias("threshold"),
                       *[rates[k].alias(k) for k in ("accuracy", "f1", "fpr")])


def score_histogram(df: DataFrame, bins: int = 30, keys: Sequence[str] = (),
                    score: str = "s", truth: str = "y") -> DataFrame:
    """Counts per class and equal bin on [0, 1]; class -1 is the unlabelled series.

    The last bin is closed and scores outside [0, 1] are left out.
    """
    s = nan_to_null(F.col(score))
    return (
        df.select(*keys, F.coalesce(F.col(truth).cast("int"), F.lit(-1)).alias("label"),
                  s.alias("s"))
        .where(F.col("s").between(0.0, 1.0))
        .groupBy(*keys, "label", F.least(grid_bin(F.col("s"), bins), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
