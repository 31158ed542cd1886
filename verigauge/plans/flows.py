"""End-to-end flows: score a collection, sweep it, calibrate, evaluate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigauge.operators import conditions as D
from verigauge.operators import images as I
from verigauge.operators import labelling as LB
from verigauge.operators import metrics as M
from verigauge.operators import results as R
from verigauge.operators import sampling as S
from verigauge.operators import scoring as SC
from verigauge.operators import thresholds as T
from verigauge.sinks import writers as W
from verigauge.sources import files as FS


def score_folder(spark: SparkSession, root: str, scorer: I.ImageScorer, out: str | None = None,
                 threshold: float | None = None, mode: str = LB.AUTO,
                 relative: bool = False, report: str | None = None) -> DataFrame:
    """Scan, label, score; returns ``path, rel_path, label, score, error``.

    With ``out`` the scores are written once and everything after that reads the
    written table, so no picture is scored twice.
    """
    items = FS.scan_items(spark, root, mode)
    pictures = FS.read_pictures(spark, root).drop("error")
    scored = SC.score(pictures, scorer, ["path"])
    rows = items.join(scored, "path", "left").select(
        "path", "rel_path", "label", "score", F.coalesce("error", F.when(
            F.col("score").isNull(), F.lit("could not be decoded"))).alias("error"))
    if out is None:
        return rows
    W.write_parquet(rows, f"{out}/scores")
    rows = spark.read.parquet(f"{out}/scores")
    thr = scorer.default_threshold if threshold is None else threshold
    path = "rel_path" if relative else "path"
    W.write_json(R.predictions(rows, thr, path, "score"), f"{out}/predictions")
    if report:
        W.write_json(R.run_report(
            LB.class_balance(rows, "label", "score"),
            M.metrics(rows, thr, score="score", truth="label"), scorer.display_name, root, mode,
            thr), report)
    return rows


def sweep_folder(spark: SparkSession, root: str, scorer: I.ImageScorer,
                 conditions: Sequence[D.Condition], sample: int | None = None,
                 max_side: int | None = None, threshold: float | None = None,
                 least_bytes: int = 0) -> DataFrame:
    """All labelled pictures, or a balanced sample of them, under every condition, as one job.

    Files below ``least_bytes`` are passed over. A sample is drawn from the listing and only
    its files are opened; its paths go through the driver, all others never do.
    """
    items = FS.scan_items(spark, root).where(F.col("size_bytes") >= least_bytes)
    LB.require(items, labels=True)
    picked = items.where(F.col("label").isin(0, 1)).withColumnRenamed("label", "y")
    source: str | list[str] = root
    if sample is not None:
        picked = S.balanced_sample(picked, sample, ["path"])
        source = [r.path for r in picked.select("path").collect()]
    pictures = FS.read_pictures(spark, source, max_side).drop("error").join(
        picked.select("path", "y"), "path")
    return I.image_sweep(pictures, conditions, scorer, threshold, item="path",
                         max_side=max_side)


def calibrate(scored: DataFrame, deployed: float,
              budgets: Sequence[float] = T.DEFAULT_BUDGETS, label: str = "label",
              score: str = "score") -> DataFrame:
    """Operating points of a scored set; needs both classes."""
    LB.require(scored, label, both_classes=True)
    return T.recommendations(scored, deployed, budgets, score=score, truth=label)


def evaluate(scores: DataFrame, threshold: float, conditions: Sequence[D.Condition],
             platt_a: float = 1.0, platt_b: float = 0.0) -> dict[str, DataFrame]:
    """The evaluation tables of ``item_id, y, grp, cell, s`` rows, one frame each.

    Pass a stored score table, since every table here is its own job over it.
    """
    from verigauge.operators import calibration as C

    per = D.condition_metrics(scores, threshold, conditions=conditions)
    groups = D.group_vs_negatives(scores, threshold, conditions=conditions)
    return {
        "conditions": per, "families": D.family_rollup(per), "drift": D.score_drift(per),
        "groups": D.group_means(groups),
        "calibration": D.named_cells(
            C.calibration_table(scores, platt_a, platt_b, ["cell"]), conditions),
    }
