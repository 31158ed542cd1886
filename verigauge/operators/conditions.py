"""Perturbation grids as rows: expansion, per-condition metrics, deltas, roll-ups.

The set of conditions is small and fixed (at most a few dozen), so it travels
as a literal array and is exploded next to each item: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.functions.numeric import nan_to_null, ratio, sigmoid
from verigauge.operators.ladder import (
    ladder_from_counts, quantile_of, score_counts, score_ladder)
from verigauge.operators.metrics import (
    ap_fold, auc_fold, flagged_fold, metrics_from_ladder)
from verigauge.operators.scalars import attach_per_key
from verigauge.operators.thresholds import counts_above, counts_at

GRID_FAMILIES = ("jpeg", "blur", "resize", "noise", "color", "crop")
CELL = ("key", "family", "severity", "label")


@dataclass(frozen=True)
class Condition:
    """One cell of a grid. ``chain`` lists (kernel, params) steps for image kernels."""

    key: str
    family: str
    severity: int = 1
    label: str = ""
    params: dict = field(default_factory=dict)
    chain: tuple = ()

    @property
    def is_clean(self) -> bool:
        return self.key == "clean"


def _names(c: Condition) -> list[Column]:
    return [F.lit(c.key).alias("key"), F.lit(c.family).alias("family"),
            F.lit(c.severity).alias("severity"), F.lit(c.label).alias("label")]


def _literal(cell: int, c: Condition) -> Column:
    entries = [x for k, v in sorted(c.params.items()) for x in (F.lit(k), F.lit(float(v)))]
    params = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return F.struct(F.lit(cell).alias("cell"), *_names(c), params.alias("params"))


def expand_conditions(items: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Each item once per condition; ``cell`` is its position, ``params`` its numbers."""
    return items.select("*", F.inline(F.array(*[
        _literal(i, c) for i, c in enumerate(conditions)])))


def named_cells(rows: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Replace ``cell`` by the condition's key, family, severity and label."""
    names = F.array(*[F.struct(*_names(c)) for c in conditions])
    return rows.withColumn("_c", F.get(names, F.col("cell"))).select(
        *[F.col(f"_c.{n}").alias(n) for n in CELL],
        *[c for c in rows.columns if c not in ("cell", *CELL)])


def _by(keys: Sequence[str], conditions: Sequence[Condition] | None) -> list[str]:
    """Group by the short cell number where the list of conditions is known."""
    return ["cell"] if conditions is not None else list(keys)


def _named(rows: DataFrame, conditions: Sequence[Condition] | None) -> DataFrame:
    return rows if conditions is None else named_cells(rows, conditions)


def select_cells(conditions: Sequence[Condition], keys: Sequence[str] | None = None,
                 max_severity: int | None = None) -> list[Condition]:
    """Cells of a requested sweep: the clean baseline always and only once."""
    out = [c for c in conditions if c.is_clean][:1]
    return out + [c for c in conditions if not c.is_clean
                  and (keys is None or c.key in keys)
                  and (max_severity is None or c.severity <= max_severity)]


def condition_metrics(df: DataFrame, threshold: float, keys: Sequence[str] = CELL,
                      score: str = "s", truth: str = "y", tpr: float = 0.95,
                      conditions: Sequence[Condition] | None = None) -> DataFrame:
    """AUROC, AP, accuracy, TPR, FPR, FPR at a fixed TPR and mean score per class.

    With ``conditions`` rows are grouped by their ``cell`` number and named at the end.
    """
    keys = _by(keys, conditions)
    thr = F.lit(float(threshold))
    fold = score_ladder(df, keys, score, truth).groupBy(*keys).agg(
        auc_fold().alias("auroc"), ap_fold().alias("ap"),
        F.max("n_pos").alias("n_ai"), F.max("n_neg").alias("n_real"),
        flagged_fold("pos", thr).alias("tp"), flagged_fold("neg", thr).alias("fp"),
        F.sum(F.col("score") * F.col("pos")).alias("sum_ai"),
        F.sum(F.col("score") * F.col("neg")).alias("sum_real"),
        quantile_of("pos", 1.0 - tpr).alias("at"))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "n_ai", "n_real"))
    # the cells of a known grid are few; other keys may be many
    out = counts_at(df, fold, [F.col("at")], keys, score, truth, conditions is not None).select(
        *keys, "n_ai", "n_real", "auroc", "ap",
        ratio(tp + neg - fp, pos + neg).alias("acc"),
        ratio(tp, pos).alias("tpr"), ratio(fp, neg).alias("fpr"),
        F.when(F.col("at").isNotNull(), ratio(F.col("fps")[0], neg)).alias("fpr_at_95tpr"),
        ratio(F.col("sum_real"), neg).alias("score_mean_real"),
        ratio(F.col("sum_ai"), pos).alias("score_mean_fake"))
    return _named(out, conditions)


def score_drift(cells: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean score per class and their margin, from ``condition_metrics`` rows."""
    return cells.select(*keys, "score_mean_real", "score_mean_fake",
                        (F.col("score_mean_fake") - F.col("score_mean_real")).alias("margin"))


def family_rollup(cells: DataFrame) -> DataFrame:
    """Worst AUROC per part of the grid and its drop from clean.

    Works on metric rows, one per condition, so the window is over the grid.
    """
    fam = F.col("family")
    part = (F.when(fam == "clean", "clean").when(fam.isin(*GRID_FAMILIES), "grid")
            .when(fam.endswith("_ood"), "ood").when(fam == "chain", "chain").otherwise("other"))
    whole = Window.partitionBy(F.lit(1))
    worst = F.min(F.when(F.col("auroc").isNotNull(),
                         F.struct("auroc", "key", "severity")))
    return (
        cells.withColumn("clean_auroc", F.max(F.when(fam == "clean", F.col("auroc"))).over(whole))
        .groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n_conditions"), F.avg("auroc").alias("mean_auroc"),
             worst.alias("w"), F.max("clean_auroc").alias("clean_auroc"))
        .select("part", "n_conditions", "mean_auroc", F.col("w.key").alias("worst_key"),
                F.col("w.severity").alias("worst_severity"),
                F.col("w.auroc").alias("worst_auroc"),
                (F.col("clean_auroc") - F.col("w.auroc")).alias("drop"))
    )


def group_vs_negatives(df: DataFrame, threshold: float, group: str = "grp",
                       keys: Sequence[str] = CELL, score: str = "s", truth: str = "y",
                       conditions: Sequence[Condition] | None = None) -> DataFrame:
    """Each positive group against *all* negatives of its condition, per condition.

    The negatives are ranked once per condition; a group's positives meet them
    by equal score, so negatives are never copied per group.
    """
    keys = _by(keys, conditions)
    lad = score_ladder(df, keys, score, truth).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("score").alias("_score"),
        (F.col("n_neg") - F.col("fp")).alias("below"), F.col("neg").alias("tied"), "n_neg")
    pos = score_counts(df.where(F.col(truth) == 1), [*keys, group], score, truth)
    cond = F.col("score") == F.col("_score")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    wins = F.col("pos").cast("double") * (
        F.lit(2) * F.col("below") + F.col("tied")).cast("double")
    out = pos.join(lad, cond).groupBy(*keys, group).agg(
        F.sum("pos").alias("n"),
        ratio(F.sum(wins), F.sum("pos") * F.max("n_neg") * 2.0).alias("auroc"),
        ratio(F.sum(F.when(F.col("score") >= threshold, F.col("pos")).otherwise(0)),
              F.sum("pos")).alias("recall"))
    return _named(out, conditions)


def group_means(per_condition: DataFrame, group: str = "grp") -> DataFrame:
    return per_condition.groupBy(group).agg(
        F.max("n").alias("n"), F.avg("auroc").alias("mean_auroc"),
        F.avg("recall").alias("mean_recall"))


def flag_rates(df: DataFrame, threshold: float, platt_a: float = 1.0, platt_b: float = 0.0,
               keys: Sequence[str] = CELL, score: str = "s", truth: str = "y",
               conditions: Sequence[Condition] | None = None) -> DataFrame:
    """For a class never trained on: recall, FPR, AUROC, mean probability per condition."""
    keys = _by(keys, conditions)
    lad = score_ladder(df, keys, score, truth)
    thr = F.lit(float(threshold))
    prob = sigmoid(F.col("score") * platt_a + platt_b)
    out = lad.groupBy(*keys).agg(
        ratio(flagged_fold("pos", thr), F.max("n_pos")).alias("recall"),
        ratio(flagged_fold("neg", thr), F.max("n_neg")).alias("fpr"),
        auc_fold().alias("auroc"),
        ratio(F.sum(prob * F.col("pos")), F.max("n_pos")).alias("mean_prob"))
    return _named(out, conditions)


def sweep_cells(df: DataFrame, threshold: float, conditions: Sequence[Condition],
                score: str = "s", truth: str = "y") -> DataFrame:
    """Metric row per cell with deltas against the clean cell, 6 places, NULL if undefined.

    A cell where nothing could be scored still has its row, with n = 0.
    """
    metrics = metrics_from_ladder(
        score_ladder(df, ["cell"], score, truth), threshold, ["cell"])
    asked = df.sparkSession.range(len(conditions)).select(F.col("id").cast("int").alias("cell"))
    full = asked.join(metrics, "cell", "left").fillna(
        0, ["n", "n_real", "n_ai", "tp", "fp", "tn", "fn"]).fillna(
        float(threshold), ["threshold"])
    full = named_cells(full, conditions)
    whole = Window.partitionBy(F.lit(1))          # one row per cell of the grid
    for name, col in (("accuracy", "accuracy"), ("auc", "auc")):
        base = F.max(F.when(F.col("key") == "clean", F.col(col))).over(whole)
        full = full.withColumn(f"delta_{name}", F.round(F.col(col) - base, 6))
    return full


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Worst cell and mean accuracy change over the cells that could be scored."""
    base = F.max(F.when(F.col("key") == "clean", F.col("accuracy"))).over(
        Window.partitionBy(F.lit(1)))
    rows = cells.withColumn("change", F.col("accuracy") - base).where(F.col("key") != "clean")
    worst = F.min(F.when(F.col("change").isNotNull(), F.struct("change", "key", "severity")))
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("cells"), F.count("change").alias("scored_cells"),
        F.avg("change").alias("mean_drop"), worst.alias("w")
    ).select("cells", "scored_cells", "mean_drop", F.col("w.key").alias("worst_key"),
             F.col("w.severity").alias("worst_severity"),
             F.col("w.change").alias("worst_drop"))


def view_metrics(df: DataFrame, view: str = "view_id", clean_view: int | str = 0,
                 score: str = "s", truth: str = "y") -> DataFrame:
    """Clean, mean, worst and pooled AUC over views, and pooled FPR at 95% TPR.

    Rows are counted per view and score once; the pooled counts are sums of those, so
    one ladder serves both and the rows are read once.
    """
    counts = score_counts(df, [view], score, truth)
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    kind = df.schema[view].dataType
    both = counts.select(F.lit(False).alias("pooled"), F.col(view).alias("subset"), "score", "pos",
                         "neg").unionByName(pooled.select(
        F.lit(True).alias("pooled"), F.lit(None).cast(kind).alias("subset"), "score", "pos", "neg"))
    fold = ladder_from_counts(both, ["pooled", "subset"]).groupBy("pooled", "subset").agg(
        auc_fold().alias("auc"), quantile_of("pos", 0.05).alias("at"),
        F.max("n_neg").alias("n_neg"))
    one_view = F.when(~F.col("pooled"), F.col("auc"))
    whole = F.col("pooled")
    summary = fold.groupBy().agg(
        F.max(F.when(F.col("subset") == clean_view, one_view)).alias("auc_clean"),
        F.avg(one_view).alias("auc_mean"), F.min(one_view).alias("auc_worst"),
        F.max(F.when(whole, F.col("auc"))).alias("auc_pooled"),
        F.max(F.when(whole, F.col("at"))).alias("at"),
        F.max(F.when(whole, F.col("n_neg"))).alias("n_neg"))
    return counts_above(counts, summary, [F.col("at")]).select(
        "auc_clean", "auc_mean", "auc_worst", "auc_pooled",
        F.when(F.col("at").isNotNull(), ratio(F.col("fps")[0], F.col("n_neg")))
        .alias("fpr95_pooled"))


def threshold_diagnostic(deployed: DataFrame, best: DataFrame,
                         keys: Sequence[str] = (), gap: float = 0.05) -> DataFrame:
    """Best achievable against deployed balanced accuracy; a wide gap means a mis-set threshold."""
    both = attach_per_key(
        deployed.select(*keys, F.col("threshold").alias("deployed_threshold"),
                        F.col("balanced_accuracy").alias("deployed_balanced")),
        best.select(*keys, F.col("threshold").alias("swept_threshold"),
                    F.col("value").alias("swept_balanced")), keys)
    diff = F.col("swept_balanced") - F.col("deployed_balanced")
    return both.select("*", diff.alias("gap"), (diff > gap).alias("mis_set"))


def mean_scores(df: DataFrame, keys: Sequence[str] = CELL, score: str = "s",
                truth: str = "y") -> DataFrame:
    """Mean score per class and condition: one partial aggregate, no ladder."""
    s, y = nan_to_null(F.col(score)), F.col(truth)
    return df.groupBy(*keys).agg(F.avg(F.when(y == 0, s)).alias("score_mean_real"),
                                 F.avg(F.when(y == 1, s)).alias("score_mean_fake"))


def transfer_gap(reference: DataFrame, probe: DataFrame, threshold: float, score: str = "s",
                 truth: str = "y") -> DataFrame:
    """Recall of two score sets at one threshold and their difference."""
    def recall(df: DataFrame, name: str) -> DataFrame:
        hit = (nan_to_null(F.col(score)) >= threshold).cast("int")
        return df.where(F.col(truth) == 1).groupBy().agg(F.avg(hit).alias(name))
    both = attach_per_key(recall(reference, "recall_reference"), recall(probe, "recall_probe"), [])
    return both.withColumn("gap", F.col("recall_reference") - F.col("recall_probe"))
