"""Result tables: predictions, reports, ranked errors and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions import labels as N
from verigauge.functions.numeric import nan_to_null, sigmoid
from verigauge.operators.sampling import top_per_group

FAILED_SCORE = 0.5


def predictions(df: DataFrame, threshold: float, path: str = "path",
                score: str = "s") -> DataFrame:
    """``image_path, pred, prediction``: a failed item keeps its row but gets no verdict."""
    s = nan_to_null(F.col(score))
    return df.select(F.col(path).alias("image_path"),
                     F.coalesce(F.round(s, 6), F.lit(FAILED_SCORE)).alias("pred"),
                     N.verdict(s, threshold).alias("prediction"))


def predictions_table(df: DataFrame, threshold: float, path: str = "path", score: str = "s",
                      label: str = "y") -> DataFrame:
    """Spreadsheet form with correctness; NULL wherever the answer is unknown."""
    s, y = nan_to_null(F.col(score)), F.col(label).cast("int")
    pred = N.predicted(s, threshold)
    return df.select(F.col(path).alias("image_path"), F.round(s, 6).alias("pred"),
                     pred.alias("predicted_label"), y.alias("true_label"),
                     (pred == y).cast("int").alias("correct"))


def verdict_summary(df: DataFrame, threshold: float, score: str = "s") -> DataFrame:
    """Totals of fake, real and failed items."""
    v = N.verdict(F.col(score), threshold)
    return df.groupBy().agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(v == "fake", 1)).alias("fake"),
        F.count(F.when(v == "real", 1)).alias("real"),
        F.count(F.when(v.isNull(), 1)).alias("errors"))


def summary_text(metrics: DataFrame) -> DataFrame:
    """The metric row as display text; undefined values are a dash."""
    c = F.col
    return metrics.select(
        N.ratio_text(c("threshold")).alias("threshold"),
        N.percent_text(c("accuracy")).alias("accuracy"), N.ratio_text(c("auc")).alias("auc"),
        N.ratio_text(c("f1")).alias("f1"), N.percent_text(c("precision")).alias("precision"),
        N.percent_text(c("recall")).alias("recall"), N.percent_text(c("fpr")).alias("fpr"),
        F.format_string("TP %d  FP %d  TN %d  FN %d", c("tp"), c("fp"), c("tn"),
                        c("fn")).alias("counts"))


def errors(df: DataFrame, threshold: float, platt_a: float = 1.0, platt_b: float = 0.0,
           item: str = "item_id", score: str = "s", truth: str = "y") -> DataFrame:
    """Misclassified rows with probability and distance from the threshold."""
    s, y = nan_to_null(F.col(score)), F.col(truth).cast("int")
    pred = N.predicted(F.col("score"), threshold)
    return (
        df.select(item, y.alias("true"), s.alias("score"))
        .withColumn("pred", pred)
        .where(F.col("true") != F.col("pred"))
        .select(item, "true", "pred", "score",
                sigmoid(F.col("score") * platt_a + platt_b).alias("prob"),
                F.abs(F.col("score") - threshold).alias("confidence")))


def ranked_errors(errs: DataFrame, item: str = "item_id") -> DataFrame:
    """The whole error list, most confidently wrong first (a range-partitioned sort)."""
    return errs.orderBy(F.col("confidence").desc(), F.col(item))


def worst_errors(errs: DataFrame, cap: int, item: str = "item_id") -> DataFrame:
    """At most ``cap`` worst false positives and false negatives, ranked within their kind."""
    kind = F.when(F.col("true") == 0, "false_positives").otherwise("false_negatives")
    return top_per_group(errs.withColumn("kind", kind), ["kind"],
                         [F.col("confidence").desc(), F.col(item)], cap, rank="rank")


def top_negatives(df: DataFrame, k: int = 20, item: str = "item_id", score: str = "s",
                  truth: str = "y") -> DataFrame:
    """The k negatives with the highest scores."""
    s = nan_to_null(F.col(score))
    return (df.where((F.col(truth) == 0) & s.isNotNull()).select(item, s.alias("score"))
            .orderBy(F.col("score").desc(), F.col(item)).limit(k))


def result_view(df: DataFrame, threshold: float, kind: str = "all", item: str = "item_id",
                score: str = "s", truth: str = "y") -> DataFrame:
    """The sortable result table behind a filter; unknown scores sort as -1."""
    s, y = nan_to_null(F.col(score)), F.col(truth).cast("int")
    pred = N.predicted(s, threshold)
    return (
        df.where(N.result_filter(y, pred, kind))
        .select(item, F.coalesce(s, F.lit(-1.0)).alias("sort_score"),
                N.text_or_dash(4, s).alias("score_text"),
                N.label_text(y).alias("truth"), N.result_text(y, pred).alias("result"))
    )


def sorted_view(view: DataFrame, by: str = "sort_score", descending: bool = True,
                item: str = "item_id") -> DataFrame:
    key = F.col(by).desc() if descending else F.col(by).asc()
    return view.orderBy(key, F.col(item))


def run_report(balance: DataFrame, metrics: DataFrame, detector: str, root: str,
               label_source: str, threshold: float) -> DataFrame:
    """One nested row: data set composition, detector, run counts and metrics."""
    from verigauge.operators.scalars import attach_row

    m = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    return attach_row(balance, m).select(
        F.current_timestamp().alias("generated_at"),
        F.struct(F.lit(root).alias("root"), F.col("n").alias("n_images"), "n_real", "n_ai",
                 "n_unlabeled", F.lit(label_source).alias("label_source")).alias("dataset"),
        F.struct(F.lit(detector).alias("name")).alias("detector"),
        F.struct(F.col("n_scored").alias("images_scored"),
                 F.col("failures").alias("images_failed"),
                 F.lit(float(threshold)).alias("threshold")).alias("run"),
        "metrics")


def sweep_report(cells: DataFrame) -> DataFrame:
    """Cell rows in (key, severity) order with metrics and deltas; the clean row is the baseline.

    A grid has a few dozen cells, so the report is one nested row.
    """
    fields = [c for c in cells.columns
              if c not in ("key", "family", "severity", "label", "delta_accuracy", "delta_auc")]
    cell = F.struct(F.col("key").alias("transform"), "severity",
                    F.col("label").alias("severity_label"),
                    F.struct(*fields).alias("metrics"), "delta_accuracy", "delta_auc")
    clean: Column = F.col("key") == "clean"
    return cells.groupBy().agg(
        F.max("threshold").alias("threshold"),
        F.max(F.when(clean, F.col("n"))).alias("sample_size"),
        F.first(F.when(clean, F.struct(*fields)), ignorenulls=True).alias("baseline"),
        F.sort_array(F.collect_list(F.when(~clean, cell))).alias("cells"))
