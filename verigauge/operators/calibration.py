"""How far stated probabilities are from observed rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.functions.numeric import grid_bin, nan_to_null, ratio, sigmoid


def expected_calibration_error(df: DataFrame, prob: str = "p", truth: str = "y",
                               keys: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Sum over equal bins of share * |mean probability - positive rate|."""
    p = nan_to_null(F.col(prob))
    cells = (
        df.select(*keys, p.alias("p"), F.col(truth).cast("int").alias("y"))
        .where(F.col("p").isNotNull() & F.col("y").isNotNull())
        .groupBy(*keys, F.least(grid_bin(F.col("p"), bins), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y")))
    return cells.groupBy(*keys).agg(
        ratio(F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))), F.sum("n")).alias("ece"))


def calibration_table(df: DataFrame, platt_a: float, platt_b: float,
                      keys: Sequence[str] = (), score: str = "s", truth: str = "y",
                      bins: int = 15) -> DataFrame:
    """ECE before and after Platt scaling and the mean calibrated probability per class.

    Both probabilities of a row are counted in one pass.
    """
    s = nan_to_null(F.col(score))
    both = F.array(
        F.struct(F.lit(False).alias("calibrated"), sigmoid(F.col("s")).alias("p")),
        F.struct(F.lit(True).alias("calibrated"),
                 sigmoid(F.col("s") * platt_a + platt_b).alias("p")))
    rows = (df.select(*keys, s.alias("s"), F.col(truth).cast("int").alias("y"))
            .where(F.col("s").isNotNull() & F.col("y").isNotNull())
            .select(*keys, "y", F.inline(both)))
    cells = rows.groupBy(
        *keys, "calibrated",
        F.least(grid_bin(F.col("p"), bins), F.lit(bins - 1)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"),
          F.sum(F.when(F.col("y") == 1, F.col("p"))).alias("sum_ai"),
          F.sum(F.when(F.col("y") == 0, F.col("p"))).alias("sum_real"))
    cal = F.col("calibrated")
    off = F.abs(F.col("sum_p") - F.col("sum_y"))
    n = F.sum(F.when(cal, F.col("n")))
    n_ai = F.sum(F.when(cal, F.col("sum_y")))
    return cells.groupBy(*keys).agg(
        ratio(F.sum(F.when(~cal, off)), n).alias("ece_raw"),
        ratio(F.sum(F.when(cal, off)), n).alias("ece_calibrated"),
        ratio(F.sum(F.when(cal, F.col("sum_real"))), n - n_ai).alias("mean_prob_real"),
        ratio(F.sum(F.when(cal, F.col("sum_ai"))), n_ai).alias("mean_prob_fake"))
