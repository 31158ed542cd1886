"""Writers for predictions, reports, layouts and histories.

Large results are written by the executors as a directory of part files;
overwriting makes a rerun safe. Reports and lists that others read as one file are
assembled from parts when the job commits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.operators.ranks import ranked, stored
from verigauge.sinks.one_file import write_csv_file, write_json_list


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, or one JSON list where the path ends with ``.json``; NULL fields are written, so that a failed item still shows its verdict as null."""
    if path.lower().endswith(".json") and mode == "overwrite":
        write_json_list(df, path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one file where the path ends with ``.csv``; NULLs are blank."""
    if path.lower().endswith(".csv") and mode == "overwrite":
        write_csv_file(df, path)
    else:
        df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (),
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_recommendations(points: DataFrame, path: str) -> None:
    write_json(points.withColumn("threshold", F.round("threshold", 6)), path)


def layout_rows(df: DataFrame, path: Column, split: str = "split", label: str = "y",
                group: str = "grp") -> DataFrame:
    """Where each item goes: ``split/class/group/name``. Pointers, the files stay put.

    Names may repeat below one folder; ``same_name`` counts the items that have a target, and
    all but the one with the first path get a number before the name. The rows are numbered by ranges
    and stored below ``spark.checkpoint.dir``; ``df`` is read once.
    """
    cls = F.when(F.col(label) == 1, "fake").otherwise("real")
    name = F.substring_index(path, "/", -1)
    rows = df.select(path.alias("source"), F.col(split).alias("split"), cls.alias("class"),
                     F.coalesce(F.col(group).cast("string"), F.concat(cls, F.lit("_root")))
                     .alias("grp"), name.alias("name"))
    place = F.concat_ws("/", "split", "class", "grp", "name")
    # a name such as image.jpg may be most of a folder: no window over one target
    named = ranked(stored(rows.withColumn("_at", place), "layout"), ["_at"], ["source"], "_turn", "same_name")
    return named.withColumn("target", F.when(F.col("_turn") == 0, F.col("_at")).otherwise(F.concat_ws(
        "/", "split", "class", "grp", F.concat_ws("_", F.col("_turn").cast("string"), "name")))).drop("_turn", "_at")


def write_layout(rows: DataFrame, path: str) -> None:
    """The layout as a partitioned table; writing the same split again changes nothing."""
    write_parquet(rows, path, ["split", "class", "grp"])


def append_history(rows: DataFrame, path: str) -> None:
    write_parquet(rows, path, mode="append")
