"""Round trips through files: what the sinks write of the tables, the sources read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.operators import results as R
from verigauge.operators.ranks import ranked
from verigauge.plans import fixtures as X
from verigauge.plans.registry import query, r6
from verigauge.session import shared_folder
from verigauge.sinks import writers as W
from verigauge.sources import files as FS


def numbered(path):
    """The number in a file name."""
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]+$", 1).cast("bigint")


@query("s4_json_manifest", "SELECT doc_id, toxic::BIGINT AS label, row_number() OVER (ORDER BY doc_id) AS place FROM labels")
def s4(spark, sf):
    """A manifest as one JSON list, read by many tasks in its order."""
    work = shared_folder(spark, "manifest")
    rows = X.table(spark, sf, "labels").orderBy("doc_id").select(
        F.concat(F.lit('a "set" {of}/'), "doc_id", F.lit(".txt")).alias("path"), F.col("toxic").alias("label"))
    W.write_json(rows, f"{work}/labels.json")
    back = FS.read_manifest(spark, f"{work}/labels.json")
    rows = back.select(numbered("path").alias("doc_id"), F.col("label").cast("bigint").alias("label"), "row_no", F.lit(1).alias("all"))
    return ranked(rows, ["all"], ["row_no"], "before").select("doc_id", "label", (F.col("before") + 1).alias("place"))


@query("s6_labelled_csv", "SELECT doc_id, toxic AS label FROM labels")
def s6(spark, sf):
    work = shared_folder(spark, "csv")
    rows = X.table(spark, sf, "labels").select(F.concat("doc_id", F.lit(", \"x\".txt")).alias("file_name"), F.col("toxic").alias("label"))
    W.write_csv(rows, f"{work}/labels.csv")
    return FS.read_labelled_csv(spark, f"{work}/labels.csv").select(
        F.regexp_extract("file_name", "^([0-9]+)", 1).cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))


@query("s7_tsv_shards", "SELECT event_id, event_type, user_id FROM events")
def s7(spark, sf):
    work = shared_folder(spark, "shards")
    X.table(spark, sf, "events").select("event_id", "event_type", "user_id").repartition(4).write.option("sep", "\t").option("header", True).csv(work)
    return FS.read_tsv_shards(spark, work, "part-*").select(
        F.col("event_id").cast("bigint").alias("event_id"), "event_type", F.col("user_id").cast("bigint").alias("user_id"))


@query("s8_predictions_file", f"WITH {X.D_SQL} SELECT item_id, round(s, 6) AS score, coalesce(y, -1)::INTEGER AS label FROM d")
def s8(spark, sf):
    """Predictions as one JSON list; the labels are read off the paths again."""
    work = shared_folder(spark, "predictions")
    rows = X.partly_labelled(spark, sf).select(
        F.concat(F.lit("/set/"), F.when(F.col("y") == 1, "fake/").when(F.col("y") == 0, "real/").otherwise("x/"), "item_id", F.lit(".jpg")).alias("path"),
        F.round("s", 6).alias("score"))
    W.write_json(R.predictions(rows, 0.5, "path", "score"), f"{work}/predictions.json")
    back = FS.read_predictions(spark, f"{work}/predictions.json")
    return r6(back.select(numbered("path").alias("item_id"), "score", F.coalesce("label", F.lit(-1)).cast("int").alias("label")))


@query("k9_history", """SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS runs
FROM events GROUP BY event_type""")
def k9(spark, sf):
    """Two runs append their rows to one history."""
    work = shared_folder(spark, "history")
    rows = X.table(spark, sf, "events").withColumn("run", (F.col("value") > 100).cast("int"))
    for run in (0, 1):
        W.append_history(rows.where(F.col("run") == run).groupBy("event_type", "run").agg(F.count(F.lit(1)).alias("n")), work)
    return spark.read.parquet(work).groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"))
