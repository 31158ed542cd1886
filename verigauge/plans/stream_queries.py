"""The incremental scorer over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.operators.scalars import attach_row
from verigauge.operators.scoring import VectorHeadScorer
from verigauge.plans import fixtures as X
from verigauge.plans.registry import query, r6
from verigauge.plans.vector_queries import HEADS, V_SQL, logit_sql, prob_sql
from verigauge.session import shared_folder
from verigauge.streaming import incremental as IN


@query("t1_incremental_scores", f"""WITH {V_SQL}, z AS (SELECT item_id, {logit_sql(HEADS[0])} AS q
    FROM u) SELECT item_id AS vec_id, round({prob_sql(HEADS[0], 'q')}, 6) AS score FROM z""")
def t1(spark, sf):
    """Two runs over the same input: the second one finds nothing new."""
    work = shared_folder(spark, "stream")
    table = X.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    table.write.parquet(f"{work}/in")
    for _ in range(2):
        IN.score_new_files(spark, f"{work}/in", table.schema, VectorHeadScorer(HEADS[0]),
                           ["vec_id"], f"{work}/out", f"{work}/progress").awaitTermination()
    return r6(spark.read.parquet(f"{work}/out").select("vec_id", "score"))


@query("t1_incremental_items", f"""WITH {V_SQL}, z AS (SELECT item_id, {logit_sql(HEADS[0])} AS q
    FROM u), m AS (SELECT min(item_id) AS least FROM u)
SELECT item_id AS vec_id, round({prob_sql(HEADS[0], 'q')}, 6) AS score, 1::BIGINT AS times,
    CASE WHEN (item_id - least) % 3 = 2 THEN 2 ELSE 1 END AS run FROM z, m""")
def t1_items(spark, sf):
    """Two file sets that share a third of the ids, and a third run over the first one again: every id once, in its first run."""
    work = shared_folder(spark, "stream")
    rows = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = attach_row(rows, rows.agg(F.min("vec_id").alias("least"))).withColumn("third", (F.col("vec_id") - F.col("least")) % 3).drop("least")
    parts = [rows.where("third < 2"), rows.where("third > 0"), rows.where("third < 2")]
    for i, part in enumerate(parts):
        part.select("vec_id", "v", F.lit(i + 1).alias("run")).write.mode("append").parquet(f"{work}/in")
        IN.score_new_items(spark, f"{work}/in", "vec_id long, v array<double>, run int", VectorHeadScorer(HEADS[0]),
                           ["vec_id", "run"], f"{work}/out", f"{work}/progress", "vec_id").awaitTermination()
    found = spark.read.parquet(f"{work}/out").groupBy("vec_id").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("times"), F.max("run").alias("run"))
    return r6(found)
