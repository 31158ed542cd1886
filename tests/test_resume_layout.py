"""Resuming by item, and targets of equal names."""

import collections

from pyspark.sql import functions as F

from verigauge.operators.heads import Head
from verigauge.operators.ranks import ranked
from verigauge.operators.scoring import Scorer, VectorHeadScorer
from verigauge.sinks.writers import layout_rows
from verigauge.streaming import incremental as IN

SCHEMA = "item string, v array<double>, file int"
HEAD = Head(weights=[1.0, -1.0], bias=0.0, mu=[0.0, 0.0], sd=[1.0, 1.0])


def run(spark, where, rows, scorer=None):
    if rows:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
    IN.score_new_items(spark, f"{where}/in", SCHEMA, scorer or VectorHeadScorer(HEAD), ["item", "file"], f"{where}/out",
                       f"{where}/progress", "item", files_per_batch=1).awaitTermination()
    return collections.Counter((r.item, r.file) for r in spark.read.parquet(f"{where}/out").collect())


def test_an_item_is_scored_once(spark, tmp_path):
    where = str(tmp_path)
    first = run(spark, where, [("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1), ("b", [5.0, 1.0], 1), (None, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (None, [2.0, 1.0], 1)])
    assert first == collections.Counter({("a", 1): 1, ("b", 1): 1, (None, 1): 2})
    # the same ids in another file, a new one, and an id that looks like the key of a row without one
    second = run(spark, where, [("a", [9.0, 9.0], 2), ("b", [0.0, 1.0], 2), ("c", None, 2), ("row 1", [1.0, 1.0], 2)])
    assert second == first + collections.Counter({("c", 2): 1, ("row 1", 2): 1})
    # nothing new; then an item whose score failed does not come again
    assert run(spark, where, []) == second
    assert run(spark, where, [("c", [1.0, 1.0], 3)]) == second


class Counting(Scorer):
    name = "counting"

    def predict_batch(self, rows):
        return [1.0] * len(rows)


def test_seen_items_do_not_reach_the_scorer(spark, tmp_path):
    where = str(tmp_path)
    rows = [(f"i{k % 50}", [float(k), 0.0], k // 50) for k in range(200)]
    for k in range(4):
        out = run(spark, where, [r for r in rows if r[2] == k], Counting())
    assert out == collections.Counter({(f"i{k}", 0): 1 for k in range(50)})


def test_hot_target_names(spark):
    rows = [(f"d{k}/image.jpg" if k % 3 == 0 else f"d{k}/{k % 40}.jpg", 1, "train", "g") for k in range(3000)] + [("x/y.jpg", 0, "val", None)]
    df = spark.createDataFrame(rows, "path string, y int, split string, grp string")
    got = layout_rows(df, F.col("path")).collect()
    assert len({r.target for r in got}) == len(rows)
    by_place = collections.defaultdict(list)
    for path, y, split, grp in rows:
        cls = "fake" if y else "real"
        by_place[split, cls, grp or f"{cls}_root", path.rsplit("/", 1)[1]].append(path)
    want = {}
    for (split, cls, grp, name), paths in by_place.items():
        for turn, path in enumerate(sorted(paths)):
            want[path] = (f"{split}/{cls}/{grp}/" + (f"{turn}_{name}" if turn else name), len(paths))
    assert {r.source: (r.target, r.same_name) for r in got} == want


def test_no_task_gets_a_whole_group(spark):
    """Ranks of one hot group of equal rows: the rows lie in many partitions."""
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), F.lit(1).alias("o"))
    out = ranked(df, ["g"], ["o"])
    assert out.groupBy("g").agg(F.countDistinct("position").alias("n"), F.max("position").alias("m"), F.max("size").alias("s")).where(
        "n <> m + 1 OR s <> n").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranked(df, ["g"], ["o"]).inputFiles()
        sizes = [spark.read.parquet(p).where("g = 'hot'").count() for p in parts]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(n > 0 for n in sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_ranks_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "g string, o int"), ["g"], ["o"]).count() == 0
