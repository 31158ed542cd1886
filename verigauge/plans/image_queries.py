"""Image grid queries over small pictures made from the embeddings table.

Each embedding becomes an 8 x 8 picture: its 64 numbers are the red channel, and
the other two are made from them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from verigauge.operators import grids as G
from verigauge.operators import images as I
from verigauge.operators import heads as H
from verigauge.operators.conditions import Condition, expand_conditions, named_cells, sweep_cells
from verigauge.plans import fixtures as X
from verigauge.plans import picture_twins as T
from verigauge.plans.metric_queries import AUC_SQL
from verigauge.plans.registry import query, r6

SIDE = 8


def spread(spark) -> int:
    """The table is one small file; pictures are dealt out to one task per core."""
    return spark.sparkContext.defaultParallelism


def pictures(spark, sf):
    def byte(x):
        level = F.least(F.greatest(F.floor(x * 300.0 + 128.0), F.lit(0)), F.lit(255))
        return F.lpad(F.hex(level.cast("bigint")), 2, "0")
    v = F.col("embedding").cast("array<double>")
    hexes = F.transform(v, lambda x: F.concat(byte(x), byte(-x), byte(x * 0.5)))
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), (F.col("label") >= 5).cast("int").alias("y"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.unhex(F.array_join(hexes, "")).alias("pixels"))


class MeanRed(I.ImageScorer):
    """Mean of the red channel as a score."""

    name = "mean_red"
    display_name = "Mean red"
    batch_size = 64

    def predict_images(self, images):
        return [float(im[..., 0].mean()) / 255.0 for im in images]


def rates_sql(conditions) -> str:
    cells = ", ".join(f"('{c.key}', '{c.family}', {c.severity})" for c in conditions)
    return f"""WITH {X.E_SQL}, g AS (SELECT c.*, e.y, e.s * (1.0::DOUBLE - severity / 20.0::DOUBLE) AS s
    FROM e, (VALUES {cells}) c(key, family, severity))
SELECT key, family, severity, count(*)::BIGINT AS n, count(*) FILTER (WHERE s >= 0.1)::BIGINT AS flagged,
    count(*) FILTER (WHERE s >= 0.1 AND y = 1)::BIGINT AS hits, round(avg(s), 6) AS mean_score
FROM g GROUP BY key, family, severity"""


def grid_rates(spark, sf, conditions):
    """Scored events under every cell of a grid; the score fades with the severity."""
    rows = expand_conditions(X.scored_events(spark, sf), conditions).withColumn(
        "s", F.col("s") * (F.lit(1.0) - F.col("severity") / 20.0))
    hit = F.col("s") >= 0.1
    per = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("flagged"),
        F.count(F.when(hit & (F.col("y") == 1), 1)).alias("hits"), F.avg("s").alias("mean_score"))
    return r6(named_cells(per, conditions).drop("label"))


def grid_sql(conditions) -> str:
    cells = ", ".join(f"('{c.key}', '{c.family}', {c.severity}, {'true' if 'webp' in c.key else 'false'})" for c in conditions)
    return f"""WITH rates AS ({rates_sql(conditions)}),
shown AS (SELECT key, family, severity, count(*)::BIGINT AS pictures, count(*) FILTER (WHERE NOT lost)::BIGINT AS scored,
    count(*) FILTER (WHERE lost)::BIGINT AS failed
    FROM embeddings, (VALUES {cells}) c(key, family, severity, lost) GROUP BY key, family, severity)
SELECT key, family, severity, n, flagged, hits, mean_score, pictures, scored, failed FROM rates FULL JOIN shown USING (key, family, severity)"""


def grid_whole(spark, sf, conditions):
    """Every picture degraded by every cell's kernels and scored, next to the rates of scored events in that cell.

    A cell without an encoder counts its pictures as failed.
    """
    rows = I.score_grid(pictures(spark, sf), conditions, MeanRed(), spread=spread(spark))
    per = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("pictures"), F.count("s").alias("scored"), F.count("error").alias("failed"))
    shown = named_cells(per, conditions).drop("label")
    return grid_rates(spark, sf, conditions).join(shown, ["key", "family", "severity"], "full")


@query("d2_graded_grid", grid_sql(G.graded_grid()))
def d2(spark, sf):
    return grid_whole(spark, sf, G.graded_grid())


@query("d3_official_grid", grid_sql(G.official_grid()))
def d3(spark, sf):
    return grid_whole(spark, sf, G.official_grid())


@query("d4_evaluation_grid", grid_sql(G.all_conditions()))
def d4(spark, sf):
    return grid_whole(spark, sf, G.all_conditions())


RED = "floor(least(greatest(x * 300.0::DOUBLE + 128.0::DOUBLE, 0), 255))"


@query("d1_clean_scores", f"""SELECT vec_id AS item_id, round(list_avg(list_transform(
    embedding::DOUBLE[], lambda x: least(greatest(floor(x * 300.0::DOUBLE + 128.0::DOUBLE), 0),
    255))) / 255.0::DOUBLE, 6) AS s FROM embeddings""")
def d1(spark, sf):
    return I.score_grid(pictures(spark, sf), [G.CLEAN], MeanRed()).select("item_id", "s")


@query("d5_brightness_pixels", """SELECT vec_id AS item_id, list_sum(list_transform(
    embedding::DOUBLE[], lambda x: least(255, round_even(least(greatest(floor(x * 300.0::DOUBLE
    + 128.0::DOUBLE), 0), 255) * 1.5::DOUBLE, 0))))::BIGINT AS red_sum FROM embeddings""")
def d5(spark, sf):
    from verigauge.functions import kernels as K

    class Sum(MeanRed):
        def prepare_source(self, img):
            return K.brightness(img, 1.5)

        def predict_images(self, images):
            return [float(im[..., 0].astype(np.int64).sum()) for im in images]

    rows = I.score_grid(pictures(spark, sf), [G.CLEAN], Sum())
    return rows.select("item_id", F.col("s").cast("bigint").alias("red_sum"))


@query("d8_random_views", """SELECT view_id::INTEGER AS view_id, count(*)::BIGINT AS n,
    (CASE WHEN view_id = 0 THEN count(*) ELSE 0 END)::BIGINT AS always_clean,
    count(*)::BIGINT AS at_most_three, count(*)::BIGINT AS in_range
FROM embeddings, range(0, 6) v(view_id) GROUP BY view_id""")
def d8(spark, sf):
    views = I.random_views(pictures(spark, sf).drop("pixels"), 6)
    ops = F.array_distinct(F.transform(F.map_keys("steps"),
                                       lambda k: F.substring_index(k, "_", 1)))
    bounds = F.lit(True)
    for op, (lo, hi) in I.TRAIN_RANGES.items():
        for name in (["color_b", "color_c", "color_s"] if op == "color" else [op]):
            bounds = bounds & F.coalesce(
                F.try_element_at("steps", F.lit(name)).between(lo, hi), F.lit(True))
    # only view 0 has to be clean; other views may be by chance
    clean = (F.col("view_id") == 0) & (F.size("steps") == 0)
    return views.groupBy("view_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(clean, 1)).alias("always_clean"),
        F.count(F.when(F.size(ops) <= I.MAX_OPS, 1)).alias("at_most_three"),
        F.count(F.when(bounds, 1)).alias("in_range"))


@query("d10_geometry", """SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS inside,
    count(*)::BIGINT AS in_range FROM documents""")
def d10(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), (F.col("n_chars") + 1).cast("int").alias("width"),
        (F.col("n_chars") % 997 + 1).cast("int").alias("height"))
    g = I.geometry_columns(docs)
    inside = ((F.col("crop_left") >= 0) & (F.col("crop_top") >= 0)
              & (F.col("crop_left") + F.col("crop_side") <= F.col("width"))
              & (F.col("crop_top") + F.col("crop_side") <= F.col("height")))
    return g.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("inside"),
        F.count(F.when(F.col("target_side").between(384, 1024), 1)).alias("in_range"))


def views_sql(n: int) -> str:
    return f"""v AS (SELECT vec_id AS item_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, i AS view_id,
    list_transform(embedding::DOUBLE[], lambda x: x * (1.0::DOUBLE - i / 8.0::DOUBLE)) AS v
    FROM embeddings, range(0, {n}) r(i))"""


def faded_views(spark, sf, n: int):
    """Each vector in n views that fade step by step."""
    rows = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return H.scaled_views(rows, "v", [1.0 - i / 8.0 for i in range(n)])


@query("d11_view_features", f"""WITH {views_sql(4)} SELECT view_id::INTEGER AS view_id, count(*)::BIGINT AS n, max(len(v))::INTEGER AS dim,
    round(avg(list_sum(list_transform(v, lambda x: x * x))), 6) AS power,
    count(*)::BIGINT AS featured, 3::INTEGER AS feature_dim FROM v GROUP BY view_id""")
def d11(spark, sf):
    """Random views of every picture, from the source loss over the drawn chain to an encoder's features, next to the faded views of its vector."""
    power = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    faded = faded_views(spark, sf, 4).groupBy("view_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.avg(power).alias("power"))
    views = I.random_views(pictures(spark, sf).repartition(spread(spark), "item_id"), 4)
    shown = I.view_features(views, lambda t: t.mean(axis=(1, 2)), side=SIDE).groupBy("view_id").agg(
        F.count("feature").alias("featured"), F.max(F.size("feature")).alias("feature_dim"))
    return r6(faded.join(shown, "view_id", "full"))


def sweep_sql(conditions, views: int) -> str:
    """The figures of every cell and faded view; ``near``, but no figure, for the cells that have no twin."""
    means, without = T.red_means(conditions)
    level = "least(greatest(floor({} * 300.0::DOUBLE + 128.0::DOUBLE), 0), 255)"
    plane = "list_transform(range(0, 8), lambda i: list_transform(range(0, 8), lambda j: {}))"
    r, g, b = (plane.format(level.format(x.format("e[i * 8 + j + 1]"))) for x in ("{}", "(-{})", "({} * 0.5::DOUBLE)"))
    cells = ", ".join(f"('{c.key}', {c.severity})" for c in without)
    return f"""WITH {views_sql(views)}, em AS (SELECT CASE WHEN label >= 5 THEN 1 WHEN label < 5 THEN 0 END AS y, embedding::DOUBLE[] AS e FROM embeddings),
px AS (SELECT y, {r} AS r, {g} AS g, {b} AS b FROM em),
t AS ({means}
UNION ALL SELECT 'faded' AS key, view_id AS severity, y, 0.5::DOUBLE + v[1] AS s FROM v),
{X.ladder_sql('t', 'key, severity')},
m AS (SELECT key, severity, max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg, round({AUC_SQL}, 6) AS auc FROM lad GROUP BY key, severity),
h AS (SELECT key, severity, round(avg(CASE WHEN (s >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
    FROM t WHERE y IS NOT NULL GROUP BY key, severity),
clean AS (SELECT auc AS base FROM m WHERE key = 'clean')
SELECT m.key, m.severity::INTEGER AS severity, n_pos, n_neg, accuracy,
    CASE WHEN m.key IN ('clean', 'faded') THEN auc ELSE round(auc, 3) END AS auc, abs(auc - base) <= 0.1 AS near
FROM m JOIN h ON m.key = h.key AND m.severity = h.severity CROSS JOIN clean
UNION ALL SELECT c.key, c.severity::INTEGER, n_pos, n_neg, NULL::DOUBLE, NULL::DOUBLE, true
FROM m, (VALUES {cells}) c(key, severity) WHERE m.key = 'clean'"""


@query("d13_image_sweep", sweep_sql(G.official_grid(), 5))
def d13(spark, sf):
    """A sweep over all cells of the official grid, each picture through its kernels, and over the faded views of its vector, from one ladder.

    A pixel that a kernel puts halfway between two bytes goes with the order of additions, so AUC has 3 places there. Noise and colour
    have no SQL twin: of their figures the query says whether the ranking is near that of the clean pictures.
    """
    grid = G.official_grid()
    views = [Condition("faded", "faded", i, f"faded {i}") for i in range(5)]
    scored = I.score_grid(pictures(spark, sf), grid, MeanRed(), keep=["y"], spread=spread(spark)).select("cell", "y", "s")
    faded = faded_views(spark, sf, 5).select((F.col("view_id") + len(grid)).alias("cell"), "y", (F.lit(0.5) + F.col("v")[0]).alias("s"))
    cells = sweep_cells(scored.unionByName(faded), 0.5, grid + views)
    told = ~F.col("key").isin([c.key for c in T.red_means(grid)[1]])
    return r6(cells.select(
        "key", "severity", F.col("n_ai").alias("n_pos"), F.col("n_real").alias("n_neg"), F.when(told, F.col("accuracy")).alias("accuracy"),
        F.when(F.col("key").isin("clean", "faded"), F.col("auc")).when(told, F.round("auc", 3)).alias("auc"), (F.abs("delta_auc") <= 0.1).alias("near")))


@query("d15_edited_fraction", """SELECT vec_id AS item_id, round(len(list_filter(
    embedding::DOUBLE[], lambda x: least(greatest(floor(x * 300.0::DOUBLE + 128.0::DOUBLE), 0),
    255) > 127)) / 64.0::DOUBLE, 6) AS fraction FROM embeddings""")
def d15(spark, sf):
    level = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lpad(F.hex(F.least(
        F.greatest(F.floor(x * 300.0 + 128.0), F.lit(0)), F.lit(255)).cast("bigint")), 2, "0"))
    masks = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.unhex(F.array_join(level, "")).alias("mask"))
    return r6(I.edited_fraction(I.geometry_columns(masks, lo=SIDE, hi=SIDE)))


@query("e3_view_averaging", f"""WITH {views_sql(4)} SELECT item_id, round(avg(0.5::DOUBLE + v[1]), 6) AS p, count(*)::BIGINT AS views
FROM v GROUP BY item_id""")
def e3(spark, sf):
    rows = faded_views(spark, sf, 4).select("item_id", (F.lit(0.5) + F.col("v")[0]).alias("p"))
    return r6(H.pool_views(rows, ["item_id"]))
