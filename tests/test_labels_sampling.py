import numpy as np
import pytest
from pyspark.sql import functions as F

from verigauge.functions import labels as N
from verigauge.operators import audit as A
from verigauge.operators import conditions as D
from verigauge.operators import grids as G
from verigauge.operators import labelling as LB
from verigauge.operators import results as R
from verigauge.operators import sampling as S


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(
        "*", *[c.alias(k) for k, c in cols.items()]).collect()


def test_directory_and_filename_labels(spark):
    rows = one(spark, [
        ("real/ai/x.jpg",), ("AI /x.jpg",), ("a/b/x.jpg",), ("x.jpg",), ("fake/real.jpg",)],
        "p string", d=N.directory_label(F.col("p")))
    assert [r.d for r in rows] == [1, 1, None, None, 1]
    rows = one(spark, [("REAL_1.jpg",), ("ai-2.png",), ("sd_1.png",), ("xreal_1.png",)],
               "p string", f=N.filename_label(F.col("p")),
               g=N.filename_label(F.col("p"), r"sd_"), bad=N.filename_label(F.col("p"), "("))
    assert [r.f for r in rows] == [0, 1, None, None]
    assert [r.g for r in rows] == [None, None, 1, None]
    assert all(r.bad is None for r in rows)


def test_coerce_and_slug_and_text(spark):
    cells = ["1", " True ", "no", "0.83", "", None, "Fake", "camera"]
    rows = one(spark, [(c,) for c in cells], "c string", v=N.coerce_label(F.col("c")))
    assert [r.v for r in rows] == [1, 1, 0, None, None, None, 1, 0]
    rows = one(spark, [(0.83,), (0.49,), (None,)], "c double",
               v=N.coerce_label(F.col("c"), "double"))
    assert [r.v for r in rows] == [1, 0, None]
    rows = one(spark, [("DALL-E 3",), ("My Gen.v2",), ("--",), ("Midjourney v6",)], "c string",
               v=N.group_slug(F.col("c")))
    assert [r.v for r in rows] == ["DALLE3", "My_Gen_v2", "unknown", "MidJourney6"]
    rows = one(spark, [(0.12345,), (None,), (-0.031,)], "c double", p=N.percent_text(F.col("c")),
               r=N.ratio_text(F.col("c")), d=N.delta_text(F.col("c")))
    assert [r.p for r in rows] == ["12.3%", "—", "-3.1%"]
    assert rows[1].d == "—" and rows[2].d == "−3.1pp" and rows[0].d == "+12.3pp"


def test_manifest_precedence(spark):
    items = spark.createDataFrame(
        [("/d/a/x.jpg", "a/x.jpg"), ("/d/b/x.jpg", "b/x.jpg"), ("/d/c/y.jpg", "c/y.jpg"),
         ("/d/z.jpg", "z.jpg")], "path string, rel_path string")
    rows = spark.createDataFrame(
        [(0, "a/x.jpg", "real"), (1, "a/x.jpg", "ai"), (2, "other/x.jpg", "real"),
         (3, "/d/./c//y.jpg", "1"), (4, "elsewhere/y.jpg", "0"), (5, "z.jpg", "")],
        "row_no int, File string, LABEL string")
    lookup = LB.manifest_lookup(rows, "/d")
    got = {r.path: r.manifest_label for r in LB.join_manifest(items, lookup).collect()}
    # the last exact row wins for a/x; the first alias of x.jpg is the row for a/x
    assert got == {"/d/a/x.jpg": 1, "/d/b/x.jpg": 0, "/d/c/y.jpg": 1, "/d/z.jpg": None}
    out = LB.apply_labels(items, LB.AUTO, lookup).collect()
    assert {r.label_mode for r in out} == {"manifest"} and {r.labelled for r in out} == {3}


def test_auto_takes_first_source_that_labels_anything(spark):
    items = spark.createDataFrame(
        [("/d/ai/real_1.jpg", "ai/real_1.jpg"), ("/d/x/real_2.jpg", "x/real_2.jpg")],
        "path string, rel_path string")
    got = {r.rel_path: r.label for r in LB.apply_labels(items).collect()}
    assert got == {"ai/real_1.jpg": 1, "x/real_2.jpg": None}
    assert {r.label for r in LB.apply_labels(items, LB.FILENAME).collect()} == {0}
    assert {r.label for r in LB.apply_labels(items, LB.NONE).collect()} == {None}


def test_guards(spark):
    df = spark.createDataFrame([(0,), (None,)], "label int")
    assert LB.require(df, labels=True)["n_real"] == 1
    with pytest.raises(ValueError):
        LB.require(df, both_classes=True)
    with pytest.raises(ValueError):
        LB.require(df.where("label > 5"))


def test_hot_group_sampling(spark):
    """One group holds most rows; counts are exact, draws repeat and parts are disjoint."""
    df = spark.range(20000).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") < 14000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
        .alias("grp"))
    sizes = {r.grp: r["count"] for r in df.groupBy("grp").count().collect()}
    parts = S.split_groups(df, ["grp"], ["item_id"], 0.15, 0.1).collect()
    assert len(parts) == 20000 and len({r.item_id for r in parts}) == 20000
    for g, n in sizes.items():
        got = [r.split for r in parts if r.grp == g]
        assert got.count("test") == round(n * 0.1) and got.count("val") == round(n * 0.15)
    again = {r.item_id: r.split for r in S.split_groups(
        df.repartition(3), ["grp"], ["item_id"], 0.15, 0.1).collect()}
    assert again == {r.item_id: r.split for r in parts}
    drawn = S.take_per_group(df, ["grp"], ["item_id"], 1000).groupBy("grp").count().collect()
    assert {r.grp: r["count"] for r in drawn} == {g: min(n, 1000) for g, n in sizes.items()}


def test_shuffled_order_is_the_hash_order(spark):
    df = spark.range(3000).select(F.col("id").alias("item_id"), F.lit(1).alias("y"))
    picked = {r.item_id for r in S.take_per_group(df, ["y"], ["item_id"], 137, 9).collect()}
    first = df.orderBy(S.shuffle_key(9, ["item_id"]), "item_id").limit(137).collect()
    assert picked == {r.item_id for r in first}


def test_balanced_sample_contract(spark):
    def counts(rows, n):
        df = spark.createDataFrame(rows, "item_id int, y int")
        return {r.y: r["count"] for r in S.balanced_sample(df, n, ["item_id"]).groupBy("y")
                .count().collect()}
    rows = [(i, i % 5 == 0) for i in range(100)]
    rows = [(i, int(b)) for i, b in rows] + [(1000, None)]
    assert counts(rows, 30) == {0: 15, 1: 15}
    assert counts(rows, 200) == {0: 20, 1: 20}
    assert counts(rows, 1) == {0: 1, 1: 1}
    assert counts([(i, 1) for i in range(50)], 30) == {1: 15}


def test_two_round_top_n_equals_one_round(spark):
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("k"),
                                  (F.col("id") * 7919 % 9001).alias("v"))
    a = S.top_per_group(df, ["k"], [F.col("v")], 1500, rank="r")
    want = {k: sorted((i * 7919 % 9001, i) for i in range(9000) if i % 2 == k)[:1500]
            for k in (0, 1)}
    for k in (0, 1):
        got = sorted((r.v, r.id) for r in a.where(F.col("k") == k).collect())
        assert got == want[k]


def test_offset_and_cap(spark):
    df = spark.createDataFrame([(i, "a", i % 2 == 0) for i in range(20)] + [(99, "b", True)],
                               "id int, k string, ok boolean")
    got = S.offset_and_cap(df, ["k"], "id", 5, 3, F.col("ok")).collect()
    assert sorted(r.id for r in got) == [6, 8, 10]


def test_cap_groups_balances_negatives(spark):
    rows = [(i, 1, f"g{i % 3}") for i in range(90)] + [(1000 + i, 0, None) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id int, y int, grp string")
    got = S.cap_groups(df, 10, ["item_id"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 30, 1: 30}
    got = S.cap_groups(df, 10, ["item_id"], negatives=55).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 55, 1: 30}


def test_manifest_split_caps_before_dropping_missing(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "item_id int, y int")
    present = df.where("item_id % 4 < 2")
    out = S.manifest_split(df, present, "item_id", 60, 0.25)
    whole = S.manifest_split(df, df, "item_id", 60, 0.25)
    assert whole.count() == 120 and whole.where("split = 'val'").count() == 30
    assert out.count() < 120
    assert out.join(present, "item_id", "left_anti").count() == 0


def test_disjointness(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("z",), (None,)], "k string")
    S.require_disjoint(a, b, "k")
    with pytest.raises(ValueError, match="x"):
        S.require_disjoint(a, a.where("k = 'x'"), "k")


def test_grid_shapes():
    assert len(G.graded_grid()) == 51 and len(G.official_grid()) == 15
    assert (len(G.evaluation_grid()), len(G.heldout_grid()), len(G.chain_grid())) == (17, 6, 5)
    labels = {(c.key, c.severity): c.label for c in G.graded_grid() + G.official_grid()}
    assert labels[("jpeg", 2)] == "q75" and labels[("rescale", 3)] == "35%"
    assert labels[("blur", 2)] == "σ1.0" and labels[("off_noise", 3)] == "σ0.10"
    assert labels[("off_resize", 1)] == "0.5×" and labels[("saturation", 5)] == "+100%"
    picked = D.select_cells(G.graded_grid(), ["jpeg", "clean", "nothing"], 2)
    assert [(c.key, c.severity) for c in picked] == [("clean", 0), ("jpeg", 1), ("jpeg", 2)]
    assert G.severity_cell(G.graded_grid(), "jpeg", 99).severity == 5
    assert G.severity_cell(G.graded_grid(), "jpeg", 0).severity == 1


def test_sweep_cells_with_dead_cell(spark):
    conds = D.select_cells(G.official_grid(), ["off_blur"])
    items = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)],
                                  "item_id int, y int, s double")
    grid = D.expand_conditions(items, conds).withColumn(
        "s", F.when(F.col("severity") != 3, F.col("s") - 0.2 * F.col("severity")))
    cells = D.sweep_cells(grid, 0.5, conds)
    rows = {r.severity: r for r in cells.collect()}
    assert rows[3].n == 0 and rows[3].accuracy is None and rows[3].delta_accuracy is None
    assert rows[0].delta_accuracy == 0.0 and rows[1].n == 10
    summary = D.sweep_summary(cells).first()
    assert (summary.cells, summary.scored_cells) == (3, 2)
    report = R.sweep_report(cells).first()
    assert len(report.cells) == 3 and report.sample_size == 10
    assert [c.severity for c in report.cells] == [1, 2, 3]


def test_group_vs_negatives(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1, f"g{i % 3}", float(np.round(rng.random(), 2))) for i in range(90)]
    rows += [(100 + i, 0, "real", float(np.round(rng.random(), 2))) for i in range(80)]
    df = spark.createDataFrame(rows, "item_id int, y int, grp string, s double").withColumn(
        "key", F.lit("clean"))
    got = {r.grp: r for r in D.group_vs_negatives(df, 0.5, keys=["key"]).collect()}
    neg = np.array([r[3] for r in rows if r[1] == 0])
    for g in ("g0", "g1", "g2"):
        pos = np.array([r[3] for r in rows if r[2] == g])
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (
            len(pos) * len(neg))
        assert got[g].auroc == pytest.approx(want) and got[g].n == 30
        assert got[g].recall == pytest.approx((pos >= 0.5).mean())


def test_trivial_rule_and_correlation(spark):
    df = spark.createDataFrame([(1, 4, 4), (1, 3, 3), (0, 4, 3), (0, 2, 2)], "y int, w int, h int")
    row = A.trivial_rules(df, {"square": F.col("w") == F.col("h")}).first()
    assert row.balanced_accuracy == pytest.approx(0.75)
    few = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "x double, y double")
    row = A.correlation(few, "x", "y").first()
    assert row.r == pytest.approx(1.0) and row.n == 10
    assert A.correlation(few.limit(1), "x", "y").first().r is None


def test_errors_and_views(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.9), (2, 0, 0.6), (3, 1, 0.1), (4, 1, 0.5), (5, None, 0.8), (6, 0, None)],
        "item_id int, y int, s double")
    errs = R.ranked_errors(R.errors(df, 0.5)).collect()
    assert [r.item_id for r in errs] == [1, 3, 2]
    worst = R.worst_errors(R.errors(df, 0.5), 1).collect()
    assert {(r.kind, r.item_id) for r in worst} == {("false_positives", 1),
                                                    ("false_negatives", 3)}
    view = {r.item_id: r for r in R.result_view(df, 0.5).collect()}
    assert view[6].sort_score == -1.0 and view[6].score_text == "—"
    assert view[4].result == "✓" and view[1].result == "✗ FP" and view[5].result == "—"
    assert R.result_view(df, 0.5, "fn").count() == 1
    preds = {r.image_path: r for r in R.predictions(
        df.withColumn("path", F.col("item_id").cast("string")), 0.5).collect()}
    assert preds["6"].pred == 0.5 and preds["6"].prediction is None
    assert preds["4"].prediction == "fake"
