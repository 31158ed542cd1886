"""Perturbation grids over the scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.operators import calibration as C
from verigauge.operators import conditions as D
from verigauge.operators import metrics as M
from verigauge.operators import results as R
from verigauge.operators import thresholds as T
from verigauge.operators.steps import sweep_in_steps
from verigauge.plans import fixtures as X
from verigauge.plans.metric_queries import (
    AP_SQL, AUC_SQL, BAL_SQL, ECE_SQL, fold_sql, rates_sql)
from verigauge.plans.registry import query, r6
from verigauge.session import shared_folder

CELL = "key, family, severity, label"
THR = 0.05
CONDS = X.table_conditions()
GRID_LADDER = f"{X.G_SQL}, {X.ladder_sql('g', CELL)}"


@query("j5_condition_grid", f"""WITH {X.G_SQL} SELECT {CELL}, count(*)::BIGINT AS n,
    count(DISTINCT item_id)::BIGINT AS items, round(min(s), 6) AS lowest,
    round(max(s), 6) AS highest FROM g GROUP BY {CELL}""")
def j5(spark, sf):
    return r6(X.scored_grid(spark, sf).groupBy("key", "family", "severity", "label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"),
        F.min("s").alias("lowest"), F.max("s").alias("highest")))


COND_METRIC_SQL = f"""far AS (SELECT {CELL}, quantile_cont(s, 0.05) FILTER (WHERE y = 1) AS t
    FROM g GROUP BY {CELL}),
fp95 AS (SELECT g.key, g.severity, avg(CASE WHEN g.s >= far.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE
    END) AS fpr_at_95tpr FROM g JOIN far ON g.key = far.key AND g.severity = far.severity
    WHERE g.y = 0 GROUP BY g.key, g.severity),
cm AS (SELECT {CELL}, max(n_pos)::BIGINT AS n_ai, max(n_neg)::BIGINT AS n_real,
    {AUC_SQL} AS auroc, {AP_SQL} AS ap,
    (sum(CASE WHEN score >= 0.05 THEN pos ELSE neg END)
        )::DOUBLE / (max(n_pos) + max(n_neg)) AS acc,
    sum(CASE WHEN score >= 0.05 THEN pos ELSE 0 END)::DOUBLE / max(n_pos) AS tpr,
    sum(CASE WHEN score >= 0.05 THEN neg ELSE 0 END)::DOUBLE / max(n_neg) AS fpr,
    sum(score * neg) / max(n_neg) AS score_mean_real,
    sum(score * pos) / max(n_pos) AS score_mean_fake FROM lad GROUP BY {CELL})"""


@query("a15_condition_metrics", f"""WITH {GRID_LADDER}, {COND_METRIC_SQL}
SELECT cm.key, family, cm.severity, label, n_ai, n_real, round(auroc, 6) AS auroc,
    round(ap, 6) AS ap, round(acc, 6) AS acc, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
    round(fpr_at_95tpr, 6) AS fpr_at_95tpr, round(score_mean_real, 6) AS score_mean_real,
    round(score_mean_fake, 6) AS score_mean_fake
FROM cm JOIN fp95 ON cm.key = fp95.key AND cm.severity = fp95.severity""")
def a15(spark, sf):
    return r6(D.condition_metrics(X.scored_grid(spark, sf), THR, conditions=CONDS))


@query("a16_family_rollup", f"""WITH {GRID_LADDER}, {COND_METRIC_SQL},
p AS (SELECT *, CASE WHEN family = 'clean' THEN 'clean' WHEN family IN ('jpeg', 'blur', 'resize',
    'noise', 'color', 'crop') THEN 'grid' WHEN family LIKE '%\\_ood' ESCAPE '\\' THEN 'ood'
    WHEN family = 'chain' THEN 'chain' ELSE 'other' END AS part FROM cm)
SELECT part, count(*)::BIGINT AS n_conditions, round(avg(auroc), 6) AS mean_auroc,
    arg_min(key, row(auroc, key, severity)) AS worst_key,
    arg_min(severity, row(auroc, key, severity)) AS worst_severity,
    round(min(auroc), 6) AS worst_auroc, round((SELECT auroc FROM cm WHERE key = 'clean')
    - min(auroc), 6) AS "drop" FROM p GROUP BY part""")
def a16(spark, sf):
    return r6(D.family_rollup(D.condition_metrics(X.scored_grid(spark, sf), THR, conditions=CONDS)))


GROUPS_SQL = f"""pos_c AS (SELECT {CELL}, grp, s AS score, count(*) AS k FROM g WHERE y = 1
    GROUP BY ALL),
gv AS (SELECT p.key, p.severity, p.grp, sum(p.k)::BIGINT AS n,
    sum(p.k::DOUBLE * (2 * (l.n_neg - l.fp) + l.neg)) / (2.0::DOUBLE * sum(p.k) * max(l.n_neg))
    AS auroc, sum(CASE WHEN p.score >= 0.05 THEN p.k ELSE 0 END)::DOUBLE / sum(p.k) AS recall
    FROM pos_c p JOIN lad l ON p.key = l.key AND p.severity = l.severity AND p.score = l.score
    GROUP BY ALL)"""


@query("j9_group_vs_negatives", f"""WITH {GRID_LADDER}, {GROUPS_SQL}
SELECT key, severity, grp, n, round(auroc, 6) AS auroc, round(recall, 6) AS recall FROM gv""")
def j9(spark, sf):
    return r6(D.group_vs_negatives(X.scored_grid(spark, sf), THR, conditions=CONDS).select(
        "key", "severity", "grp", "n", "auroc", "recall"))


@query("a17_group_means", f"""WITH {GRID_LADDER}, {GROUPS_SQL}
SELECT grp, max(n) AS n, round(avg(auroc), 6) AS mean_auroc, round(avg(recall), 6) AS mean_recall
FROM gv GROUP BY grp""")
def a17(spark, sf):
    return r6(D.group_means(D.group_vs_negatives(X.scored_grid(spark, sf), THR, conditions=CONDS)))


@query("a18_calibration_table", f"""WITH {X.G_SQL},
probs AS (SELECT key, severity, y, cal, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(CASE WHEN cal
    THEN 3.0::DOUBLE * s - 0.7::DOUBLE ELSE s END))) AS p
    FROM g, (VALUES (false), (true)) c(cal)),
{ECE_SQL.format(keys='key, severity, cal,')},
e2 AS (SELECT key, severity, cal, sum(abs(sp - sy)) / sum(n) AS ece FROM cells
    GROUP BY key, severity, cal),
m AS (SELECT key, severity, avg(p) FILTER (WHERE y = 0) AS pr, avg(p) FILTER (WHERE y = 1) AS pf
    FROM probs WHERE cal GROUP BY key, severity)
SELECT m.key, m.severity, round(a.ece, 6) AS ece_raw, round(b.ece, 6) AS ece_calibrated,
    round(pr, 6) AS mean_prob_real, round(pf, 6) AS mean_prob_fake FROM m
JOIN e2 a ON a.key = m.key AND a.severity = m.severity AND NOT a.cal
JOIN e2 b ON b.key = m.key AND b.severity = m.severity AND b.cal""")
def a18(spark, sf):
    return r6(C.calibration_table(X.scored_grid(spark, sf), 3.0, -0.7, ["key", "severity"]))


@query("a21_score_drift", f"""WITH {X.G_SQL} SELECT key, severity,
    round(avg(s) FILTER (WHERE y = 0), 6) AS score_mean_real,
    round(avg(s) FILTER (WHERE y = 1), 6) AS score_mean_fake,
    round(avg(s) FILTER (WHERE y = 1) - avg(s) FILTER (WHERE y = 0), 6) AS margin
FROM g GROUP BY key, severity""")
def a21(spark, sf):
    return r6(D.score_drift(
        D.mean_scores(X.scored_grid(spark, sf), ["key", "severity"]), ["key", "severity"]))


@query("a33_flag_rates", f"""WITH {GRID_LADDER} SELECT key, severity,
    round(sum(CASE WHEN score >= 0.05 THEN pos ELSE 0 END)::DOUBLE / max(n_pos), 6) AS recall,
    round(sum(CASE WHEN score >= 0.05 THEN neg ELSE 0 END)::DOUBLE / max(n_neg), 6) AS fpr,
    round({AUC_SQL}, 6) AS auroc, round(sum(pos / (1.0::DOUBLE + exp(-(3.0::DOUBLE * score
    - 0.7::DOUBLE)))) / max(n_pos), 6) AS mean_prob FROM lad GROUP BY {CELL}""")
def a33(spark, sf):
    return r6(D.flag_rates(X.scored_grid(spark, sf), THR, 3.0, -0.7, conditions=CONDS).select(
        "key", "severity", "recall", "fpr", "auroc", "mean_prob"))


VIEW_SQL = f"""v AS (SELECT item_id, y, s, key || severity AS view_id FROM g),
{X.ladder_sql('v', 'view_id', 'vl')}, {X.ladder_sql('v', '', 'al')},
pv AS (SELECT view_id, {AUC_SQL} AS auc FROM vl GROUP BY view_id),
q AS (SELECT quantile_cont(s, 0.05) FILTER (WHERE y = 1) AS t FROM v)"""


@query("a34_view_metrics", f"""WITH {X.G_SQL}, {VIEW_SQL}
SELECT round((SELECT auc FROM pv WHERE view_id = 'clean0'), 6) AS auc_clean,
    round((SELECT avg(auc) FROM pv), 6) AS auc_mean, round((SELECT min(auc) FROM pv), 6)
    AS auc_worst, round((SELECT {AUC_SQL} FROM al), 6) AS auc_pooled,
    round((SELECT avg(CASE WHEN s >= t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM v, q
    WHERE y = 0), 6) AS fpr95_pooled""")
def a34(spark, sf):
    return r6(D.view_metrics(X.scored_grid(spark, sf), "cell"))


# a document of fewer than 50 characters cannot be scored, and none under "crop"
FAILED_SQL = f"""{X.D_SQL}, {X.COND_SQL},
g AS (SELECT d.item_id, d.y, d.grp, c.key, c.family, c.severity, c.label,
    CASE WHEN d.n_chars >= 50 AND c.key <> 'crop' THEN d.s * c.scale
    + c.spread * (((d.item_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE) END AS s
    FROM d CROSS JOIN cond c)"""


def failing_grid(spark, sf):
    ok = (F.col("n_chars") >= 50) & (F.col("key") != "crop")
    return X.condition_grid(X.partly_labelled(spark, sf)).withColumn(
        "s", F.when(ok, F.col("s")))


CELLS_SQL = f"""{X.ladder_sql('g', CELL)}, fold AS ({fold_sql('0.5', CELL)}),
r AS ({rates_sql(CELL, 'fold')}),
full_cells AS (SELECT c.key, c.family, c.severity, c.label, coalesce(r.n, 0)::BIGINT AS n,
    r.accuracy, r.auc FROM cond c LEFT JOIN r ON r.key = c.key AND r.severity = c.severity)"""
RAW_SQL = f"""{X.ladder_sql('g', CELL)}, fold AS ({fold_sql('0.5', CELL)}),
cells AS (SELECT c.key, c.family, c.severity, c.label,
    coalesce(f.n_ai + f.n_real, 0)::BIGINT AS n,
    (f.tp + f.n_real - f.fp)::DOUBLE / (f.n_ai + f.n_real) AS accuracy, f.auc
    FROM cond c LEFT JOIN fold f ON f.key = c.key AND f.severity = c.severity)"""


@query("d12_cell_scoring", f"""WITH {FAILED_SQL} SELECT key, severity, count(*)::BIGINT AS items,
    count(s)::BIGINT AS scored, count(*) FILTER (WHERE s IS NOT NULL AND y IS NOT NULL)::BIGINT
    AS pairs FROM g GROUP BY key, severity""")
def d12(spark, sf):
    return failing_grid(spark, sf).groupBy("key", "severity").agg(
        F.count(F.lit(1)).alias("items"), F.count("s").alias("scored"),
        F.count(F.when(F.col("s").isNotNull() & F.col("y").isNotNull(), 1)).alias("pairs"))


def cells(spark, sf):
    return D.sweep_cells(failing_grid(spark, sf), 0.5, X.table_conditions())


@query("j6_deltas", f"""WITH {FAILED_SQL}, {RAW_SQL},
b AS (SELECT accuracy, auc FROM cells WHERE key = 'clean')
SELECT key, family, severity, label, n, round(c.accuracy, 6) AS accuracy,
    round(c.auc, 6) AS auc, round(c.accuracy - b.accuracy, 6) AS delta_accuracy,
    round(c.auc - b.auc, 6) AS delta_auc FROM cells c, b""")
def j6(spark, sf):
    return r6(cells(spark, sf).select("key", "family", "severity", "label", "n", "accuracy",
                                      "auc", "delta_accuracy", "delta_auc"))


@query("d13_sweep", f"""WITH {FAILED_SQL}, {X.ladder_sql('g', CELL)},
fold AS ({fold_sql('0.5', CELL)}), r AS ({rates_sql(CELL, 'fold')})
SELECT c.key, c.severity, coalesce(n, 0)::BIGINT AS n, coalesce(threshold, 0.5) AS threshold,
    balanced_accuracy, "precision", recall, specificity, f1, fpr, fnr, ap,
    coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp,
    coalesce(tn, 0)::BIGINT AS tn, coalesce(fn, 0)::BIGINT AS fn
FROM cond c LEFT JOIN r ON r.key = c.key AND r.severity = c.severity""")
def d13(spark, sf):
    return r6(cells(spark, sf).select(
        "key", "severity", "n", "threshold", "balanced_accuracy", "precision", "recall",
        "specificity", "f1", "fpr", "fnr", "ap", "tp", "fp", "tn", "fn"))


@query("d13_sweep_in_steps", f"""WITH {X.G_SQL}, {X.ladder_sql('g', CELL)},
fold AS ({fold_sql('0.5', CELL)}), r AS ({rates_sql(CELL, 'fold')})
SELECT key, severity, n, balanced_accuracy, "precision", recall, ap, tp, fp, tn, fn FROM r""")
def d13_steps(spark, sf):
    """The sweep cell by cell, stopped after four of them and taken up again."""
    def score(items, c):
        return items.withColumn("s", F.col("s") * c.params["scale"] + c.params["spread"] * ((F.col("item_id") * 7919 % 1000).cast("double") / 1000.0))
    items, out, seen = X.scored_events(spark, sf), shared_folder(spark, "steps"), []
    for limit in (4, None):
        cells = sweep_in_steps(items, X.table_conditions(), score, 0.5, out, seen.append, lambda limit=limit: len(seen) == limit)
    return r6(cells.select("key", "severity", "n", "balanced_accuracy", "precision", "recall", "ap", "tp", "fp", "tn", "fn"))


@query("a35_sweep_summary", f"""WITH {FAILED_SQL}, {RAW_SQL},
b AS (SELECT accuracy FROM cells WHERE key = 'clean'),
d2 AS (SELECT key, severity, c.accuracy - b.accuracy AS change FROM cells c, b
    WHERE key <> 'clean')
SELECT count(*)::BIGINT AS cells, count(change)::BIGINT AS scored_cells,
    round(avg(change), 6) AS mean_drop,
    arg_min(key, row(change, key, severity)) FILTER (WHERE change IS NOT NULL) AS worst_key,
    arg_min(severity, row(change, key, severity)) FILTER (WHERE change IS NOT NULL)
    AS worst_severity, round(min(change), 6) AS worst_drop FROM d2""")
def a35(spark, sf):
    return r6(D.sweep_summary(cells(spark, sf)))


@query("k4_sweep_report", f"""WITH {FAILED_SQL}, {RAW_SQL},
b AS (SELECT accuracy, n FROM cells WHERE key = 'clean')
SELECT (row_number() OVER (ORDER BY key, severity) - 1)::INTEGER AS pos, key AS transform,
    severity, label AS severity_label, round(c.accuracy, 6) AS accuracy,
    round(c.accuracy - b.accuracy, 6) AS delta_accuracy, b.n AS sample_size,
    round(b.accuracy, 6) AS baseline_accuracy FROM cells c, b WHERE key <> 'clean'""")
def k4(spark, sf):
    report = R.sweep_report(cells(spark, sf))
    return r6(report.select("sample_size", F.col("baseline.accuracy").alias("baseline_accuracy"),
                            F.posexplode("cells").alias("pos", "cell")).select(
        "pos", "cell.transform", "cell.severity", "cell.severity_label",
        F.col("cell.metrics.accuracy").alias("accuracy"), "cell.delta_accuracy", "sample_size",
        "baseline_accuracy"))


@query("k6_condition_scores", f"""WITH {X.G_SQL} SELECT item_id, key, severity,
    s AS score FROM g""")
def k6(spark, sf):
    return X.scored_grid(spark, sf).select("item_id", "key", "severity",
                                           F.col("s").alias("score"))


@query("d14_cell_selection", f"""WITH {X.G_SQL} SELECT key, severity, count(*)::BIGINT AS n FROM g
WHERE key = 'clean' OR (key IN ('jpeg', 'blur', 'noise') AND severity <= 1) GROUP BY ALL""")
def d14(spark, sf):
    picked = D.select_cells(X.table_conditions(), ["jpeg", "blur", "noise", "unknown"], 1)
    return D.expand_conditions(X.scored_events(spark, sf), picked).groupBy(
        "key", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("j8_transfer_gap", f"""WITH {X.E_SQL}, {X.L_SQL}
SELECT round(a, 6) AS recall_reference, round(b, 6) AS recall_probe, round(a - b, 6) AS gap FROM
    (SELECT avg(CASE WHEN s >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM e
        WHERE y = 1),
    (SELECT avg(CASE WHEN s >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b FROM l
        WHERE y = 1)""")
def j8(spark, sf):
    return r6(D.transfer_gap(X.scored_events(spark, sf), X.tied_lines(spark, sf), THR))


@query("a36_threshold_diagnostic", f"""WITH {GRID_LADDER},
bal AS (SELECT key, severity, score, {BAL_SQL} AS v FROM lad),
best AS (SELECT key, severity, min(score) AS t, max(v) AS v FROM (SELECT *, max(v) OVER
    (PARTITION BY key, severity) AS top FROM bal) x WHERE v = top GROUP BY key, severity),
dep AS (SELECT key, severity, (sum(CASE WHEN score >= 0.05 THEN pos ELSE 0 END)::DOUBLE
    / max(n_pos) + sum(CASE WHEN score < 0.05 THEN neg ELSE 0 END)::DOUBLE / max(n_neg)) / 2 AS v
    FROM lad GROUP BY key, severity)
SELECT d.key, d.severity, 0.05::DOUBLE AS deployed_threshold, round(d.v, 6) AS deployed_balanced,
    round(b.t, 6) AS swept_threshold, round(b.v, 6) AS swept_balanced,
    round(b.v - d.v, 6) AS gap, b.v - d.v > 0.05 AS mis_set
FROM dep d JOIN best b ON b.key = d.key AND b.severity = d.severity""")
def a36(spark, sf):
    keys = ["key", "severity"]
    grid = X.scored_grid(spark, sf)
    return r6(D.threshold_diagnostic(M.confusion(grid, THR, keys),
                                     T.scan_threshold(grid, "balanced", keys=keys), keys))
