"""Metric, threshold and calibration queries over the scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.functions.numeric import sigmoid
from verigauge.operators import calibration as C
from verigauge.operators import ladder as L
from verigauge.operators import metrics as M
from verigauge.operators import thresholds as T
from verigauge.plans import fixtures as X
from verigauge.plans.registry import query, r6

AUC_SQL = """CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
    sum(pos::DOUBLE * (2 * (n_neg - fp) + neg)::DOUBLE)
    / (2.0::DOUBLE * max(n_pos)::DOUBLE * max(n_neg)::DOUBLE) END"""
AP_SQL = """CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
    sum(CASE WHEN pos > 0 THEN pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0 END)
    / max(n_pos)::DOUBLE END"""


def rates_sql(keys: str, source: str) -> str:
    """Derived rates over a relation with tp, fp, n_ai, n_real, threshold, auc, ap."""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}n_ai + n_real AS n, n_real, n_ai, round(threshold, 6) AS threshold,
    round((tp + n_real - fp)::DOUBLE / nullif(n_ai + n_real, 0), 6) AS accuracy,
    round(CASE WHEN n_ai > 0 AND n_real > 0
        THEN (tp::DOUBLE / n_ai + (n_real - fp)::DOUBLE / n_real) / 2
        WHEN n_ai > 0 THEN tp::DOUBLE / n_ai
        WHEN n_real > 0 THEN (n_real - fp)::DOUBLE / n_real END, 6) AS balanced_accuracy,
    round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS "precision",
    round(tp::DOUBLE / nullif(n_ai, 0), 6) AS recall,
    round((n_real - fp)::DOUBLE / nullif(n_real, 0), 6) AS specificity,
    round(CASE WHEN tp > 0 THEN (2 * tp)::DOUBLE / (tp + fp + n_ai) END, 6) AS f1,
    round(fp::DOUBLE / nullif(n_real, 0), 6) AS fpr,
    round((n_ai - tp)::DOUBLE / nullif(n_ai, 0), 6) AS fnr,
    round(auc, 6) AS auc, round(ap, 6) AS ap, tp, fp, n_real - fp AS tn, n_ai - tp AS fn
    FROM {source}"""


def fold_sql(threshold: str, keys: str = "", ladder: str = "lad") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}max(n_pos)::BIGINT AS n_ai, max(n_neg)::BIGINT AS n_real,
    {threshold}::DOUBLE AS threshold,
    sum(CASE WHEN score >= {threshold} THEN pos ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN score >= {threshold} THEN neg ELSE 0 END)::BIGINT AS fp,
    {AUC_SQL} AS auc, {AP_SQL} AS ap FROM {ladder} {group}"""


def metrics_sql(cte: str, source: str, threshold: str, keys: str = "") -> str:
    return f"""WITH {cte}, {X.ladder_sql(source, keys)},
fold AS ({fold_sql(threshold, keys)}) {rates_sql(keys, 'fold')}"""


THR = 0.05


@query("a1_metrics_at_threshold", metrics_sql(X.E_SQL, "e", "0.05"))
def a1(spark, sf):
    return r6(M.metrics(X.scored_events(spark, sf), THR))


@query("a1_metrics_per_group", metrics_sql(X.D_SQL, "d", "0.5", "grp"))
def a1_groups(spark, sf):
    return r6(M.metrics(X.partly_labelled(spark, sf), 0.5, ["grp"]))


@query("a1_confusion_only", f"""WITH {X.L_SQL}, {X.ladder_sql('l', 'grp')},
fold AS ({fold_sql('0.5', 'grp')}), r AS ({rates_sql('grp', 'fold')})
SELECT * EXCLUDE (auc, ap) FROM r""")
def a1_confusion(spark, sf):
    return r6(M.confusion(X.tied_lines(spark, sf), 0.5, ["grp"]))


@query("a2_auc", f"""WITH {X.E_SQL}, {X.ladder_sql('e')}
SELECT round({AUC_SQL}, 6) AS auc FROM lad""")
def a2(spark, sf):
    return r6(M.roc_auc(X.scored_events(spark, sf)))


@query("a2_auc_ties", f"""WITH {X.L_SQL}, {X.ladder_sql('l', 'grp')}
SELECT grp, round({AUC_SQL}, 6) AS auc FROM lad GROUP BY grp""")
def a2_ties(spark, sf):
    return r6(M.roc_auc(X.tied_lines(spark, sf), ["grp"]))


@query("a3_average_precision", f"""WITH {X.E_SQL}, {X.ladder_sql('e')}
SELECT round({AP_SQL}, 6) AS ap FROM lad""")
def a3(spark, sf):
    return r6(M.average_precision(X.scored_events(spark, sf)))


@query("a3_average_precision_ties", f"""WITH {X.L_SQL}, {X.ladder_sql('l', 'grp')}
SELECT grp, round({AP_SQL}, 6) AS ap FROM lad GROUP BY grp""")
def a3_ties(spark, sf):
    return r6(M.average_precision(X.tied_lines(spark, sf), ["grp"]))


@query("a4_roc_points", f"""WITH {X.E_SQL}, {X.ladder_sql('e')},
step AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS next_pos,
    lead(neg) OVER (ORDER BY score DESC) AS next_neg, tp = pos AND fp = neg AS first FROM lad)
SELECT round(score, 6) AS threshold, round(fp::DOUBLE / n_neg, 6) AS fpr,
    round(tp::DOUBLE / n_pos, 6) AS tpr FROM step
WHERE first OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""")
def a4(spark, sf):
    return r6(M.roc_points(X.scored_events(spark, sf)))


@query("a4_roc_points_all", f"""WITH {X.L_SQL}, {X.ladder_sql('l', 'grp')}
SELECT grp, round(score, 6) AS threshold, round(fp::DOUBLE / n_neg, 6) AS fpr,
    round(tp::DOUBLE / n_pos, 6) AS tpr FROM lad
UNION ALL SELECT DISTINCT grp, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM lad""")
def a4_all(spark, sf):
    return r6(M.roc_points(X.tied_lines(spark, sf), ["grp"], drop_collinear=False))


@query("a5_pr_points", f"""WITH {X.E_SQL}, {X.ladder_sql('e')}
SELECT round(score, 6) AS threshold, round(tp::DOUBLE / n_pos, 6) AS recall,
    round(tp::DOUBLE / (tp + fp), 6) AS "precision" FROM lad
UNION ALL SELECT NULL, 0.0::DOUBLE, 1.0::DOUBLE""")
def a5(spark, sf):
    return r6(M.pr_points(X.scored_events(spark, sf)))


@query("a6_threshold_sweep", f"""WITH {X.L_SQL},
grid AS (SELECT CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i::DOUBLE * (1.0::DOUBLE / 100) END AS t
    FROM range(0, 101) r(i)),
c AS (SELECT s, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM l GROUP BY s),
n AS (SELECT sum(pos)::BIGINT AS n_ai, sum(neg)::BIGINT AS n_real FROM c),
cnt AS (SELECT t, coalesce(sum(pos), 0)::BIGINT AS tp, coalesce(sum(neg), 0)::BIGINT AS fp
    FROM grid LEFT JOIN c ON c.s >= t GROUP BY t)
SELECT round(t, 6) AS threshold,
    round((tp + n_real - fp)::DOUBLE / (n_ai + n_real), 6) AS accuracy,
    round(CASE WHEN tp > 0 THEN (2 * tp)::DOUBLE / (tp + fp + n_ai) END, 6) AS f1,
    round(fp::DOUBLE / n_real, 6) AS fpr FROM cnt, n""")
def a6(spark, sf):
    return r6(M.threshold_sweep(X.tied_lines(spark, sf)))


@query("a7_score_histogram", f"""WITH {X.D_SQL},
edge AS (SELECT i, i::DOUBLE * (1.0::DOUBLE / 30) AS lo FROM range(0, 30) r(i)),
b AS (SELECT d.item_id, coalesce(d.y, -1) AS label, max(edge.i)::INTEGER AS bin
    FROM d JOIN edge ON d.s >= edge.lo WHERE d.s BETWEEN 0 AND 1 GROUP BY d.item_id, d.y)
SELECT label, bin, count(*)::BIGINT AS items FROM b GROUP BY label, bin""")
def a7(spark, sf):
    return M.score_histogram(X.partly_labelled(spark, sf))


CAND_SQL = """cand_c AS (SELECT score, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg,
    bool_or(cand) AS cand FROM (
        SELECT score, pos, neg, false AS cand FROM lad_c
        UNION ALL SELECT round_even(score * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE, 0, 0, true
        FROM lad_c) u GROUP BY score),
cand AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp,
    sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(pos) OVER ()::BIGINT AS n_pos,
    sum(neg) OVER ()::BIGINT AS n_neg FROM cand_c)"""
F1_SQL = "CASE WHEN tp > 0 THEN (2 * tp)::DOUBLE / (tp + fp + n_pos)::DOUBLE END"
YOUDEN_SQL = "tp::DOUBLE / n_pos::DOUBLE - fp::DOUBLE / n_neg::DOUBLE"


def best_sql(value: str, where: str = "cand", source: str = "cand") -> str:
    return (f"(SELECT score FROM {source} WHERE {where} AND ({value}) IS NOT NULL "
            f"ORDER BY ({value}) DESC, score LIMIT 1)")


@query("a8_best_threshold_f1", f"""WITH {X.E_SQL}, {X.ladder_sql('e')}, {CAND_SQL}
SELECT round({best_sql(F1_SQL)}, 6) AS threshold""")
def a8_f1(spark, sf):
    return r6(T.best_threshold(X.scored_events(spark, sf), "f1"))


@query("a8_best_threshold_youden", f"""WITH {X.L_SQL}, {X.ladder_sql('l')}, {CAND_SQL}
SELECT round({best_sql(YOUDEN_SQL)}, 6) AS threshold""")
def a8_youden(spark, sf):
    return r6(T.best_threshold(X.tied_lines(spark, sf), "youden"))


@query("a9_threshold_for_fpr", f"""WITH {X.E_SQL}, {X.ladder_sql('e')}
SELECT round(coalesce(min(CASE WHEN fp::DOUBLE / n_neg <= 0.01 THEN score END),
    nextafter(max(score), 1e308)), 6) AS threshold FROM lad""")
def a9(spark, sf):
    return r6(T.threshold_for_fpr(X.scored_events(spark, sf), 0.01))


@query("a9_threshold_for_fpr_fallback", f"""WITH {X.L_SQL}, {X.ladder_sql('l', 'grp')}
SELECT grp, coalesce(min(CASE WHEN fp::DOUBLE / n_neg <= 0.01 THEN score END),
    nextafter(max(score), 1e308)) AS threshold FROM lad GROUP BY grp""")
def a9_fallback(spark, sf):
    return T.threshold_for_fpr(X.tied_lines(spark, sf), 0.01, ["grp"])


@query("a10_quantile_threshold", f"""WITH {X.E_SQL}
SELECT round(quantile_cont(s, 0.99) FILTER (WHERE y = 0), 6) AS threshold FROM e""")
def a10(spark, sf):
    return r6(T.quantile_threshold(X.scored_events(spark, sf), 0.01))


@query("a10_quantile_threshold_groups", f"""WITH {X.D_SQL}
SELECT grp, round(coalesce(quantile_cont(s, 0.95) FILTER (WHERE y = 0), 0.0), 6) AS threshold
FROM d WHERE y IS NOT NULL GROUP BY grp""")
def a10_groups(spark, sf):
    return r6(T.quantile_threshold(X.partly_labelled(spark, sf), 0.05, ["grp"]))


BAL_SQL = """(tp::DOUBLE / greatest(n_pos, 1)::DOUBLE
    + (n_neg - fp)::DOUBLE / greatest(n_neg, 1)::DOUBLE) * 0.5::DOUBLE"""
ACC_SQL = "(tp + n_neg - fp)::DOUBLE / (n_pos + n_neg)::DOUBLE"


def scan_sql(value: str) -> str:
    return f"""SELECT round(score, 6) AS threshold, round({value}, 6) AS "value" FROM lad
ORDER BY ({value}) DESC, score LIMIT 1"""


@query("a11_scan_balanced", f"WITH {X.E_SQL}, {X.ladder_sql('e')} {scan_sql(BAL_SQL)}")
def a11_balanced(spark, sf):
    return r6(T.scan_threshold(X.scored_events(spark, sf), "balanced"))


@query("a11_scan_accuracy", f"WITH {X.D_SQL}, {X.ladder_sql('d')} {scan_sql(ACC_SQL)}")
def a11_accuracy(spark, sf):
    return r6(T.scan_threshold(X.partly_labelled(spark, sf), "acc"))


@query("a12_best_balanced_ties", f"WITH {X.L_SQL}, {X.ladder_sql('l')} {scan_sql(BAL_SQL)}")
def a12(spark, sf):
    return r6(T.scan_threshold(X.tied_lines(spark, sf), "balanced"))


@query("a13_fpr_at_tpr", f"""WITH {X.E_SQL},
q AS (SELECT quantile_cont(s, 0.05) FILTER (WHERE y = 1) AS t FROM e)
SELECT round(t, 6) AS threshold,
    round(avg(CASE WHEN s >= t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fpr_at_tpr
FROM e, q WHERE y = 0 GROUP BY t""")
def a13(spark, sf):
    return r6(T.fpr_at_tpr(X.scored_events(spark, sf)))


def recommend_sql() -> str:
    budgets = [("FPR<=0.5%", 0.005), ("FPR<=1%", 0.01), ("FPR<=2%", 0.02), ("FPR<=5%", 0.05)]
    pick = ("(SELECT coalesce(min(CASE WHEN fp::DOUBLE / n_neg <= {b} THEN score END), "
            "nextafter(max(score), 1e308)) FROM lad)")
    rows = ["SELECT 0 AS ord, 'deployed' AS point, 0.05::DOUBLE AS t"]
    rows += [f"SELECT {i}, '{n}', {pick.format(b=b)}" for i, (n, b) in enumerate(budgets, 1)]
    rows += [f"SELECT 5, 'best F1', {best_sql(F1_SQL)}",
             f"SELECT 6, 'best balanced', {best_sql(YOUDEN_SQL)}"]
    points = " UNION ALL ".join(rows)
    return f"""WITH {X.E_SQL}, {X.ladder_sql('e')}, {CAND_SQL}, pts AS ({points}),
area AS (SELECT {AUC_SQL} AS auc, {AP_SQL} AS ap FROM lad),
fold AS (SELECT ord, point, t AS threshold, max(n_pos)::BIGINT AS n_ai,
    max(n_neg)::BIGINT AS n_real,
    sum(CASE WHEN score >= t THEN pos ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN score >= t THEN neg ELSE 0 END)::BIGINT AS fp,
    max(area.auc) AS auc, max(area.ap) AS ap FROM lad, pts, area GROUP BY ord, point, t),
rates AS ({rates_sql('ord, point', 'fold')})
SELECT *, ord = 1 AS recommended FROM rates"""


@query("a14_recommendations", recommend_sql())
def a14(spark, sf):
    return r6(T.recommendations(X.scored_events(spark, sf), THR))


ECE_SQL = """bins AS (SELECT *, least(14, (SELECT count(*) FROM range(1, 16) q(i)
    WHERE i::DOUBLE * (1.0::DOUBLE / 15) <= p))::INTEGER AS bin FROM probs),
cells AS (SELECT {keys} bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM bins
    GROUP BY {keys} bin)"""


@query("a20_calibration_error", f"""WITH {X.E_SQL}, probs AS (SELECT grp, y, s AS p FROM e),
{ECE_SQL.format(keys='')}
SELECT round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM cells""")
def a20(spark, sf):
    return r6(C.expected_calibration_error(X.scored_events(spark, sf), "s"))


@query("a20_calibration_error_groups", f"""WITH {X.L_SQL},
probs AS (SELECT grp, y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(s - 0.5::DOUBLE))) AS p FROM l),
{ECE_SQL.format(keys='grp,')}
SELECT grp, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM cells GROUP BY grp""")
def a20_groups(spark, sf):
    lines = X.tied_lines(spark, sf).withColumn("p", sigmoid(F.col("s") - 0.5))
    return r6(C.expected_calibration_error(lines, "p", keys=["grp"]))


@query("a30_fraction_quantiles", f"""WITH {X.D_SQL}
SELECT round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.5), 6) AS median,
    round(quantile_cont(s, 0.9), 6) AS p90 FROM d""")
def a30(spark, sf):
    q = L.quantiles(X.partly_labelled(spark, sf), [0.1, 0.5, 0.9])
    return r6(q.select(F.col("q0").alias("p10"), F.col("q1").alias("median"),
                       F.col("q2").alias("p90")))


@query("a37_threshold_drift", f"""WITH {X.G_SQL},
pooled AS (SELECT quantile_cont(s, 0.99) FILTER (WHERE y = 0) AS threshold FROM g),
clean AS (SELECT quantile_cont(s, 0.99) FILTER (WHERE y = 0) AS threshold_clean FROM g
    WHERE key = 'clean')
SELECT round(threshold, 6) AS threshold, round(threshold_clean, 6) AS threshold_clean,
    round(threshold - threshold_clean, 6) AS drift FROM pooled, clean""")
def a37(spark, sf):
    # a row counts once in the pooled set and the clean rows once more in their own
    both = F.explode(F.when(F.col("key") == "clean", F.array(F.lit("pooled"), F.lit("clean")))
                     .otherwise(F.array(F.lit("pooled"))))
    per_set = T.quantile_threshold(
        X.scored_grid(spark, sf).select("y", "s", both.alias("subset")), 0.01, ["subset"])
    return r6(per_set.groupBy().agg(
        F.max(F.when(F.col("subset") == "pooled", F.col("threshold"))).alias("threshold"),
        F.max(F.when(F.col("subset") == "clean", F.col("threshold"))).alias("threshold_clean"),
    ).withColumn("drift", F.col("threshold") - F.col("threshold_clean")))


@query("a37_recalibration", f"""WITH {X.G_SQL}, {X.ladder_sql('g')},
best AS (SELECT score FROM lad ORDER BY ({BAL_SQL}) DESC, score LIMIT 1),
pts AS (SELECT 0 AS ord, 'old' AS point, 0.05::DOUBLE AS t
    UNION ALL SELECT 1, 'new (balanced)', score FROM best),
fold AS (SELECT ord, point, t AS threshold, max(n_pos)::BIGINT AS n_ai,
    max(n_neg)::BIGINT AS n_real,
    sum(CASE WHEN score >= t THEN pos ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN score >= t THEN neg ELSE 0 END)::BIGINT AS fp
    FROM lad, pts GROUP BY ord, point, t)
SELECT ord, point, round(threshold, 6) AS threshold,
    round((tp + n_real - fp)::DOUBLE / (n_ai + n_real), 6) AS accuracy,
    round((tp::DOUBLE / n_ai + (n_real - fp)::DOUBLE / n_real) / 2, 6) AS balanced_accuracy,
    round(tp::DOUBLE / n_ai, 6) AS recall, round(fp::DOUBLE / n_real, 6) AS fpr FROM fold""")
def a37_recalibration(spark, sf):
    return r6(T.before_and_after(X.scored_grid(spark, sf), 0.05, "balanced").select(
        "ord", "point", "threshold", "accuracy", "balanced_accuracy", "recall", "fpr"))


@query("k5_operating_points", f"""WITH r AS ({recommend_sql()})
SELECT point AS label, round(threshold, 6) AS threshold, accuracy, recall, fpr, f1 FROM r""")
def k5(spark, sf):
    points = T.recommendations(X.scored_events(spark, sf), THR)
    return r6(points.select(F.col("point").alias("label"), "threshold", "accuracy", "recall",
                            "fpr", "f1"))
