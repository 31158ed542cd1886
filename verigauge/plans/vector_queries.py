"""Feature-vector and head queries over the embeddings table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.functions import vectors as V
from verigauge.functions.numeric import sigmoid
from verigauge.operators import conditions as D
from verigauge.operators import heads as H
from verigauge.operators import minimax as MM
from verigauge.operators import near_vectors as NV
from verigauge.operators import sampling as S
from verigauge.operators import scoring as SC
from verigauge.operators import training as TR
from verigauge.operators.scalars import attach_row
from verigauge.plans import fixtures as X
from verigauge.plans.metric_queries import AUC_SQL
from verigauge.plans.registry import query, r6

DIM = 64


def demo_head(seed: int, name: str, l2: bool = True) -> H.Head:
    """Fixed weights made from a rule, so that Spark and SQL can both write them down."""
    return H.Head(
        weights=[round(math.sin(seed + i + 1) / 4, 6) for i in range(DIM)],
        bias=round(0.1 * seed, 6), mu=[round(math.cos(i) / 100, 6) for i in range(DIM)],
        sd=[round(0.1 + 0.01 * (i % 7), 6) for i in range(DIM)],
        platt_a=1.0 + 0.25 * seed, platt_b=-0.05 * seed, threshold=0.2, l2=l2, name=name)


HEADS = [demo_head(0, "first"), demo_head(1, "second"), demo_head(2, "third"),
         demo_head(3, "other space", l2=False)]


def features(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), V.doubles(F.col("embedding")).alias("v"),
        (F.col("label") >= 5).cast("int").alias("y"), F.col("label").alias("grp"))


def lst(values) -> str:
    return "[" + ", ".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
V_SQL = f"""v0 AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v,
    CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, label AS grp FROM embeddings),
u AS (SELECT *, list_transform(v, lambda x: x / nv) AS unit FROM (
    SELECT *, {NORM.format(v='v')} + 1e-8 AS nv FROM v0) q)"""


def logit_sql(h: H.Head, unit: str = "unit") -> str:
    return (f"list_sum(list_transform(list_zip({unit}, {lst(h.mu)}, {lst(h.sd)}, "
            f"{lst(h.weights)}), lambda z: (z[1] - z[2]) / z[3] * z[4])) + {h.bias!r}::DOUBLE")


def prob_sql(h: H.Head, logit: str) -> str:
    return (f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({h.platt_a!r}::DOUBLE * ({logit}) "
            f"+ {h.platt_b!r}::DOUBLE)))")


@query("s11_feature_cache", """SELECT vec_id, label - 3 AS label FROM embeddings
WHERE label - 3 >= 0""")
def s11(spark, sf):
    from verigauge.sources.tables import readable_features
    rows = X.table(spark, sf, "embeddings").withColumn("label", F.col("label") - 3)
    return readable_features(rows).select("vec_id", "label")


@query("v1_l2_normalise", f"""WITH {V_SQL}, r AS (SELECT item_id, unnest(unit) AS x,
    unnest(range(0, len(unit)))::INTEGER AS dim FROM u)
SELECT item_id, dim, round(x, 6) AS x FROM r""")
def v1(spark, sf):
    return r6(features(spark, sf).select(
        "item_id", F.posexplode(V.l2_normalise(F.col("v"))).alias("dim", "x")))


MOMENTS_SQL = """mo AS (SELECT dim, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd FROM (
    SELECT unnest(unit) AS x, unnest(range(0, len(unit)))::INTEGER AS dim FROM {src}) q
    GROUP BY dim)"""


@query("v2_feature_moments", f"""WITH {V_SQL}, {MOMENTS_SQL.format(src='u')}
SELECT dim, round(mu, 6) AS mu, round(sd, 6) AS sd FROM mo""")
def v2(spark, sf):
    m = H.feature_moments(features(spark, sf), "v")
    return r6(m.select(F.posexplode(F.arrays_zip("mu", "sd")).alias("dim", "z")).select(
        "dim", "z.mu", "z.sd"))


@query("v3_standardise", f"""WITH {V_SQL}, {MOMENTS_SQL.format(src='u')},
r AS (SELECT item_id, unnest(unit) AS x, unnest(range(0, len(unit)))::INTEGER AS dim FROM u)
SELECT item_id, r.dim, round((x - mu) / sd, 5) AS x FROM r JOIN mo ON r.dim = mo.dim""")
def v3(spark, sf):
    return H.with_prepared(features(spark, sf), "v").select(
        "item_id", F.posexplode("x").alias("dim", "x")).withColumn("x", F.round("x", 5))


@query("p16_leave_one_group_out", f"""WITH {V_SQL}, kept AS (SELECT * FROM u WHERE grp <> 7),
{MOMENTS_SQL.format(src='kept')} SELECT dim, round(mu, 6) AS mu, round(sd, 6) AS sd FROM mo""")
def p16(spark, sf):
    m = H.feature_moments(S.without_group(features(spark, sf), "grp", 7), "v")
    return r6(m.select(F.posexplode(F.arrays_zip("mu", "sd")).alias("dim", "z")).select(
        "dim", "z.mu", "z.sd"))


@query("v4_linear_head", f"""WITH {V_SQL} SELECT item_id, round({logit_sql(HEADS[0])}, 6) AS logit
FROM u""")
def v4(spark, sf):
    return r6(features(spark, sf).select(
        "item_id", H.head_logit(F.col("v"), HEADS[0]).alias("logit")))


def small_mlp() -> H.Head:
    """Two hidden layers, 64 -> 3 -> 2 -> 1."""
    wave = [[round(math.sin(1 + 5 * r + i) / 3, 6) for i in range(DIM)] for r in range(3)]
    inner = [[0.5, -0.25, 0.75], [-0.4, 0.6, 0.2]]
    base = demo_head(0, "mlp")
    return H.Head(
        weights=[0.8, -0.6], bias=0.05, mu=base.mu, sd=base.sd, name="mlp", hidden=(
            H.Layer(wave, [0.1, 0.2, 0.3], [0.1, 0.0, -0.1], [1.5, 2.0, 0.5], [1.0, 0.9, 1.1],
                    [0.0, 0.1, 0.2]),
            H.Layer(inner, [0.05, -0.05], [0.2, 0.1], [1.0, 0.8], [1.2, 0.7], [0.1, 0.0])))


def mlp_sql() -> str:
    h = small_mlp()
    one, two = h.hidden

    def unit(layer: H.Layer, r: int, z: str) -> str:
        return (f"greatest(0.0::DOUBLE, (({z}) + {layer.bias[r]!r} - {layer.mean[r]!r})"
                f" / sqrt({layer.var[r]!r}::DOUBLE + 1e-5) * {layer.gamma[r]!r}"
                f" + {layer.beta[r]!r})")
    first = [unit(one, r, "list_sum(list_transform(list_zip(st, " + lst(one.weights[r])
                  + "), lambda z: z[1] * z[2]))") + f" AS a{r}" for r in range(3)]
    second = [unit(two, r, " + ".join(f"a{i} * {w!r}::DOUBLE"
                                      for i, w in enumerate(two.weights[r]))) + f" AS b{r}"
              for r in range(2)]
    return f"""WITH {V_SQL}, st AS (SELECT item_id, list_transform(list_zip(unit, {lst(h.mu)},
    {lst(h.sd)}), lambda z: (z[1] - z[2]) / z[3]) AS st FROM u),
l1 AS (SELECT item_id, {', '.join(first)} FROM st),
l2 AS (SELECT item_id, {', '.join(second)} FROM l1)
SELECT item_id, round(b0 * {h.weights[0]!r}::DOUBLE + b1 * {h.weights[1]!r}::DOUBLE
    + {h.bias!r}::DOUBLE, 6) AS logit FROM l2"""


@query("v4_mlp_head", mlp_sql())
def v4_mlp(spark, sf):
    return r6(features(spark, sf).select(
        "item_id", H.head_logit(F.col("v"), small_mlp()).alias("logit")))


@query("v5_platt_probability", f"""WITH {V_SQL}, z AS (SELECT item_id, {logit_sql(HEADS[1])} AS q
    FROM u), pr AS (SELECT item_id, {prob_sql(HEADS[1], 'q')} AS p FROM z)
SELECT item_id, round(p, 6) AS p, CASE WHEN p >= {HEADS[1].operating_point!r}::DOUBLE THEN 'fake'
    ELSE 'real' END AS verdict FROM pr""")
def v5(spark, sf):
    h = HEADS[1]
    rows = features(spark, sf).select(
        "item_id", H.probability(H.head_logit(F.col("v"), h), h).alias("p"))
    return r6(rows.withColumn("verdict", F.when(
        F.col("p") >= h.operating_point, "fake").otherwise("real")))


@query("v6_compatible_members", f"""WITH {V_SQL}, m AS (SELECT member FROM
    (VALUES ('first'), ('second'), ('third')) t(member))
SELECT member, item_id, round(CASE member {" ".join(f"WHEN '{h.name}' THEN {logit_sql(h)}" for h in HEADS[:3])} END, 6) AS logit
FROM u, m""")
def v6(spark, sf):
    return r6(H.member_scores(features(spark, sf), "v", HEADS).select("member", "item_id", "logit"))


@query("v7_class_weight", f"""WITH {V_SQL} SELECT count(*) FILTER (WHERE y = 0)::BIGINT AS n_neg,
    count(*) FILTER (WHERE y = 1)::BIGINT AS n_pos, round(count(*) FILTER (WHERE y = 0)::DOUBLE
    / greatest(count(*) FILTER (WHERE y = 1), 1), 6) AS pos_weight FROM u""")
def v7(spark, sf):
    return r6(H.class_weight(features(spark, sf)))


@query("v10_class_logits", f"""WITH {V_SQL}, z AS (SELECT item_id, CASE WHEN item_id % 2 = 0
    THEN list_transform(v, lambda x: x * 10) ELSE [list_sum(v) * 10]
    END AS o FROM u)
SELECT item_id, round(CASE WHEN len(o) = 1 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-o[1]))
    ELSE exp(o[2]) / list_sum(list_transform(o, lambda x: exp(x))) END, 6) AS p FROM z""")
def v10(spark, sf):
    every = F.transform("v", lambda x: x * 10.0)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) * 10.0
    outputs = F.when(F.col("item_id") % 2 == 0, every).otherwise(F.array(total))
    return r6(features(spark, sf).select(
        "item_id", V.positive_probability(outputs, 1).alias("p")))


MEMBERS_SQL = " + ".join(prob_sql(h, logit_sql(h)) for h in HEADS[:3])


@query("j7_ensemble", f"""WITH {V_SQL}, s AS (SELECT item_id, ({MEMBERS_SQL}) / 3 AS p FROM u)
SELECT item_id, round(p, 6) AS p, round({H.ensemble_threshold(HEADS)!r}::DOUBLE, 6) AS threshold
FROM s""")
def j7(spark, sf):
    return r6(H.ensemble_scores(features(spark, sf), "v", HEADS).select(
        "item_id", "p", F.lit(H.ensemble_threshold(HEADS)).alias("threshold")))


SCALES = (1.0, -1.0, 0.9, -0.9)
VIEWS_SQL = f"""vw AS (SELECT item_id, y, view_id, list_transform(v, lambda x: x * scale) AS v
    FROM v0, (VALUES (0, 1.0::DOUBLE), (1, -1.0::DOUBLE), (2, 0.9::DOUBLE), (3, -0.9::DOUBLE))
    t(view_id, scale)),
vn AS (SELECT *, {NORM.format(v='v')} + 1e-8 AS nv FROM vw),
vu AS (SELECT item_id, y, view_id, list_transform(v, lambda x: x / nv) AS unit FROM vn),
vz AS (SELECT item_id, y, view_id, {logit_sql(HEADS[0])} AS s FROM vu)"""


def view_logits(spark, sf):
    views = H.scaled_views(features(spark, sf), "v", SCALES)
    return views.withColumn("s", H.head_logit(F.col("v"), HEADS[0]))


@query("a19_view_pooling", f"""WITH {V_SQL}, {VIEWS_SQL}
SELECT item_id, round(avg({prob_sql(HEADS[0], 's')}), 6) AS p, count(*)::BIGINT AS views FROM vz
WHERE NOT (item_id % 7 = 0 AND view_id = 2) GROUP BY item_id""")
def a19(spark, sf):
    failed = (F.col("item_id") % 7 == 0) & (F.col("view_id") == 2)
    p = H.probability(F.col("s"), HEADS[0])
    rows = view_logits(spark, sf).withColumn("p", F.when(failed, float("nan")).otherwise(p))
    return H.pool_views(rows, ["item_id"])


@query("a34_vector_views", f"""WITH {V_SQL}, {VIEWS_SQL},
{X.ladder_sql('vz', 'view_id', 'vl')}, pv AS (SELECT view_id, {AUC_SQL} AS auc FROM vl
    GROUP BY view_id)
SELECT round(max(auc) FILTER (WHERE view_id = 0), 6) AS auc_clean, round(avg(auc), 6) AS auc_mean,
    round(min(auc), 6) AS auc_worst FROM pv""")
def a34(spark, sf):
    return r6(D.view_metrics(view_logits(spark, sf)).select(
        "auc_clean", "auc_mean", "auc_worst"))


LOSS_SQL = """(CASE WHEN y = 1 THEN 1.0::DOUBLE * (greatest(s, 0.0::DOUBLE) + ln(1.0::DOUBLE
    + exp(-abs(s))) - s) ELSE greatest(s, 0.0::DOUBLE) + ln(1.0::DOUBLE + exp(-abs(s))) END)"""


@query("w6_hardest_views", f"""WITH {V_SQL}, {VIEWS_SQL},
r AS (SELECT item_id, {LOSS_SQL} AS loss, row_number() OVER (PARTITION BY item_id
    ORDER BY {LOSS_SQL} DESC, view_id) AS rk FROM vz)
SELECT item_id, round(avg(loss), 6) AS loss, count(*)::BIGINT AS views FROM r WHERE rk <= 2
GROUP BY item_id""")
def w6(spark, sf):
    rows = view_logits(spark, sf).withColumn(
        "loss", H.view_loss(F.col("s"), F.col("y"), F.lit(1.0)))
    return r6(S.hardest_views(rows, "item_id", "loss", len(SCALES)).groupBy("item_id").agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("views")))


@query("a38_dimension_health", f"""WITH {V_SQL}, r AS (SELECT unnest(v) AS x,
    unnest(range(0, len(v)))::INTEGER AS dim FROM u)
SELECT dim, count(*)::BIGINT AS n, count(*) FILTER (WHERE isnan(x))::BIGINT AS n_nan,
    count(*) FILTER (WHERE isinf(x))::BIGINT AS n_inf, round(avg(x), 6) AS mean,
    round(stddev_pop(x), 6) AS sd, stddev_pop(x) < 1e-8 AS constant FROM r GROUP BY dim""")
def a38(spark, sf):
    return r6(H.dimension_health(features(spark, sf), "v"))


COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / ({na} * {nb} + 1e-8)"


@query("a38_collapse_check", f"""WITH {V_SQL},
mean AS (SELECT list(mu ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS mu FROM (
    SELECT unnest(unit) AS x, unnest(range(0, len(unit))) AS dim FROM u) q GROUP BY dim) q2),
c AS (SELECT arg_min(unit, item_id) AS a FROM u),
r AS (SELECT {COS.format(a='unit', b='a', na=NORM.format(v='unit'), nb=NORM.format(v='a'))} AS f,
    {COS.format(a='unit', b='m', na=NORM.format(v='unit'), nb=NORM.format(v='m'))} AS g
    FROM u, c, mean)
SELECT count(*)::BIGINT AS n, round(min(f), 6) AS min_to_first, round(avg(f), 6) AS mean_to_first,
    round(min(g), 6) AS min_to_mean, CASE WHEN min(f) <= 0.999 THEN 'distinct'
    WHEN min(g) >= {math.cos(math.acos(0.999) / 2)!r} THEN 'collapsed' ELSE 'nearly collapsed'
    END AS verdict FROM r""")
def a38_collapse(spark, sf):
    return r6(H.collapse_check(features(spark, sf), "v", "item_id"))


@query("a38_exact_copies", """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id,
    [l_discount, l_tax, l_quantity] AS v FROM lineitem)
SELECT min(id)::BIGINT AS first_item, count(*)::BIGINT AS items,
    (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM x GROUP BY v HAVING count(*) > 1""")
def a38_copies(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.array("l_discount", "l_tax", "l_quantity").alias("v"))
    return H.exact_copies(lines, "v", "id")


@query("a38_near_classes", """WITH RECURSIVE w AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id * 2 AS id, e FROM w UNION ALL SELECT vec_id * 2 + 1, list_concat(
    [e[1] + CASE vec_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.02 ELSE 0.07 END], e[2:]) FROM w),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) > 0.999),
reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.id AS item, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(other) AS class_id
FROM reach r LEFT JOIN n ON n.a = r.id GROUP BY r.id""")
def a38_near(spark, sf):
    """Every embedding and a copy of it, moved by nothing, a little, or too much for a link."""
    rows = X.table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e"))
    shift = F.when(F.col("vec_id") % 3 == 0, 0.0).when(F.col("vec_id") % 3 == 1, 0.02).otherwise(0.07)
    moved = F.transform("e", lambda x, i: F.when(i == 0, x + shift).otherwise(x))
    both = rows.select((F.col("vec_id") * 2).alias("item"), "e").unionByName(rows.select((F.col("vec_id") * 2 + 1).alias("item"), moved.alias("e")))
    return NV.near_classes(both, "e", "item")


def prepared_views(spark, sf):
    """Prepared vectors of four views; a hash of the id splits train from validation."""
    moments = H.feature_moments(features(spark, sf), "v")
    views = H.scaled_views(features(spark, sf), "v", (1.0, 0.8, 1.2, 0.5))
    rows = H.with_prepared(views, "v", moments, l2=False)
    return rows.withColumn("fold", F.pmod(F.xxhash64("item_id"), F.lit(4)))


@query("v8_head_fit", f"""WITH {V_SQL}, t AS (SELECT count(DISTINCT y) = 2 AS fine FROM u)
SELECT r.round::INTEGER AS round, fine AS worst_is_least, fine AS in_range, fine AS best_has_most,
    1::BIGINT AS n_best FROM t, range(0, 2) r(round)""")
def v8(spark, sf):
    """What must hold of any fit: view AUCs in order and in range, the best worst-view round kept."""
    rows = prepared_views(spark, sf)
    fit = TR.fit_head(rows.where("fold > 0"), rows.where("fold = 0"), rounds=2, views=4,
                      iterations=15)
    h, every = TR.history_rows(spark, fit), Window.partitionBy(F.lit(1))   # one row per round
    mark = 1e-9
    return h.select(
        "round",
        ((F.col("auc_worst") <= F.col("auc_mean") + mark)
         & (F.col("auc_worst") <= F.col("auc_clean") + mark)).alias("worst_is_least"),
        (F.col("auc_worst").between(0, 1) & F.col("auc_pooled").between(0.4, 1)
         & F.col("fpr95_pooled").between(0, 1)).alias("in_range"),
        (F.max(F.when(F.col("best"), F.col("auc_worst"))).over(every)
         == F.max("auc_worst").over(every)).alias("best_has_most"),
        F.count(F.when(F.col("best"), 1)).over(every).alias("n_best"))


@query("v8_minimax_fit", f"""WITH {V_SQL} SELECT dim::INTEGER AS dim, (SELECT count(*) FROM u)::BIGINT AS n, 0.0::DOUBLE AS gradient, 1.0::DOUBLE AS view_weights
FROM range(0, {DIM + 1}) r(dim)""")
def v8_minimax(spark, sf):
    """The optimum of the worst-view objective is where the gradient of every weight vanishes; it is summed up here again, by columns."""
    rows = prepared_views(spark, sf)
    reg = 1e-2
    fit = MM.fit_minimax(rows, sharpness=10.0, reg=reg, tolerance=1e-6)
    share = F.create_map(*[F.lit(k) for v, q in fit.view_weights.items() for k in (int(v), float(q))])
    balance = rows.agg((F.count(F.when(F.col("y") == 0, 1)) / F.count(F.when(F.col("y") == 1, 1))).alias("balance"))
    logit = V.dot(F.col("x"), V.literal(fit.weights)) + fit.bias
    slope = F.when(F.col("y") == 1, F.col("balance")).otherwise(1.0) * (sigmoid(logit) - F.col("y"))
    flat = attach_row(rows, balance).select("view_id", slope.alias("g"), F.posexplode(F.concat(F.col("x"), F.array(F.lit(1.0)))).alias("dim", "x"))
    ridge = F.when(F.col("dim") < DIM, F.get(V.literal(fit.weights), F.col("dim"))).otherwise(0.0) * reg
    per = flat.groupBy("view_id", "dim").agg(F.avg(F.col("g") * F.col("x")).alias("g"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("dim").agg(F.max("n").alias("n"), F.sum(F.col("g") * share[F.col("view_id")]).alias("g"), F.sum(share[F.col("view_id")]).alias("q")).select(
        "dim", "n", (F.round(F.col("g") + ridge, 4) + F.lit(0.0)).alias("gradient"), F.round("q", 6).alias("view_weights"))


@query("v9_platt_fit", f"""WITH {X.E_SQL} SELECT count(*)::BIGINT AS n, 0.0::DOUBLE AS offset_gradient,
    0.0::DOUBLE AS slope_gradient FROM e""")
def v9(spark, sf):
    """The fit is the one point where both mean gradients of the loss are zero."""
    rows = X.scored_events(spark, sf)
    broken = rows.limit(1).withColumn("s", F.lit(float("nan")))
    a, b = TR.fit_platt(rows.unionByName(broken))
    gap = sigmoid(F.col("s") * a + b) - F.col("y")
    zero = F.lit(0.0)
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.avg(gap), 4) + zero).alias("offset_gradient"),
        (F.round(F.avg(gap * F.col("s")), 4) + zero).alias("slope_gradient"))


@query("e1_scored_items", f"""WITH {V_SQL}, z AS (SELECT item_id, {logit_sql(HEADS[0])} AS q
    FROM u) SELECT item_id, round({prob_sql(HEADS[0], 'q')}, 6) AS score, NULL::VARCHAR AS error
FROM z""")
def e1(spark, sf):
    scorer = SC.VectorHeadScorer(HEADS[0])
    return r6(SC.score(features(spark, sf).select("item_id", "v"), scorer, ["item_id"]))


@query("e1_failing_batches", f"""WITH {V_SQL} SELECT count(*)::BIGINT AS n, 0::BIGINT AS scored,
    count(*)::BIGINT AS failed FROM u""")
def e1_failing(spark, sf):
    return SC.score(features(spark, sf).select("item_id", "v"), SC.VectorHeadScorer(
        H.Head(weights=[1.0], bias=0.0, mu=[0.0], sd=[1.0])), ["item_id"]).groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"),
        F.count("error").alias("failed"))


@query("e4_verdict_rows", f"""WITH {V_SQL}, z AS (SELECT item_id, {logit_sql(HEADS[0])} AS q
    FROM u), pr AS (SELECT item_id, {prob_sql(HEADS[0], 'q')} AS p FROM z)
SELECT item_id, CASE WHEN p >= {HEADS[0].operating_point!r}::DOUBLE THEN 'fake' ELSE 'real' END
    AS verdict, round(p, 6) AS probability_fake FROM pr""")
def e4(spark, sf):
    scorer = SC.VectorHeadScorer(HEADS[0])
    rows = SC.score(features(spark, sf).select("item_id", "v"), scorer, ["item_id"])
    return r6(SC.verdict_rows(rows, scorer.default_threshold, ["item_id"]).select(
        "item_id", "verdict", "probability_fake"))
