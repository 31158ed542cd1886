"""Label inference, predicates, joins, result views and prediction rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.functions import labels as N
from verigauge.operators import labelling as LB
from verigauge.operators import metrics as M
from verigauge.operators import results as R
from verigauge.operators import sampling as S
from verigauge.plans import fixtures as X
from verigauge.plans.metric_queries import fold_sql, metrics_sql, rates_sql
from verigauge.plans.registry import query, r6

# the tables have no real/ and ai/ folders, so language codes play the tokens
WORDS = LB.Tokens(real=("en", "fr"), ai=("de", "es"))
WORD_SQL = "CASE WHEN {t} IN ('en', 'fr') THEN 0 WHEN {t} IN ('de', 'es') THEN 1 END"


def page_items(spark, sf):
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[?#].*$", "")
    return X.table(spark, sf, "pages").select("page_id", url.alias("rel_path"))


PAGES_SQL = """p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''),
    '[?#].*$', '') AS rel_path FROM pages)"""


def doc_items(spark, sf):
    """Documents as files: /data/<source>/<lang>_<id>.txt"""
    rel = F.concat_ws("/", "source", F.concat(F.col("lang"), F.lit("_"), F.col("doc_id"),
                                              F.lit(".txt")))
    return X.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), rel).alias("path"), rel.alias("rel_path"))


DOCS_SQL = """f AS (SELECT doc_id, '/data/' || source || '/' || lang || '_' || doc_id || '.txt'
    AS path, source || '/' || lang || '_' || doc_id || '.txt' AS rel_path FROM documents)"""


@query("p1_token_label", f"""SELECT lang, {WORD_SQL.format(t='lower(trim(lang))')} AS label,
    count(*)::BIGINT AS n FROM documents GROUP BY lang""")
def p1(spark, sf):
    label = N.token_label(F.col("lang"), WORDS.real, WORDS.ai)
    return X.table(spark, sf, "documents").groupBy("lang", label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p2_directory_label", f"""WITH {PAGES_SQL},
parts AS (SELECT page_id, string_split(rel_path, '/') AS a FROM p),
dirs AS (SELECT page_id, unnest(a[1:len(a) - 1]) AS d, unnest(range(1, len(a))) AS i FROM parts),
lab AS (SELECT page_id, i, {WORD_SQL.format(t='lower(trim(d))')} AS v FROM dirs)
SELECT p.page_id, arg_max(v, i) FILTER (WHERE v IS NOT NULL) AS label
FROM p LEFT JOIN lab USING (page_id) GROUP BY p.page_id""")
def p2(spark, sf):
    return page_items(spark, sf).select(
        "page_id", N.directory_label(F.col("rel_path"), WORDS.real, WORDS.ai).alias("label"))


@query("p3_filename_label", f"""WITH {DOCS_SQL},
t AS (SELECT doc_id, regexp_extract(string_split(path, '/')[-1],
    '^(en|de|fr)[_\\-.]', 1) AS w FROM f)
SELECT doc_id, {WORD_SQL.format(t='w')} AS label FROM t""")
def p3(spark, sf):
    name = N.base_name(F.col("path"))
    return doc_items(spark, sf).select("doc_id", N.filename_label(
        name, r"^(en|de|fr)[_\-.]", WORDS.real, WORDS.ai).alias("label"))


# labels re-spelled the way manifests spell them
SPELLED_SQL = """CASE WHEN quality = 1 AND toxic = 1 THEN 'ai' WHEN toxic = 1 THEN ' TRUE '
    WHEN quality = 0 AND doc_id % 2 = 0 THEN '0.83' WHEN quality = 0 THEN 'No'
    WHEN doc_id % 3 = 0 THEN 'Real' WHEN doc_id % 3 = 1 THEN '' ELSE '1' END"""
COERCED_SQL = """CASE WHEN lower(trim(cell)) IN ('1', 'true', 'yes', 'ai') THEN 1
    WHEN lower(trim(cell)) IN ('0', 'false', 'no', 'real') THEN 0 END"""


@query("p4_coerce_label", f"""WITH s AS (SELECT doc_id, {SPELLED_SQL} AS cell,
    (quality + toxic) / 2.0::DOUBLE AS prob FROM labels)
SELECT doc_id, cell, {COERCED_SQL} AS label,
    CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS prob_label FROM s""")
def p4(spark, sf):
    rows = X.table(spark, sf, "labels").withColumn("cell", F.expr(SPELLED_SQL.replace(
        "::DOUBLE", "D"))).withColumn("prob", (F.col("quality") + F.col("toxic")) / F.lit(2.0))
    return rows.select("doc_id", "cell", N.coerce_label(F.col("cell")).alias("label"),
                       N.coerce_label(F.col("prob"), "double").alias("prob_label"))


def doc_manifest(spark, sf):
    """Manifest rows for the labelled documents: absolute, relative and bare paths in turn.

    Each document is listed a second time later on, under its bare name and with
    the opposite label, so that all precedence rules come into play.
    """
    docs = doc_items(spark, sf).join(X.table(spark, sf, "labels"), "doc_id")
    name = N.base_name(F.col("path"))
    way = F.col("doc_id") % 3
    first = docs.select(
        F.col("doc_id").alias("row_no"),
        F.when(way == 0, F.col("path")).when(way == 1, F.col("rel_path")).otherwise(name)
        .alias("file"), F.when(F.col("toxic") == 1, "ai").otherwise("real").alias("label"))
    again = docs.select(
        (F.col("doc_id") + 1_000_000_000_000).alias("row_no"),
        F.when(way == 1, F.col("rel_path")).otherwise(F.concat(F.lit("sub/"), name)).alias("file"),
        F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("label"))
    return first.unionByName(again)


MANIFEST_SQL = """j AS (SELECT f.doc_id, f.path, f.rel_path, string_split(f.path, '/')[-1] AS name,
    l.toxic FROM f JOIN labels l ON f.doc_id = l.doc_id),
m AS (SELECT doc_id AS row_no, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN rel_path
    ELSE name END AS raw, toxic AS label FROM j
    UNION ALL SELECT doc_id + 1000000000000, CASE doc_id % 3 WHEN 1 THEN rel_path
    ELSE 'sub/' || name END, 1 - toxic FROM j),
sp AS (SELECT row_no, label, true AS exact,
    CASE WHEN raw LIKE '/%' THEN raw ELSE '/data/' || raw END AS spelling FROM m
    UNION ALL SELECT row_no, label, true, raw FROM m
    UNION ALL SELECT row_no, label, false, string_split(raw, '/')[-1] FROM m),
lk AS (SELECT spelling, coalesce(arg_max(label, row_no) FILTER (WHERE exact),
    arg_min(label, row_no) FILTER (WHERE NOT exact)) AS label FROM sp GROUP BY spelling)"""
JOINED_SQL = """(SELECT f.doc_id, f.path, f.rel_path, coalesce(a.label, b.label, c.label) AS v FROM f
    LEFT JOIN lk a ON a.spelling = f.path LEFT JOIN lk b ON b.spelling = f.rel_path
    LEFT JOIN lk c ON c.spelling = string_split(f.path, '/')[-1])"""


@query("j1_manifest_join", f"""WITH {DOCS_SQL}, {MANIFEST_SQL}
SELECT doc_id, v AS manifest_label FROM {JOINED_SQL} x""")
def j1(spark, sf):
    lookup = LB.manifest_lookup(doc_manifest(spark, sf), "/data")
    return LB.join_manifest(doc_items(spark, sf), lookup).select("doc_id", "manifest_label")


@query("p5_auto_labels", f"""WITH {DOCS_SQL}, {MANIFEST_SQL}, x AS {JOINED_SQL},
k AS (SELECT count(v) AS n FROM x)
SELECT x.doc_id, x.v AS label, 'manifest' AS label_mode, k.n::BIGINT AS labelled FROM x, k""")
def p5(spark, sf):
    lookup = LB.manifest_lookup(doc_manifest(spark, sf), "/data")
    return LB.apply_labels(doc_items(spark, sf), LB.AUTO, lookup).select(
        "doc_id", "label", "label_mode", "labelled")


@query("p5_auto_labels_folders", f"""WITH f AS (SELECT doc_id, {WORD_SQL.format(t='lang')} AS v
    FROM documents), k AS (SELECT count(v) AS n FROM f)
SELECT doc_id, v AS label, '{LB.SUBFOLDER}' AS label_mode, k.n::BIGINT AS labelled FROM f, k""")
def p5_folders(spark, sf):
    rel = F.concat(F.col("lang"), F.lit("/x/"), F.col("doc_id"), F.lit(".txt"))
    items = X.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), rel).alias("path"), rel.alias("rel_path"))
    return LB.apply_labels(items, LB.AUTO, tokens=WORDS).select(
        "doc_id", "label", "label_mode", "labelled")


@query("p5_auto_labels_names", f"""WITH f AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 0
    WHEN lang = 'de' THEN 1 END AS v FROM documents), k AS (SELECT count(v) AS n FROM f)
SELECT doc_id, v AS label, '{LB.FILENAME}' AS label_mode, k.n::BIGINT AS labelled FROM f, k""")
def p5_names(spark, sf):
    return LB.apply_labels(doc_items(spark, sf), LB.AUTO, None, r"^(en|de|fr)[_\-.]", WORDS).select(
        "doc_id", "label", "label_mode", "labelled")


@query("p6_labels_ignored", """SELECT doc_id, NULL::INTEGER AS label, 'none' AS label_mode,
    0::BIGINT AS labelled FROM documents""")
def p6(spark, sf):
    return LB.apply_labels(doc_items(spark, sf), LB.NONE).select(
        "doc_id", "label", "label_mode", "labelled")


# a document of fewer than 50 characters counts as one that could not be scored
FAIL_SQL = "CASE WHEN n_chars >= 50 THEN s END"
DF_SQL = f"{X.D_SQL}, df AS (SELECT * REPLACE ({FAIL_SQL} AS s) FROM d)"


def some_failed(spark, sf):
    return X.partly_labelled(spark, sf).withColumn(
        "s", F.when(F.col("n_chars") >= 50, F.col("s")))


@query("p7_verdict", f"""WITH {DF_SQL} SELECT item_id, CASE WHEN s >= 0.5 THEN 'fake'
    WHEN s IS NOT NULL THEN 'real' END AS verdict FROM df""")
def p7(spark, sf):
    return some_failed(spark, sf).select("item_id", N.verdict(F.col("s"), 0.5).alias("verdict"))


@query("p8_valid_pairs", f"""WITH {DF_SQL} SELECT item_id, y, round(s, 6) AS s FROM df
WHERE y IS NOT NULL AND s IS NOT NULL""")
def p8(spark, sf):
    return r6(some_failed(spark, sf).where("y IS NOT NULL AND s IS NOT NULL")
              .select("item_id", "y", "s"))


@query("p9_result_filters", f"""WITH {DF_SQL}, v AS (SELECT item_id, y,
    CASE WHEN s IS NOT NULL THEN CAST(s >= 0.5 AS INTEGER) END AS pred FROM df)
SELECT kind, item_id FROM v, (VALUES ('all'), ('ai'), ('real'), ('fp'), ('fn')) k(kind)
WHERE kind = 'all' OR (kind = 'ai' AND pred = 1) OR (kind = 'real' AND pred = 0)
    OR (kind = 'fp' AND pred = 1 AND y = 0) OR (kind = 'fn' AND pred = 0 AND y = 1)""")
def p9(spark, sf):
    pred = N.predicted(F.col("s"), 0.5)
    kinds = ("all", "ai", "real", "fp", "fn")
    hits = F.array_compact(F.array(*[
        F.when(N.result_filter(F.col("y"), pred, k), F.lit(k)) for k in kinds]))
    return some_failed(spark, sf).select(F.explode(hits).alias("kind"), "item_id")


@query("p10_result_text", f"""WITH {DF_SQL}, v AS (SELECT item_id, y,
    CASE WHEN s IS NOT NULL THEN CAST(s >= 0.5 AS INTEGER) END AS pred FROM df)
SELECT item_id, CASE WHEN y IS NULL OR pred IS NULL THEN '—' WHEN y = pred THEN '✓'
    WHEN pred = 1 THEN '✗ FP' ELSE '✗ FN' END AS result FROM v""")
def p10(spark, sf):
    return some_failed(spark, sf).select("item_id", N.result_text(
        F.col("y"), N.predicted(F.col("s"), 0.5)).alias("result"))


@query("p11_score_bands", f"""WITH {DF_SQL} SELECT CASE WHEN s IS NULL THEN 'none'
    WHEN s < 0.35 THEN 'real' WHEN s < 0.65 THEN 'warn' ELSE 'ai' END AS band,
    CASE WHEN s IS NULL THEN 'none' WHEN s - 0.5 >= -0.02 THEN 'good'
    WHEN s - 0.5 >= -0.1 THEN 'warn' ELSE 'bad' END AS delta_band, count(*)::BIGINT AS n
FROM df GROUP BY ALL""")
def p11(spark, sf):
    return some_failed(spark, sf).groupBy(
        N.score_band(F.col("s")).alias("band"),
        N.delta_band(F.col("s") - 0.5).alias("delta_band")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_keyword_filter", """SELECT doc_id FROM documents
WHERE contains(lower(source || ' ' || text), 'heron') OR contains(lower(source || ' ' || text),
    'license') OR contains(lower(source || ' ' || text), 'src1')""")
def p12(spark, sf):
    hit = N.keyword_match(["heron", "License ", "src1"], F.col("source"), F.col("text"))
    return X.table(spark, sf, "documents").where(hit).select("doc_id")


@query("p13_url_choice", """SELECT page_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END
    || 'w=1024&fm=jpg&q=85' AS url FROM (SELECT page_id, coalesce(nullif(
    CASE WHEN page_id % 2 = 0 THEN '' ELSE regexp_replace(url, '#.*$', '') END, ''), url) AS u
    FROM pages) t""")
def p13(spark, sf):
    main = F.when(F.col("page_id") % 2 == 0, "").otherwise(
        F.regexp_replace(F.col("url"), "#.*$", ""))
    return X.table(spark, sf, "pages").select(
        "page_id", N.resized_url(1024, main, F.col("url")).alias("url"))


@query("p14_group_slug", """WITH g AS (SELECT event_type AS raw FROM events
    UNION ALL SELECT p_name FROM (SELECT 'DALL-E ' || (l_linenumber % 4) AS p_name FROM lineitem)
    UNION ALL SELECT '--' || l_returnflag || '.' FROM lineitem
    UNION ALL SELECT '?' || CASE WHEN l_linestatus = 'O' THEN '' ELSE '!' END FROM lineitem)
SELECT raw, CASE WHEN regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') = 'dalle3' THEN 'DALLE3'
    WHEN trim(regexp_replace(raw, '[^A-Za-z0-9]', '_', 'g'), '_') <> ''
    THEN trim(regexp_replace(raw, '[^A-Za-z0-9]', '_', 'g'), '_') ELSE 'unknown' END AS slug,
    count(*)::BIGINT AS n FROM g GROUP BY ALL""")
def p14(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    names = F.array(F.concat(F.lit("DALL-E "), F.col("l_linenumber") % 4),
                    F.concat(F.lit("--"), "l_returnflag", F.lit(".")),
                    F.when(F.col("l_linestatus") == "O", "?").otherwise("?!"))
    raw = X.table(spark, sf, "events").select(F.col("event_type").alias("raw")).unionByName(
        lines.select(F.explode(names).alias("raw")))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", N.group_slug(F.col("raw")).alias("slug"), "n")


@query("p15_size_guards", """SELECT count(*) FILTER (WHERE l_partkey * (l_orderkey * 10)
    <= 200000000)::BIGINT AS readable, count(*) FILTER (WHERE l_extendedprice >= 5000)::BIGINT
    AS large_enough, count(*)::BIGINT AS n FROM lineitem""")
def p15(spark, sf):
    return X.table(spark, sf, "lineitem").agg(
        F.count(F.when(N.readable_size(F.col("l_partkey"), F.col("l_orderkey") * 10, 200_000_000), 1))
        .alias("readable"),
        F.count(F.when(N.real_payload(F.col("l_extendedprice")), 1)).alias("large_enough"),
        F.count(F.lit(1)).alias("n"))


@query("p18_guards", f"""WITH {DF_SQL}, c AS (SELECT count(*)::BIGINT AS n,
    count(*) FILTER (WHERE y = 0)::BIGINT AS n_real, count(*) FILTER (WHERE y = 1)::BIGINT AS n_ai
    FROM df) SELECT n > 0 AS any_items, n_real + n_ai > 0 AS has_labels,
    n_real > 0 AND n_ai > 0 AS both_classes FROM c""")
def p18(spark, sf):
    b = LB.class_balance(some_failed(spark, sf), "y")
    return b.select((F.col("n") > 0).alias("any_items"), "has_labels",
                    ((F.col("n_real") > 0) & (F.col("n_ai") > 0)).alias("both_classes"))


@query("p19_class_of_folder", f"""WITH {DOCS_SQL}, t AS (SELECT string_split(rel_path, '/')[1] AS top
    FROM f) SELECT CASE WHEN top IN ('src0', 'src1') THEN 'real' WHEN top = 'src2' THEN 'fake' END
    AS cls, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def p19(spark, sf):
    top = F.regexp_replace(F.regexp_replace("rel_path", "^src[01]/", "real/"), "^src2/", "ai/")
    return doc_items(spark, sf).groupBy(
        LB.class_of_folder(top, laid_out=False).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("j2_mask_fraction", f"""WITH {DOCS_SQL} SELECT f.doc_id,
    round(b.s, 6) AS fraction FROM f LEFT JOIN (SELECT f2.doc_id, string_split(f2.path, '/')[-1]
    AS name, d.n_chars / (d.n_chars + 1500.0::DOUBLE) AS s FROM f f2
    JOIN documents d ON d.doc_id = f2.doc_id JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.toxic = 1) b ON b.name = string_split(f.path, '/')[-1]""")
def j2(spark, sf):
    items = doc_items(spark, sf)
    # the fractions arrive as a map from file name to share, one entry per row here
    n = F.col("n_chars").cast("double")
    fractions = (
        items.join(X.table(spark, sf, "labels").where("toxic = 1"), "doc_id")
        .join(X.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(F.explode(F.create_map(N.base_name(F.col("path")), n / (n + 1500.0)))
                .alias("name", "fraction")))
    return r6(items.withColumn("name", N.base_name(F.col("path")))
              .join(fractions, "name", "left").select("doc_id", "fraction"))


@query("j3_resume", """SELECT doc_id FROM documents WHERE doc_id NOT IN
    (SELECT doc_id FROM labels)""")
def j3(spark, sf):
    return S.not_done(X.table(spark, sf, "documents").select("doc_id"),
                      X.table(spark, sf, "labels"), "doc_id")


@query("j4_overlap", """SELECT DISTINCT d.text AS "text" FROM documents d
    WHERE d.text IN (SELECT text FROM benchmark)""")
def j4(spark, sf):
    return S.overlap(X.table(spark, sf, "documents"), X.table(spark, sf, "benchmark"), "text")


@query("j4_overlap_lines", """WITH x AS (SELECT unnest(string_split(text, chr(10))) AS line
    FROM documents), b AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT DISTINCT line FROM x WHERE line IN (SELECT line FROM b)""")
def j4_lines(spark, sf):
    def lines(name):
        return X.table(spark, sf, name).select(F.explode(F.split("text", "\n")).alias("line"))
    return S.overlap(lines("documents"), lines("benchmark"), "line")


@query("a22_class_balance", f"""WITH {DF_SQL} SELECT count(*)::BIGINT AS n,
    count(*) FILTER (WHERE y = 0)::BIGINT AS n_real, count(*) FILTER (WHERE y = 1)::BIGINT AS n_ai,
    count(*) FILTER (WHERE y IS NULL)::BIGINT AS n_unlabeled, count(s)::BIGINT AS n_scored,
    count(*) FILTER (WHERE s IS NULL)::BIGINT AS failures,
    count(y) > 0 AS has_labels FROM df""")
def a22(spark, sf):
    return LB.class_balance(some_failed(spark, sf), "y", "s")


@query("a23_verdict_summary", f"""WITH {DF_SQL} SELECT count(*)::BIGINT AS total,
    count(*) FILTER (WHERE s >= 0.5)::BIGINT AS fake, count(*) FILTER (WHERE s < 0.5)::BIGINT
    AS "real", count(*) FILTER (WHERE s IS NULL)::BIGINT AS errors FROM df""")
def a23(spark, sf):
    return R.verdict_summary(some_failed(spark, sf), 0.5)


def _pct(c: str) -> str:
    return f"coalesce(format('{{:.1f}}%', {c} * 100), '—')"


def _dec(c: str) -> str:
    return f"coalesce(format('{{:.3f}}', {c}), '—')"


@query("a24_summary_text", f"""WITH m AS ({metrics_sql(X.E_SQL, 'e', '0.05')})
SELECT {_dec('threshold')} AS threshold, {_pct('accuracy')} AS accuracy, {_dec('auc')} AS auc,
    {_dec('f1')} AS f1, {_pct('"precision"')} AS "precision", {_pct('recall')} AS recall,
    {_pct('fpr')} AS fpr, format('TP {{}}  FP {{}}  TN {{}}  FN {{}}', tp, fp, tn, fn) AS counts
FROM m""")
def a24(spark, sf):
    return R.summary_text(r6(M.metrics(X.scored_events(spark, sf), 0.05)))


@query("k1_prediction_rows", f"""WITH {DF_SQL}, {DOCS_SQL} SELECT f.path AS image_path,
    coalesce(round(df.s, 6), 0.5::DOUBLE) AS pred, CASE WHEN df.s >= 0.5 THEN 'fake'
    WHEN df.s IS NOT NULL THEN 'real' END AS prediction
    FROM df JOIN f ON f.doc_id = df.item_id""")
def k1(spark, sf):
    rows = some_failed(spark, sf).join(
        doc_items(spark, sf), F.col("item_id") == F.col("doc_id"))
    return R.predictions(rows, 0.5)


@query("k2_prediction_table", f"""WITH {DF_SQL}, {DOCS_SQL}, v AS (SELECT f.rel_path, df.s, df.y,
    CASE WHEN df.s IS NOT NULL THEN CAST(df.s >= 0.5 AS INTEGER) END AS p
    FROM df JOIN f ON f.doc_id = df.item_id)
SELECT rel_path AS image_path, round(s, 6) AS pred, p AS predicted_label, y AS true_label,
    CASE WHEN p IS NOT NULL AND y IS NOT NULL THEN CAST(p = y AS INTEGER) END AS correct FROM v""")
def k2(spark, sf):
    rows = some_failed(spark, sf).join(
        doc_items(spark, sf), F.col("item_id") == F.col("doc_id"))
    return R.predictions_table(rows, 0.5, path="rel_path")


@query("k3_run_report", f"""WITH {DF_SQL}, {X.ladder_sql('df')},
fold AS ({fold_sql('0.5')}), m AS ({rates_sql('', 'fold')}),
b AS (SELECT count(*)::BIGINT AS n_images, count(*) FILTER (WHERE y = 0)::BIGINT AS all_real,
    count(*) FILTER (WHERE y = 1)::BIGINT AS all_ai,
    count(*) FILTER (WHERE y IS NULL)::BIGINT AS n_unlabeled, count(s)::BIGINT AS images_scored,
    count(*) FILTER (WHERE s IS NULL)::BIGINT AS images_failed FROM df)
SELECT b.*, accuracy, auc, f1, tp, fp, tn, fn, 'timestamp' AS generated_type, true AS just_now
FROM b, m""")
def k3(spark, sf):
    df = some_failed(spark, sf)
    report = R.run_report(LB.class_balance(df, "y", "s"), M.metrics(df, 0.5), "length score",
                          "/data", "manifest", 0.5)
    return r6(report.select(
        "dataset.n_images", F.col("dataset.n_real").alias("all_real"),
        F.col("dataset.n_ai").alias("all_ai"), "dataset.n_unlabeled", "run.images_scored",
        "run.images_failed", F.typeof("generated_at").alias("generated_type"),
        (F.col("generated_at").between(F.current_timestamp() - F.expr("INTERVAL 1 HOUR"),
                                       F.current_timestamp())).alias("just_now"),
        *[F.col(f"metrics.{c}").alias(c) for c in
                               ("accuracy", "auc", "f1", "tp", "fp", "tn", "fn")]))


ERR_SQL = f"""{X.E_SQL}, err AS (SELECT item_id, y AS "true", CAST(s >= 0.05 AS INTEGER) AS pred,
    s AS score, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(s * 4.0::DOUBLE - 0.5::DOUBLE))) AS prob,
    abs(s - 0.05::DOUBLE) AS confidence FROM e WHERE CAST(s >= 0.05 AS INTEGER) <> y)"""


@query("k7_error_manifest", f"""WITH {ERR_SQL} SELECT item_id, "true", pred,
    round(score, 6) AS score, round(prob, 6) AS prob, round(confidence, 6) AS confidence
FROM err""")
def k7(spark, sf):
    errs = R.errors(X.scored_events(spark, sf), 0.05, 4.0, -0.5)
    return r6(R.ranked_errors(errs))


@query("w7_worst_errors", f"""WITH {ERR_SQL}, k AS (SELECT *, CASE WHEN "true" = 0
    THEN 'false_positives' ELSE 'false_negatives' END AS kind FROM err)
SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, item_id))::INTEGER
    AS "rank", item_id, round(confidence, 6) AS confidence FROM k
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, item_id) <= 200""")
def w7(spark, sf):
    errs = R.errors(X.scored_events(spark, sf), 0.05, 4.0, -0.5)
    return r6(R.worst_errors(errs, 200).select("kind", "rank", "item_id", "confidence"))


@query("w8_top_negatives", f"""WITH {X.E_SQL} SELECT item_id, round(s, 6) AS score FROM e
WHERE y = 0 ORDER BY s DESC, item_id LIMIT 20""")
def w8(spark, sf):
    return r6(R.top_negatives(X.scored_events(spark, sf)))


@query("w9_sorted_results", f"""WITH {DF_SQL}, v AS (SELECT item_id, s, y,
    CASE WHEN s IS NOT NULL THEN CAST(s >= 0.5 AS INTEGER) END AS pred FROM df)
SELECT item_id, round(coalesce(s, -1.0), 6) AS sort_score,
    coalesce(format('{{:.4f}}', s), '—') AS score_text,
    CASE WHEN y IS NULL THEN '—' WHEN y = 1 THEN 'AI' ELSE 'Real' END AS truth,
    CASE WHEN y IS NULL OR pred IS NULL THEN '—' WHEN y = pred THEN '✓'
    WHEN pred = 1 THEN '✗ FP' ELSE '✗ FN' END AS result FROM v""")
def w9(spark, sf):
    return r6(R.sorted_view(R.result_view(some_failed(spark, sf), 0.5)))
