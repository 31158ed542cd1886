"""Caps, samples, splits and collection audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from verigauge.operators import audit as A
from verigauge.operators import labelling as LB
from verigauge.operators import sampling as S
from verigauge.operators.scalars import attach_row
from verigauge.plans import fixtures as X
from verigauge.plans.label_queries import DOCS_SQL, doc_items
from verigauge.plans.registry import query, r6


@query("p17_first_per_class", f"""WITH {X.E_SQL} SELECT item_id, y, grp FROM e
QUALIFY row_number() OVER (PARTITION BY y ORDER BY grp, item_id) <= 250""")
def p17(spark, sf):
    return S.top_per_group(X.scored_events(spark, sf).select("item_id", "y", "grp"), ["y"],
                           [F.col("grp"), F.col("item_id")], 250)


@query("p17_first_per_class_wide", f"""WITH {X.E_SQL} SELECT item_id, y, grp FROM e
QUALIFY row_number() OVER (PARTITION BY y ORDER BY grp, item_id) <= 3000""")
def p17_wide(spark, sf):
    return S.top_per_group(X.scored_events(spark, sf).select("item_id", "y", "grp"), ["y"],
                           [F.col("grp"), F.col("item_id")], 3000)


def turned(rows):
    """The same rows, dealt to other tasks in another order."""
    return rows.repartition(5, F.xxhash64("item_id", F.lit(3)))


def drawn_twice(one, two, keys):
    """Rows and distinct items per key of a draw, and whether a second draw took the same items."""
    marks = [(df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"),
        F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("mark"))) for df in (one, two)]
    right = marks[1].select(*[F.col(k).alias(f"{k}_2") for k in keys], F.col("mark").alias("mark_2"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    both = marks[0].join(right, same, "left") if keys else attach_row(marks[0], right)
    return both.select(*keys, "n", "items",
                       F.coalesce(F.col("mark") == F.col("mark_2"), F.lit(False)).alias("repeats"))


@query("w1_balanced_sample", f"""WITH {X.D_SQL}, t AS (SELECT y, count(*) AS n FROM d
    WHERE y IS NOT NULL GROUP BY y), h AS (SELECT greatest(1, least(100, min(n))) AS half,
    count(*) AS classes FROM t)
SELECT t.y, least(t.n, h.half)::BIGINT AS n, least(t.n, h.half)::BIGINT AS items,
    true AS repeats FROM t, h""")
def w1(spark, sf):
    rows = X.partly_labelled(spark, sf)
    return drawn_twice(S.balanced_sample(rows, 200, ["item_id"]),
                       S.balanced_sample(turned(rows), 200, ["item_id"]), ["y"])


@query("w2_offset_and_cap", f"""WITH {X.D_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY item_id) AS seen FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY item_id) AS kept FROM r
    WHERE seen > 20 AND n_chars >= 200)
SELECT item_id, lang FROM k WHERE kept <= 150""")
def w2(spark, sf):
    return S.offset_and_cap(
        X.partly_labelled(spark, sf).select("item_id", "lang", "n_chars"), ["lang"], "item_id",
        20, 150, F.col("n_chars") >= 200).select("item_id", "lang")


@query("w3_cap_groups", f"""WITH {X.D_SQL}, g AS (SELECT CASE WHEN y = 1 THEN grp END AS g,
    count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY ALL),
b AS (SELECT sum(least(n, 3)) AS budget FROM g WHERE g IS NOT NULL)
SELECT coalesce(g, 'negatives') AS grp, (CASE WHEN g IS NULL THEN least(n, budget)
    ELSE least(n, 3) END)::BIGINT AS n, (CASE WHEN g IS NULL THEN least(n, budget)
    ELSE least(n, 3) END)::BIGINT AS items, true AS repeats FROM g, b""")
def w3(spark, sf):
    rows = X.partly_labelled(spark, sf)
    name = F.when(F.col("y") == 1, F.col("grp")).otherwise("negatives")
    one, two = (S.cap_groups(r, 3, ["item_id"]).withColumn("grp", name)
                for r in (rows, turned(rows)))
    return drawn_twice(one, two, ["grp"])


SPLIT_SQL = """n AS (SELECT grp, count(*) AS n FROM e GROUP BY grp),
c AS (SELECT grp, n, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS a FROM n)
SELECT grp, split, k AS n, k AS items, true AS repeats FROM (
    SELECT grp, 'test' AS split, a AS k FROM c UNION ALL SELECT grp, 'val', a FROM c
    UNION ALL SELECT grp, 'train', n - 2 * a FROM c) t"""


@query("w4_three_way_split", f"WITH {X.E_SQL}, {SPLIT_SQL}")
def w4(spark, sf):
    rows = X.scored_events(spark, sf)
    one, two = (S.split_groups(r, ["grp"], ["item_id"], 0.15, 0.15) for r in (rows, turned(rows)))
    return drawn_twice(one, two, ["grp", "split"])


@query("w5_manifest_split", f"""WITH {X.D_SQL}, p AS (SELECT y, least(count(*), 150) AS n FROM d
    WHERE y IS NOT NULL GROUP BY y)
SELECT y, split, k::BIGINT AS n, k::BIGINT AS items, true AS repeats FROM (
    SELECT y, 'val' AS split, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS k FROM p
    UNION ALL SELECT y, 'train', n - round_even(n * 0.15::DOUBLE, 0)::BIGINT FROM p) t""")
def w5(spark, sf):
    rows = X.partly_labelled(spark, sf).where("y IS NOT NULL").select("item_id", "y")
    files = X.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    one, two = (S.manifest_split(r, files, "item_id", 150, 0.15) for r in (rows, turned(rows)))
    return drawn_twice(one, two, ["y", "split"])


@query("w10_shuffled_first", f"""WITH {X.E_SQL}, t AS (SELECT least(500, count(*)) AS k FROM e)
SELECT k::BIGINT AS n, k::BIGINT AS items, k::BIGINT AS known, true AS repeats FROM t""")
def w10(spark, sf):
    rows = X.scored_events(spark, sf).select("item_id")
    one, two = (S.shuffled_first(r, 500, ["item_id"]) for r in (rows, turned(rows)))
    known = one.join(rows, "item_id", "left_semi").groupBy().agg(F.count(F.lit(1)).alias("known"))
    return attach_row(drawn_twice(one, two, []), known).select("n", "items", "known", "repeats")


@query("w11_first_sorted", f"""WITH {DOCS_SQL} SELECT doc_id, path FROM f
ORDER BY path LIMIT 100""")
def w11(spark, sf):
    return doc_items(spark, sf).select("doc_id", "path").orderBy("path").limit(100)


@query("k8_layout", f"""WITH {X.D_SQL} SELECT item_id,
    CASE WHEN y = 1 THEN 'fake' ELSE 'real' END AS cls,
    (CASE WHEN y = 1 THEN 'fake' ELSE 'real' END) || '/' || grp || '/' || item_id || '.txt' AS place,
    true AS in_split, true AS alone FROM d WHERE y IS NOT NULL""")
def k8(spark, sf):
    from verigauge.sinks.writers import layout_rows
    parts = S.split_groups(X.partly_labelled(spark, sf).where("y IS NOT NULL"),
                           ["y", "grp"], ["item_id"], 0.15, 0.15)
    path = F.concat(F.lit("all/of/them/"), F.col("item_id").cast("string"), F.lit(".txt"))
    rows = layout_rows(parts.withColumn("path", path), F.col("path"))
    head = F.substring_index("target", "/", 1)
    return rows.select(
        F.regexp_extract("source", r"([0-9]+)\.txt$", 1).cast("bigint").alias("item_id"),
        F.col("class").alias("cls"), F.expr("substring(target, length(split) + 2)").alias("place"),
        ((head == F.col("split")) & F.col("split").isin("train", "val", "test")).alias("in_split"),
        (F.col("same_name") == 1).alias("alone"))


def sized(spark, sf):
    """Documents with a made-up width and height so that squares differ by class."""
    return X.partly_labelled(spark, sf).withColumn(
        "w", (F.col("n_chars") % 4).cast("int")).withColumn(
        "h", F.when(F.col("y") == 1, F.col("w")).otherwise((F.col("item_id") % 4).cast("int")))


SIZED_SQL = f"""{X.D_SQL}, z AS (SELECT *, (n_chars % 4)::INTEGER AS w,
    CASE WHEN y = 1 THEN (n_chars % 4)::INTEGER ELSE (item_id % 4)::INTEGER END AS h FROM d)"""


@query("a25_geometry_audit", f"""WITH {SIZED_SQL},
c AS (SELECT grp, w, h, count(*) AS n FROM z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, w, h) AS rk FROM c),
t AS (SELECT grp, string_agg(w || 'x' || h || '(' || n || ')', ', ' ORDER BY rk) AS top_sizes
    FROM r WHERE rk <= 3 GROUP BY grp)
SELECT c.grp, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE w = h), 0)::BIGINT AS square,
    round(coalesce(sum(n) FILTER (WHERE w = h), 0) / sum(n)::DOUBLE, 6) AS square_share,
    max(top_sizes) AS top_sizes FROM c JOIN t ON t.grp = c.grp GROUP BY c.grp""")
def a25(spark, sf):
    return r6(A.geometry_audit(sized(spark, sf), "grp", "w", "h"))


@query("a25_squareness_warning", f"""WITH {SIZED_SQL}, q AS (
    SELECT avg(CASE WHEN w = h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE y = 0) AS sr,
    avg(CASE WHEN w = h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE y = 1) AS sf FROM z)
SELECT round(sr, 6) AS square_real, round(sf, 6) AS square_fake,
    round((sf + 1 - sr) / 2, 6) AS balanced_accuracy, abs(sf - sr) > 0.3 AS warning FROM q""")
def a25_warning(spark, sf):
    audit = A.geometry_audit(sized(spark, sf).where("y IS NOT NULL"), "y", "w", "h")
    return r6(A.squareness_warning(audit, F.col("y") == 1))


@query("a26_format_audit", """WITH x AS (SELECT CASE WHEN url LIKE 'https:%' THEN 'https'
    ELSE 'http' END AS cls, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''),
    '/[^/]*(\\.[^./]+)$', 1)) AS ext, length(html)::BIGINT AS len FROM pages),
k AS (SELECT cls, ext, count(*) AS n FROM x GROUP BY ALL),
d AS (SELECT cls, arg_max(ext, row(n, ext)) AS dominant FROM k GROUP BY cls),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, ext) AS rk FROM k),
t AS (SELECT cls, string_agg(ext || '(' || n || ')', ', ' ORDER BY rk) AS top_formats FROM r
    WHERE rk <= 3 GROUP BY cls)
SELECT x.cls, max(top_formats) AS top_formats, count(*)::BIGINT AS n, round(sum(len) / count(*)::DOUBLE / 1024.0::DOUBLE, 6)
    AS mean_kb, max(d.dominant) AS dominant,
    (SELECT count(DISTINCT dominant) > 1 FROM d) AS differs
FROM x JOIN d ON d.cls = x.cls JOIN t ON t.cls = x.cls GROUP BY x.cls""")
def a26(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    pages = X.table(spark, sf, "pages").select(
        F.when(F.col("url").startswith("https:"), "https").otherwise("http").alias("cls"),
        F.lower(F.regexp_extract(path, r"/[^/]*(\.[^./]+)$", 1)).alias("ext"),
        F.length("html").alias("len"))
    return r6(A.format_audit(pages, "cls", "ext", "len"))


@query("a27_trivial_rules", f"""WITH {SIZED_SQL}, r AS (
    SELECT 'square' AS rule, y, w = h AS hit FROM z WHERE y IS NOT NULL
    UNION ALL SELECT 'long', y, n_chars > 2000 FROM z WHERE y IS NOT NULL
    UNION ALL SELECT 'english', y, lang = 'en' FROM z WHERE y IS NOT NULL),
q AS (SELECT rule, count(*) FILTER (WHERE y = 1)::BIGINT AS n_ai,
    count(*) FILTER (WHERE y = 0)::BIGINT AS n_real,
    count(*) FILTER (WHERE y = 1 AND hit) / count(*) FILTER (WHERE y = 1)::DOUBLE AS tpr,
    count(*) FILTER (WHERE y = 0 AND NOT hit) / count(*) FILTER (WHERE y = 0)::DOUBLE AS tnr
    FROM r GROUP BY rule)
SELECT rule, n_ai, n_real, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr,
    round((tpr + tnr) / 2, 6) AS balanced_accuracy FROM q""")
def a27(spark, sf):
    return r6(A.trivial_rules(sized(spark, sf), {
        "square": F.col("w") == F.col("h"), "long": F.col("n_chars") > 2000,
        "english": F.col("lang") == "en"}))


@query("a28_manifest_sizes", f"""WITH {SIZED_SQL}, m AS (SELECT l.doc_id AS id, l.toxic AS label
    FROM labels l UNION ALL SELECT l.doc_id + 100000000, 1 FROM labels l),
j AS (SELECT m.label, z.item_id, w, h FROM m LEFT JOIN z ON z.item_id = m.id),
c AS (SELECT label, w, h, count(*) AS n FROM j WHERE item_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, w, h) AS rk FROM c),
t AS (SELECT label, string_agg(w || 'x' || h || '(' || n || ')', ', ' ORDER BY rk) AS top_sizes
    FROM r WHERE rk <= 3 GROUP BY label)
SELECT j.label, count(*)::BIGINT AS n, count(*) FILTER (WHERE item_id IS NULL)::BIGINT AS missing,
    count(*) FILTER (WHERE w = h)::BIGINT AS square, max(top_sizes) AS top_sizes
FROM j LEFT JOIN t ON t.label = j.label GROUP BY j.label""")
def a28_sizes(spark, sf):
    listed = X.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    absent = listed.select((F.col("id") + 100_000_000).alias("id"), F.lit(1).alias("label"))
    files = sized(spark, sf).select(F.col("item_id").alias("id"), "w", "h")
    return A.manifest_profile(listed.unionByName(absent), files, "id", width="w", height="h")


@query("a28_manifest_profile", """WITH m AS (SELECT l.doc_id AS id, l.toxic AS label FROM labels l
    UNION ALL SELECT o_orderkey + 1000000, CASE WHEN o_orderkey % 2 = 0 THEN 0 END FROM orders)
SELECT label, count(*)::BIGINT AS n,
    count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM documents))::BIGINT AS missing
FROM m GROUP BY label""")
def a28(spark, sf):
    listed = X.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    absent = X.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1_000_000).alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, 0).alias("label"))
    files = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return A.manifest_profile(listed.unionByName(absent), files, "id")


SPACE_CLASS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
               r"\x{202f}\x{205f}\x{3000}]+")


@query("a29_term_counts", f"""WITH w AS (SELECT unnest(regexp_split_to_array(
    translate(lower(text), ',', ' '), '{SPACE_CLASS}')) AS term FROM documents)
SELECT term, count(*)::BIGINT AS n FROM w WHERE length(term) > 3 GROUP BY term
ORDER BY n DESC, term LIMIT 30""")
def a29(spark, sf):
    return A.term_counts(X.table(spark, sf, "documents"), "text")


FRACTION_SQL = f"""{X.D_SQL}, v AS (SELECT s, n_chars / max(n_chars) OVER ()::DOUBLE AS fraction FROM d)"""


def with_fraction(spark, sf):
    """Lengths as shares of the longest text, so that every row falls into a bin."""
    rows = X.partly_labelled(spark, sf)
    longest = X.table(spark, sf, "documents").agg(F.max("n_chars").alias("longest"))
    return attach_row(rows, longest).withColumn("fraction", F.col("n_chars") / F.col("longest").cast("double")).drop("longest")


def _bin_sql() -> str:
    cases = " ".join(f"WHEN fraction >= {lo} AND fraction < {hi} THEN {i}"
                     for i, (lo, hi) in enumerate(A.FRACTION_BINS))
    return f"CASE {cases} END"


@query("a31_recall_by_fraction", f"""WITH {FRACTION_SQL}, b AS (SELECT {_bin_sql()} AS bin, s FROM v)
SELECT bin, count(*)::BIGINT AS n,
    round(count(*) FILTER (WHERE s >= 0.5) / count(*)::DOUBLE, 6) AS recall,
    round(avg(s), 6) AS mean_score, count(*) < 5 AS thin FROM b WHERE bin IS NOT NULL
GROUP BY bin""")
def a31(spark, sf):
    return r6(A.recall_by_fraction(with_fraction(spark, sf), 0.5))


@query("a32_correlation", f"""WITH {FRACTION_SQL} SELECT count(*)::BIGINT AS n,
    round(corr(fraction, s), 6) AS r FROM v""")
def a32(spark, sf):
    return r6(A.correlation(with_fraction(spark, sf), "fraction", "s"))
