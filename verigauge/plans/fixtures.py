"""Views of the test tables as detector data, in Spark and as SQL text.

``E`` scored events, ``D`` partly labelled documents, ``L`` heavily tied line
items, ``G`` scored events under a set of perturbation conditions. The SQL
twins are common table expressions the oracle queries start with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigauge.operators.conditions import Condition, expand_conditions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("y"),
        (F.col("value") / 1000.0).alias("s"),
        F.col("event_type").alias("grp"))


E_SQL = """e AS (SELECT event_id AS item_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y,
    value / 1000.0::DOUBLE AS s, event_type AS grp FROM events)"""


def partly_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), (n / (n + 1500.0)).alias("s"),
        F.col("source").alias("grp"), "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), F.col("toxic").alias("y"), "quality")
    return docs.join(labels, "item_id", "left")


D_SQL = """d AS (SELECT doc.doc_id AS item_id,
    doc.n_chars::DOUBLE / (doc.n_chars::DOUBLE + 1500.0::DOUBLE) AS s, doc.source AS grp,
    doc.lang, doc.n_chars, lab.toxic AS y, lab.quality
    FROM documents doc LEFT JOIN labels lab ON doc.doc_id = lab.doc_id)"""


def tied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10.0).alias("s"),
        F.col("l_linestatus").alias("grp"))


L_SQL = """l AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    l_discount * 10.0::DOUBLE AS s, l_linestatus AS grp FROM lineitem)"""

# key, family, severity, label, scale, spread
TABLE_CONDITIONS = [
    ("clean", "clean", 0, "clean", 1.0, 0.0),
    ("jpeg", "jpeg", 1, "q90", 0.98, 0.01),
    ("jpeg", "jpeg", 2, "q50", 0.90, 0.03),
    ("blur", "blur", 1, "s0.5", 0.95, 0.02),
    ("blur", "blur", 2, "s2.0", 0.70, 0.08),
    ("noise", "noise", 1, "s0.05", 1.05, 0.04),
    ("crop", "crop", 1, "keep 80%", 0.99, 0.005),
    ("noise_far", "noise_ood", 1, "s0.15", 0.60, 0.20),
    ("repost", "chain", 1, "repost", 0.50, 0.10),
]


def table_conditions() -> list[Condition]:
    return [Condition(key=k, family=f, severity=v, label=lab,
                      params={"scale": scale, "spread": spread})
            for k, f, v, lab, scale, spread in TABLE_CONDITIONS]


def _jitter(item):
    """A fixed pseudo-random offset in [0, 1) per item."""
    return (item * 7919 % 1000).cast("double") / 1000.0


def condition_grid(items: DataFrame) -> DataFrame:
    """Every item under every condition; score shrunk and spread by the condition."""
    grid = expand_conditions(items, table_conditions())
    return grid.withColumn(
        "s", F.col("s") * F.col("params")["scale"]
        + F.col("params")["spread"] * _jitter(F.col("item_id"))).drop("params")


def scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condition_grid(scored_events(spark, sf_dir))


_COND_VALUES = ",\n    ".join(
    f"('{k}', '{f}', {v}, '{lab}', {scale}::DOUBLE, {spread}::DOUBLE)"
    for k, f, v, lab, scale, spread in TABLE_CONDITIONS)
COND_SQL = f"""cond AS (SELECT * FROM (VALUES
    {_COND_VALUES}) AS t(key, family, severity, label, scale, spread))"""
G_SQL = f"""{E_SQL}, {COND_SQL},
g AS (SELECT e.item_id, e.y, e.grp, c.key, c.family, c.severity, c.label,
    e.s * c.scale + c.spread * (((e.item_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE) AS s
    FROM e CROSS JOIN cond c)"""


def ladder_sql(source: str, keys: str = "", name: str = "lad") -> str:
    """Running confusion counts per distinct score, as common table expressions."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {lead}s"
    return f"""{name}_c AS (SELECT {lead}s AS score,
    sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS pos,
    sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::BIGINT AS neg
    FROM {source} WHERE y IS NOT NULL AND s IS NOT NULL {group}),
{name} AS (SELECT *, sum(pos) OVER (w ORDER BY score DESC)::BIGINT AS tp,
    sum(neg) OVER (w ORDER BY score DESC)::BIGINT AS fp,
    sum(pos) OVER w::BIGINT AS n_pos, sum(neg) OVER w::BIGINT AS n_neg
    FROM {name}_c WINDOW w AS ({part}))"""
