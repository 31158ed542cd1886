"""Connected components of a link table, as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm.store import kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link table; the component is its smallest node.

    Rounds of large stars and small stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows. The number of rounds follows the logarithm of the longest path, every
    round is two aggregations with map-side combine and two joins, and only counts reach the driver.
    Nodes may be of any ordered type. Loops, repeats, direction and nulls of links do not matter.
    """
    spark = links.sparkSession
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = kept(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = kept(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = kept(small)
        after = _mark(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("u"), "v").distinct() if before[0] else stars
    return stars.unionByName(roots).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _mark(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
