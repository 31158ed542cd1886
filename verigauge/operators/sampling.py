"""Caps, samples and splits that never bring a whole class into one task.

A class or group may hold a third of all rows, so ``row_number`` over a class is
out. Two ways are used instead:

* *first n by an order*: two rounds, first inside salted slices of each group and
  then over what is left (at most slices * n rows per group);
* *shuffled order*: rows are ordered by a seeded 64-bit hash. Counting rows per
  (group, top 16 hash bits) tells which hash buckets lie wholly before or after
  a cut; only the one bucket a cut falls into is ranked row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.operators.ranks import stored
from verigauge.operators.scalars import attach_per_key

SAMPLE_SEED = 20260829
SLICES = 16
# one row of cuts per group is broadcast up to so many groups
FEW_GROUPS = 10_000


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str | None = None, slices: int = SLICES) -> DataFrame:
    """The first n rows of every group by a total order, first of each slice, then of all."""
    keys = list(keys)
    num = rank or "_rank"
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(slices))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    df = (df.withColumn("_slice", slot).withColumn("_pre", F.row_number().over(w))
          .where(F.col("_pre") <= n).drop("_slice", "_pre"))
    out = df.withColumn(num, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(num) <= n)
    return out if rank else out.drop(num)


def shuffle_key(seed: int, ids: Sequence[str]) -> Column:
    """Seeded order key; the same items always come in the same order."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])


Cuts = Callable[[DataFrame], DataFrame]


def cut_by_hash(df: DataFrame, keys: Sequence[str], ids: Sequence[str],
                cuts: Sequence[Column] | Cuts, seed: int = SAMPLE_SEED,
                few: bool = False) -> DataFrame:
    """Adds ``part``: in shuffled order, how many of a group's cuts lie at or before the row.

    With cuts [a, b] the first a rows of a group are part 0, those up to b part 1
    and the rest part 2. ``cuts`` are expressions over the group's ``total``, or a
    function from the group totals (keys, total) to (keys, cut) if one group's cut
    depends on other groups. ``few`` says that the groups are a closed list; otherwise they are
    counted off the stored hash counts, so the rows are read twice in all. The cuts of at most ``FEW_GROUPS`` groups are broadcast and the rows stay where they
    are, so a group of many rows never meets in one task.
    """
    keys, ids = list(keys), list(ids)
    hashed = df.withColumn("_h", shuffle_key(seed, ids)).withColumn(
        "_b", F.shiftright(F.col("_h"), 48))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", "_n", (F.sum("_n").over(before) - F.col("_n")).alias("_at"),
        F.sum("_n").over(group).alias("total"))
    if not few:
        # counts per group and bucket, stored, tell the number of groups without another pass over the rows
        hist = stored(hist, "counts")
        few = hist.select(*keys).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    if callable(cuts):
        totals = hist.groupBy(*keys).agg(F.first("total").alias("total"))
        hist = attach_per_key(hist, cuts(totals).select(*keys, "cut"), keys, few=few)
        cuts = [F.col("cut")]
    # per cut: the bucket it falls into with the rows before it, and the first bucket after it
    marks = []
    for i, c in enumerate(cuts):
        c = c.cast("bigint")
        inside = (c > F.col("_at")) & (c < F.col("_at") + F.col("_n"))
        marks += [
            F.max(F.when(inside, F.col("_b"))).alias(f"_in{i}"),
            F.max(F.when(inside, c - F.col("_at"))).alias(f"_rows{i}"),
            F.min(F.when(c <= F.col("_at"), F.col("_b"))).alias(f"_after{i}")]
    marked = attach_per_key(hashed, hist.groupBy(*keys).agg(*marks), keys, few=few)
    b, n = F.col("_b"), range(len(cuts))
    passed, inside = F.lit(0), F.lit(False)
    for i in n:
        passed = passed + F.coalesce((b >= F.col(f"_after{i}")).cast("int"), F.lit(0))
        inside = inside | F.coalesce(b == F.col(f"_in{i}"), F.lit(False))
    marked = marked.withColumn("_passed", passed)
    plain = marked.where(~inside).select(*df.columns, F.col("_passed").alias("part"))
    row = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *ids)) - 1
    part = F.col("_passed")
    for i in n:
        part = part + F.coalesce(
            ((b == F.col(f"_in{i}")) & (F.col("_row") >= F.col(f"_rows{i}"))).cast("int"),
            F.lit(0))
    ranked = marked.where(inside).withColumn("_row", row).select(
        *df.columns, part.alias("part"))
    return plain.unionByName(ranked)


def take_per_group(df: DataFrame, keys: Sequence[str], ids: Sequence[str], cap: int,
                   seed: int = SAMPLE_SEED, few: bool = False) -> DataFrame:
    """A random draw of at most ``cap`` rows per group, the same on every run."""
    return cut_by_hash(df, keys, ids, [F.lit(cap)], seed, few).where("part = 0").drop("part")


def balanced_sample(df: DataFrame, n: int, ids: Sequence[str], label: str = "y",
                    seed: int = SAMPLE_SEED) -> DataFrame:
    """About n labelled rows, equally many per class; with one class, n // 2 of it."""
    def cuts(totals: DataFrame) -> DataFrame:
        both = Window.partitionBy(F.lit(1))       # one row per class
        smaller = F.when(F.count(F.lit(1)).over(both) == 2, F.min("total").over(both))
        half = F.greatest(F.lit(1), F.least(F.lit(n // 2), F.coalesce(smaller, F.lit(n))))
        return totals.withColumn("cut", half)
    labelled = df.where(F.col(label).isin(0, 1))
    return cut_by_hash(labelled, [label], ids, cuts, seed, few=True).where("part = 0").drop("part")


def offset_and_cap(df: DataFrame, keys: Sequence[str], order: str, offset: int, cap: int,
                   readable: Column | None = None) -> DataFrame:
    """Skip ``offset`` rows per group, then keep ``cap`` readable ones, by a unique order column.

    Unreadable rows count towards the offset but not towards the cap.
    """
    keys = list(keys)
    rest = df
    if offset > 0:
        skipped = top_per_group(df.select(*keys, order), keys, [F.col(order)], offset)
        edge = skipped.groupBy(*keys).agg(F.max(order).alias("_edge"))
        rest = attach_per_key(df, edge, keys).where(F.col(order) > F.col("_edge")).drop("_edge")
    if readable is not None:
        rest = rest.where(readable)
    return top_per_group(rest, keys, [F.col(order)], cap)


def cap_groups(df: DataFrame, cap: int, ids: Sequence[str], group: str = "grp",
               label: str = "y", negatives: int | None = None,
               seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``cap`` positives per group, and negatives capped to their total.

    ``negatives`` fixes the negative budget instead of balancing it.
    """
    def cuts(totals: DataFrame) -> DataFrame:
        every = Window.partitionBy(F.lit(1))      # one row per group
        keep = F.when(F.col("_grp").isNotNull(), F.least(F.col("total"), F.lit(cap)))
        budget = F.lit(negatives) if negatives is not None else F.sum(keep).over(every)
        quota = F.when(F.col("_grp").isNotNull(), F.lit(cap)).otherwise(
            F.coalesce(budget, F.lit(0)))
        return totals.withColumn("cut", quota)
    tagged = df.where(F.col(label).isin(0, 1)).withColumn(
        "_grp", F.when(F.col(label) == 1, F.coalesce(F.col(group).cast("string"),
                                                     F.lit("unknown"))))
    return cut_by_hash(tagged, ["_grp"], ids, cuts, seed).where("part = 0").drop("part", "_grp")


def split_groups(df: DataFrame, keys: Sequence[str], ids: Sequence[str], val: float,
                 test: float = 0.0, seed: int = SAMPLE_SEED, few: bool = False) -> DataFrame:
    """Adds ``split``: per group round(n * test) test rows, round(n * val) val, the rest train."""
    n = F.col("total").cast("double")
    a, b = F.rint(n * test), F.rint(n * val)
    parts = cut_by_hash(df, keys, ids, [a, a + b], seed, few)
    name = F.when(F.col("part") == 0, "test").when(F.col("part") == 1, "val").otherwise("train")
    return parts.withColumn("split", name).drop("part")


def manifest_split(df: DataFrame, present: DataFrame, key: str, cap: int, val: float,
                   label: str = "y", seed: int = SAMPLE_SEED) -> DataFrame:
    """Cap per class, split off val, then drop rows whose file is missing, in that order."""
    picked = take_per_group(df.where(F.col(label).isin(0, 1)), [label], [key], cap, seed, True)
    return split_groups(picked, [label], [key], val, 0.0, seed, True).join(
        present.select(key).distinct(), key, "left_semi")


def shuffled_first(df: DataFrame, n: int, ids: Sequence[str],
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """n rows in a seeded random order."""
    return df.orderBy(shuffle_key(seed, ids), *ids).limit(n)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id has not been handled yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that occur on both sides."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(
        right.select(key).distinct(), key, "left_semi")


def require_disjoint(left: DataFrame, right: DataFrame, key: str, show: int = 10) -> None:
    """Raise if any key is on both sides, naming at most ``show`` of them."""
    shared = overlap(left, right, key).orderBy(key)
    names = [r[0] for r in shared.limit(show).collect()]
    if names:
        raise ValueError(f"{shared.count()} keys are on both sides: {names}")


def hardest_views(df: DataFrame, item: str, loss: str, views: int, mode: str = "cvar",
                  view: str = "view_id") -> DataFrame:
    """Loss rows that count per item: all (mean), the worst (max) or the worst half (cvar)."""
    if mode == "mean":
        return df
    keep = 1 if mode == "max" else max(1, views // 2)
    # an item has a few views: one window is enough
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.col(loss).desc(), F.col(view)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def without_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Leave one group out; rows without a group stay."""
    return df.where(~F.col(group).eqNullSafe(F.lit(value)))
