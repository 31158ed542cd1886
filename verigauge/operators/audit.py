"""Audits of a labelled collection: shortcuts, formats, balance, vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.functions.numeric import nan_to_null, ratio
from verigauge.operators.sampling import top_per_group

SQUARENESS_GAP = 0.3
# Edges of the edited-area bins, left closed.
FRACTION_BINS = ((0.00, 0.02), (0.02, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 0.40),
                 (0.40, 1.01))
# The characters Python's str.split() treats as white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def geometry_audit(df: DataFrame, cls: str, width: str, height: str,
                   top: int = 3) -> DataFrame:
    """Per class: rows, square rows, share of squares and the most common sizes.

    Sizes are counted first, so the ranking and the totals run over one row per
    (class, size).
    """
    sizes = df.groupBy(cls, width, height).agg(F.count(F.lit(1)).alias("items"))
    square = F.col(width) == F.col(height)
    totals = sizes.groupBy(cls).agg(
        F.sum("items").alias("n"),
        F.sum(F.when(square, F.col("items")).otherwise(0)).alias("square"))
    label = F.concat(F.col(width).cast("string"), F.lit("x"), F.col(height).cast("string"))
    best = top_per_group(
        sizes, [cls], [F.col("items").desc(), F.col(width), F.col(height)], top, rank="rank")
    named = _ranked_list(best, cls, label, "top_sizes")
    return totals.join(named, F.col(cls).eqNullSafe(F.col("_cls")), "left").select(
        cls, "n", "square", ratio(F.col("square"), F.col("n")).alias("square_share"),
        "top_sizes")


def squareness_warning(audit: DataFrame, is_fake: Column) -> DataFrame:
    """Balanced accuracy of "square means fake" and whether squareness differs sharply."""
    def part(fake: bool) -> tuple[Column, Column]:
        cond = is_fake if fake else ~is_fake
        return F.sum(F.when(cond, F.col("square"))), F.sum(F.when(cond, F.col("n")))
    sq_fake, sq_real = ratio(*part(True)), ratio(*part(False))
    return audit.groupBy().agg(sq_real.alias("square_real"), sq_fake.alias("square_fake")).select(
        "square_real", "square_fake",
        ((F.col("square_fake") + 1.0 - F.col("square_real")) / 2.0).alias("balanced_accuracy"),
        (F.abs(F.col("square_fake") - F.col("square_real")) > SQUARENESS_GAP).alias("warning"))


def trivial_rules(df: DataFrame, rules: dict[str, Column], truth: str = "y") -> DataFrame:
    """Balanced accuracy of "attribute means positive" for every boolean attribute."""
    y = F.col(truth).cast("int")
    tagged = df.select(y.alias("y"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(cond, F.lit(False)).alias("hit"))
        for name, cond in rules.items()]))).where(F.col("y").isNotNull())
    agg = tagged.groupBy("rule").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("n_ai"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_real"),
        F.count(F.when((F.col("y") == 1) & F.col("hit"), 1)).alias("tp"),
        F.count(F.when((F.col("y") == 0) & F.col("hit"), 1)).alias("fp"))
    return agg.select("rule", "n_ai", "n_real", ratio(F.col("tp"), F.col("n_ai")).alias("tpr"),
                      ratio(F.col("n_real") - F.col("fp"), F.col("n_real")).alias("tnr"),
                      ((ratio(F.col("tp"), F.col("n_ai"))
                        + ratio(F.col("n_real") - F.col("fp"), F.col("n_real"))) / 2.0
                       ).alias("balanced_accuracy"))


def _ranked_list(best: DataFrame, cls: str, label: Column, out: str) -> DataFrame:
    """Per class: ``label(items)`` of its few ranked rows, in order of rank."""
    text = F.concat(label, F.lit("("), F.col("items").cast("string"), F.lit(")"))
    return best.groupBy(F.col(cls).alias("_cls")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))),
        lambda r: r["text"]), ", ").alias(out))


def format_audit(df: DataFrame, cls: str, ext: str, length: str, top: int = 3) -> DataFrame:
    """Per class: rows, mean size in KB, dominant and most common formats, and whether the dominant one differs."""
    kinds = df.groupBy(cls, ext).agg(F.count(F.lit(1)).alias("items"),
                                     F.sum(F.col(length).cast("bigint")).alias("bytes"))
    per_class = kinds.groupBy(cls).agg(
        F.sum("items").alias("n"), (F.sum("bytes") / F.sum("items") / 1024.0).alias("mean_kb"),
        F.max(F.struct(F.col("items"), F.col(ext).alias("ext")))["ext"].alias("dominant"))
    whole = Window.partitionBy(F.lit(1))                   # one row per class
    best = top_per_group(kinds.drop("bytes"), [cls], [F.col("items").desc(), F.col(ext)], top, rank="rank")
    named = _ranked_list(best, cls, F.coalesce(F.col(ext), F.lit("")), "top_formats")
    return per_class.join(named, F.col(cls).eqNullSafe(F.col("_cls")), "left").drop("_cls").withColumn(
        "differs", F.min("dominant").over(whole) != F.max("dominant").over(whole))


def manifest_profile(manifest: DataFrame, items: DataFrame, key: str, label: str = "label",
                     width: str | None = None, height: str | None = None) -> DataFrame:
    """Per label: rows and rows whose file is not in the scan.

    With the names of a width and a height of the scan also the squares and most common sizes
    of the files that are there.
    """
    sizes = [] if width is None else [F.min(width).alias("_w"), F.min(height).alias("_h")]
    seen = items.groupBy(F.col(key).alias("_key")).agg(F.lit(1).alias("_seen"), *sizes)
    joined = manifest.join(seen, F.col(key) == F.col("_key"), "left")
    counts = joined.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_key").isNull(), 1)).alias("missing"))
    if width is None:
        return counts
    shapes = geometry_audit(joined.where("_w IS NOT NULL AND _h IS NOT NULL"), label, "_w", "_h").select(
        F.col(label).alias("_label"), "square", "top_sizes")
    return counts.join(shapes, F.col(label).eqNullSafe(F.col("_label")), "left").select(
        label, "n", "missing", F.coalesce("square", F.lit(0).cast("bigint")).alias("square"), "top_sizes")


def term_counts(df: DataFrame, text: str, top: int = 30, min_length: int = 4) -> DataFrame:
    """The most frequent words of at least ``min_length`` letters; ties in alphabetical order."""
    breaks = "," + SPACES
    words = F.split(F.translate(F.lower(F.col(text)), breaks, " " * len(breaks)), " ")
    return (df.select(F.explode(words).alias("term")).where(F.length("term") >= min_length)
            .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "term").limit(top))


def recall_by_fraction(df: DataFrame, threshold: float, fraction: str = "fraction",
                       score: str = "s", thin: int = 5,
                       bins: Sequence[tuple[float, float]] = FRACTION_BINS) -> DataFrame:
    """Recall and mean score of positives per edited-area bin; ``thin`` marks bins of few rows."""
    s, f = nan_to_null(F.col(score)), nan_to_null(F.col(fraction))
    slot = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(bins):
        slot = F.when((F.col("f") >= lo) & (F.col("f") < hi), i).otherwise(slot)
    return (
        df.select(s.alias("s"), f.alias("f")).where(F.col("s").isNotNull())
        .select("s", slot.alias("bin")).where(F.col("bin").isNotNull())
        .groupBy("bin").agg(
            F.count(F.lit(1)).alias("n"),
            ratio(F.count(F.when(F.col("s") >= threshold, 1)), F.count(F.lit(1))).alias("recall"),
            F.avg("s").alias("mean_score"))
        .withColumn("thin", F.col("n") < thin))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of the rows that have both values, and their number; NULL if r is not defined."""
    pairs = df.select(nan_to_null(F.col(x)).alias("x"), nan_to_null(F.col(y)).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    return pairs.groupBy().agg(
        F.count(F.lit(1)).alias("n"),
        nan_to_null(F.corr("x", "y")).alias("r"))
