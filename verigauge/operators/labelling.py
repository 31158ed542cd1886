"""Ground-truth labels for a table of items, from folders, a manifest or file names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions import labels as N
from verigauge.operators.scalars import attach_row

AUTO, SUBFOLDER, MANIFEST, FILENAME, NONE = "auto", "subfolder", "manifest", "filename", "none"
ORDER = (SUBFOLDER, MANIFEST, FILENAME)

# Column names a manifest may use, first hit wins.
PATH_KEYS = ("image_path", "path", "file", "filename", "filepath", "image", "img")
LABEL_KEYS = ("label", "is_ai", "y", "target", "class", "gt", "ground_truth")


@dataclass(frozen=True)
class Tokens:
    real: Sequence[str] = N.REAL_TOKENS
    ai: Sequence[str] = N.AI_TOKENS


def pick_key(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[w] for w in wanted if w in by_name), None)


def clean_path(path: Column) -> Column:
    """Drop ``./`` and doubled slashes, resolve single ``..`` steps."""
    p = F.regexp_replace(path, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=/)(\./)+", "")
    return F.regexp_replace(p, r"/[^/.][^/]*/\.\.(?=/)", "")


def manifest_lookup(manifest: DataFrame, base: str, order: str = "row_no",
                    tokens: Tokens = Tokens()) -> DataFrame:
    """One label per spelling of a manifest path.

    The absolute and the written path are exact spellings, where the last row
    wins; the bare file name is an alias, where the first row wins and which an
    exact spelling overrides.
    """
    path_col, label_col = pick_key(manifest.columns, PATH_KEYS), pick_key(manifest.columns,
                                                                         LABEL_KEYS)
    if path_col is None or label_col is None:
        return manifest.sparkSession.createDataFrame([], "spelling string, manifest_label int")
    kind = dict(manifest.dtypes)[label_col]
    raw = F.translate(F.trim(F.col(path_col).cast("string")), "\\", "/")
    label = N.coerce_label(F.col(label_col), kind, tokens.real, tokens.ai)
    absolute = clean_path(F.when(raw.startswith("/"), raw)
                          .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw)))

    def spelling(c: Column, exact: bool) -> Column:
        return F.struct(c.alias("spelling"), F.lit(exact).alias("exact"))

    rows = (
        manifest.select(F.col(order).alias("ord"), raw.alias("raw"), label.alias("label"),
                        absolute.alias("abs"))
        .where(F.col("raw").isNotNull() & F.col("label").isNotNull())
        .select("ord", "label", F.inline(F.array(
            spelling(F.col("abs"), True), spelling(F.col("raw"), True),
            spelling(N.base_name(F.col("raw")), False)))))
    return rows.groupBy("spelling").agg(F.coalesce(
        F.max_by(F.when(F.col("exact"), F.col("label")), F.when(F.col("exact"), F.col("ord"))),
        F.min_by(F.when(~F.col("exact"), F.col("label")), F.when(~F.col("exact"), F.col("ord"))),
    ).alias("manifest_label"))


def join_manifest(items: DataFrame, lookup: DataFrame, path: str = "path",
                  rel_path: str = "rel_path") -> DataFrame:
    """Adds ``manifest_label``: by absolute path, else relative path, else file name."""
    out = items
    found = []
    for i, key in enumerate((F.col(path), F.col(rel_path), N.base_name(F.col(path)))):
        out = out.join(lookup.select(F.col("spelling").alias(f"_s{i}"),
                                     F.col("manifest_label").alias(f"_l{i}")),
                       key == F.col(f"_s{i}"), "left")
        found.append(F.col(f"_l{i}"))
    return out.select(*items.columns, F.coalesce(*found).alias("manifest_label"))


def apply_labels(items: DataFrame, mode: str = AUTO, lookup: DataFrame | None = None,
                 regex: str = N.FILENAME_REGEX, tokens: Tokens = Tokens(),
                 path: str = "path", rel_path: str = "rel_path") -> DataFrame:
    """Adds ``label``, ``label_mode`` and ``labelled`` (rows the source labelled).

    In AUTO mode the first source that labels anything labels the whole set and
    the others are discarded; an explicit mode tries one source; NONE ignores
    labels that are there.
    """
    if mode == NONE:
        return items.select("*", F.lit(None).cast("int").alias("label"),
                            F.lit(NONE).alias("label_mode"),
                            F.lit(0).cast("bigint").alias("labelled"))
    wanted = [m for m in (ORDER if mode == AUTO else (mode,))
              if m != MANIFEST or lookup is not None]
    if not wanted:
        return apply_labels(items, NONE)
    with_all = join_manifest(items, lookup, path, rel_path) if MANIFEST in wanted else items
    sources = {
        SUBFOLDER: lambda: N.directory_label(F.col(rel_path), tokens.real, tokens.ai),
        MANIFEST: lambda: F.col("manifest_label"),
        FILENAME: lambda: N.filename_label(N.base_name(F.col(path)), regex, tokens.real,
                                           tokens.ai),
    }
    for m in wanted:
        with_all = with_all.withColumn(f"_try_{m}", sources[m]())
    counts = with_all.groupBy().agg(*[
        F.count(f"_try_{m}").alias(f"_n_{m}") for m in wanted])
    label, used, size = F.lit(None).cast("int"), F.lit(NONE), F.lit(0).cast("bigint")
    for m in reversed(wanted):
        hit = F.col(f"_n_{m}") > 0
        label = F.when(hit, F.col(f"_try_{m}")).otherwise(label)
        used = F.when(hit, F.lit(m)).otherwise(used)
        size = F.when(hit, F.col(f"_n_{m}")).otherwise(size)
    return attach_row(with_all, counts).select(
        *items.columns, label.alias("label"), used.alias("label_mode"), size.alias("labelled"))


def class_balance(items: DataFrame, label: str = "label", score: str | None = None) -> DataFrame:
    """n, n_real, n_ai, n_unlabeled, has_labels and, with scores, n_scored and failures."""
    y = F.col(label)
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(y == 0, 1)).alias("n_real"),
            F.count(F.when(y == 1, 1)).alias("n_ai"),
            F.count(F.when(y.isNull(), 1)).alias("n_unlabeled")]
    if score:
        s = N.nan_to_null(F.col(score))
        aggs += [F.count(s).alias("n_scored"), F.count(F.when(s.isNull(), 1)).alias("failures")]
    return items.groupBy().agg(*aggs).withColumn(
        "has_labels", (F.col("n_real") + F.col("n_ai")) > 0)


def require(items: DataFrame, label: str = "label", labels: bool = False,
            both_classes: bool = False) -> dict:
    """One counting action; raises on an empty set or on missing labels or classes."""
    row = class_balance(items, label).first().asDict()
    if row["n"] == 0:
        raise ValueError("no items found")
    if (labels or both_classes) and not row["has_labels"]:
        raise ValueError("no ground-truth labels found")
    if both_classes and (row["n_real"] == 0 or row["n_ai"] == 0):
        raise ValueError("at least one real and one AI item are needed")
    return row


def class_of_folder(rel_path: Column, laid_out: bool) -> Column:
    """fake/real from the top folder: raw ai/real sets or laid-out real/fake sets."""
    top = F.split(rel_path, "/")[0]
    ai = "fake" if laid_out else "ai"
    return F.when(top == "real", "real").when(top == ai, "fake")


def is_laid_out(items: DataFrame, rel_path: str = "rel_path") -> bool:
    """True if both real/ and fake/ exist at the top."""
    top = F.split(F.col(rel_path), "/")[0]
    row = items.agg(F.max(top == "real").alias("r"), F.max(top == "fake").alias("f")).first()
    return bool(row.r and row.f)
