"""File-tree sources: image listings, manifests, shards, predictions, reports, pictures.

Listing reads path and length only; contents are not touched before an operator
needs pixels. Spark itself passes over names that start with ``_`` or ``.``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verigauge.functions import kernels as K
from verigauge.functions import labels as N
from verigauge.functions.numeric import nan_to_null
from verigauge.operators import labelling as LB
from verigauge.operators.scalars import attach_row
from verigauge.sources.json_lists import read_objects
from verigauge.sources.tables import require_columns

# What counts as an image, and the manifest names in order of preference.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
MANIFEST_NAMES = ("labels.csv", "labels.json", "manifest.csv", "manifest.json",
                  "ground_truth.csv")
WRAPPER_KEYS = ("records", "images", "data", "items")


def plain_path(path: Column) -> Column:
    """Drop the scheme of local files; other file systems keep theirs."""
    return F.regexp_replace(path, "^file:/+", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel_path, size_bytes, is_image`` of every file below the root."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(plain_path(F.col("path")).alias("path"),
                     F.col("length").alias("size_bytes")))
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    return files.select(
        "path", F.substring(F.col("path"), F.length(base) + 1, F.length("path"))
        .alias("rel_path"), "size_bytes",
        extension(F.col("path")).isin(*IMAGE_EXTENSIONS).alias("is_image"))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root).where("is_image").drop("is_image")


def skipped_files(spark: SparkSession, root: str) -> DataFrame:
    """One row with the number of images and of files passed over."""
    return list_files(spark, root).groupBy().agg(
        F.count(F.when(F.col("is_image"), 1)).alias("images"),
        F.count(F.when(~F.col("is_image"), 1)).alias("skipped"))


def scan_items(spark: SparkSession, root: str, mode: str = LB.AUTO,
               manifest: str | None = None, regex: str = N.FILENAME_REGEX,
               tokens: LB.Tokens = LB.Tokens()) -> DataFrame:
    """Images with labels from folders, a manifest or file names."""
    items = list_images(spark, root)
    lookup = None
    if mode in (LB.AUTO, LB.MANIFEST):
        found = [manifest] if manifest else manifests(spark, root)
        for path in found:
            rows = read_manifest(spark, path)
            if manifest or usable_manifest(rows):
                lookup = LB.manifest_lookup(rows, path.rsplit("/", 1)[0], tokens=tokens)
                break
    return LB.apply_labels(items, mode, lookup, regex, tokens)


def scan_classes(spark: SparkSession, root: str) -> DataFrame:
    """Strict real/ and fake/ layout: ``path, label, grp``. A missing class is an error.

    The group is the first folder below the class, or ``<class>_root``.
    """
    parts = F.split("rel_path", "/")
    cls = parts[0]
    items = list_images(spark, root).where(cls.isin("real", "fake") & (F.size(parts) > 1))
    seen = {r.cls for r in items.select(cls.alias("cls")).distinct().collect()}
    missing = {"real", "fake"} - seen
    if missing:
        raise FileNotFoundError(f"no images below {sorted(missing)} in {root}")
    return items.select(
        "path", "rel_path", "size_bytes", (cls == "fake").cast("int").alias("label"),
        F.when(F.size(parts) > 2, parts[1]).otherwise(F.concat(cls, F.lit("_root")))
        .alias("grp"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything; looks at that path only."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def manifests(spark: SparkSession, root: str) -> Iterator[str]:
    """Recognised manifests in the root folder itself, in order of preference."""
    paths = (f"{root.rstrip('/')}/{n}" for n in MANIFEST_NAMES)
    return (p for p in paths if _exists(spark, p))


def find_manifest(spark: SparkSession, root: str) -> str | None:
    """First recognised manifest in the root folder itself."""
    return next(manifests(spark, root), None)


def usable_manifest(rows: DataFrame) -> bool:
    """Whether rows tell a path and a label; of a broken file they do not."""
    return bool(LB.pick_key(rows.columns, LB.PATH_KEYS) and LB.pick_key(rows.columns, LB.LABEL_KEYS)
                and rows.take(1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of a CSV file, a JSON list, a wrapped list or a flat path-to-label map.

    ``row_no`` keeps the order of the rows for the precedence rules.
    """
    numbered = F.monotonically_increasing_id().alias("row_no")
    if not path.lower().endswith(".json"):
        df = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
        clean = [F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns]
        return df.select(*clean, numbered)
    found = read_objects(spark, path, WRAPPER_KEYS)
    if found is not None:
        return found
    # the shape is read off the text: inference would make a flat object one column per path
    text = spark.read.option("wholetext", True).text(path)
    top = F.from_json("value", "map<string,string>")
    wrapped = F.exists(F.array(*[F.lit(k) for k in WRAPPER_KEYS]),
                       lambda k: F.coalesce(F.try_element_at("top", k).rlike(r"^\s*\["), F.lit(False)))

    def named(keys: Sequence[str]) -> Column:
        return F.exists(F.map_keys("top"), lambda k: F.lower(F.trim(k)).isin(*keys))
    shape = text.select(F.col("value").rlike(r"^\s*\{").alias("object"), top.alias("top")).select(
        (F.col("object") & F.col("top").isNotNull() & ~wrapped
         & ~(named(LB.PATH_KEYS) & named(LB.LABEL_KEYS))).alias("flat")).first()
    if shape and shape.flat:
        return text.select(F.explode(top).alias("image_path", "label")).select("*", numbered)
    df = spark.read.option("multiLine", True).json(path)
    for key in WRAPPER_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) \
                and isinstance(df.schema[key].dataType.elementType, T.StructType):
            return df.select(F.inline(F.col(key))).select("*", numbered)
    return df.select("*", numbered)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with ``file_name`` and ``label``; quotes inside a field are doubled."""
    return require_columns(spark.read.option("header", True).option("escape", '"').csv(path), ["file_name", "label"])


def read_tsv_shards(spark: SparkSession, folder: str, pattern: str = "photos.tsv*") -> DataFrame:
    """All shards of tab-separated metadata; none found is an error."""
    if not _exists(spark, f"{folder.rstrip('/')}/{pattern}"):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return (spark.read.option("header", True).option("sep", "\t").option("multiLine", False)
            .csv(f"{folder.rstrip('/')}/{pattern}"))


def common_root(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row with the deepest folder that holds every path.

    The lexicographically first and last path share exactly what all share.
    """
    ends = paths.groupBy().agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    both = F.least(F.size(a), F.size(b)) - 1               # file names do not count
    pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), both)
    differ = F.array_position(
        F.transform(pairs, lambda p: ~p["x"].eqNullSafe(p["y"])), True)
    depth = F.when(differ > 0, differ.cast("int") - 1).otherwise(both)
    return ends.select(F.array_join(F.slice(a, F.lit(1), depth), "/").alias("root"))


def read_predictions(spark: SparkSession, path: str, lines: bool | None = None,
                     mode: str = LB.AUTO) -> DataFrame:
    """Items rebuilt from a predictions file, with labels read off the paths again.

    A single ``.json`` file holds one list; a written folder holds JSON lines.
    A ``pred`` that is not a number counts as not scored.
    """
    multi = path.lower().endswith(".json") if lines is None else not lines
    df = read_objects(spark, path, primitivesAsString=True) if multi else None
    if df is None:
        df = spark.read.option("multiLine", multi).option("primitivesAsString", True).json(path)
    if "image_path" not in df.columns or "pred" not in df.columns:
        raise ValueError('every record needs "image_path" and "pred"')
    if not df.take(1):
        raise ValueError(f"{path} holds no records")
    rows = df.where(F.col("image_path").isNotNull()).select(
        F.col("image_path").alias("path"),
        nan_to_null(F.col("pred").try_cast("double")).alias("score"))
    rooted = attach_row(rows, common_root(rows))
    items = rooted.select("path", F.expr("substring(path, length(root) + 2)").alias("rel_path"),
                          "score")
    return LB.apply_labels(items, mode)


def read_sweep_report(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Chart rows ``transform, severity, severity_label, accuracy, auc, baseline`` of a report.

    A missing or unreadable report gives no rows.
    """
    cell = ("struct<transform:string,severity:int,severity_label:string,"
            "metrics:struct<accuracy:double,auc:double>>")
    schema = f"baseline struct<accuracy:double>, cells array<{cell}>"
    multi = path.lower().endswith(".json") if lines is None else not lines
    try:
        df = spark.read.schema(schema).option("multiLine", multi).json(path)
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    return df.select(F.col("baseline.accuracy").alias("baseline"), F.inline("cells")).select(
        "transform", "severity", "severity_label", nan_to_null(F.col("metrics.accuracy"))
        .alias("accuracy"), nan_to_null(F.col("metrics.auc")).alias("auc"), "baseline")


def read_pictures(spark: SparkSession, root: str | list[str],
                  max_side: int | None = None, most_pixels: int | None = None) -> DataFrame:
    """Decoded RGB pictures ``path, height, width, pixels, error`` below a folder or of a list of files.

    With ``most_pixels`` a larger picture keeps its row with an error instead of its pixels. A file that cannot be decoded keeps its row with an error text.
    """
    raw = (spark.read.format("image").option("dropInvalid", False)
           .option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.{" + ",".join(
               [*IMAGE_EXTENSIONS, *[e.upper() for e in IMAGE_EXTENSIONS]]) + "}").load(root)
           .select(plain_path(F.col("image.origin")).alias("path"), "image.height",
                   "image.width", "image.nChannels", "image.data"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.nChannels < 1:
                        raise ValueError("cannot be decoded")
                    if most_pixels is not None and r.height * r.width > most_pixels:
                        raise ValueError(f"{r.height * r.width} pixels exceed {most_pixels}")
                    img = np.frombuffer(r.data, dtype=np.uint8).reshape(
                        r.height, r.width, r.nChannels)
                    # Spark hands over blue, green, red and maybe alpha
                    img = img[..., 2::-1] if r.nChannels >= 3 else img.repeat(3, axis=2)
                    img = K.cap_side(img, max_side) if max_side else img
                    rows.append((r.path, img.shape[0], img.shape[1],
                                 np.ascontiguousarray(img).tobytes(), None))
                except Exception as exc:
                    rows.append((r.path, None, None, None, f"{type(exc).__name__}: {exc}"))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "pixels", "error"])
            yield out.astype({"height": "Int32", "width": "Int32"})

    return raw.mapInPandas(
        decode, "path string, height int, width int, pixels binary, error string")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """``name, fraction`` rows of a JSON object from file name to edited share."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,double>"))
                       .alias("name", "fraction"))
