"""Image tables: degradation grids, random views, crops and scoring in one pass.

An image is decoded once and goes through all of its conditions in the same
task; only scores leave the task unless pixels are asked for. Image rows carry
``height, width, pixels`` (RGB bytes, row by row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions import kernels as K
from verigauge.operators.conditions import Condition, named_cells
from verigauge.operators.scoring import Scorer, resident, version_of

SOURCE_QUALITY = 92
# Ranges of the training degradations, in the order they are applied.
TRAIN_RANGES = {
    "crop": (0.75, 1.0), "resize": (0.25, 1.0), "color": (0.80, 1.20), "noise": (0.0, 0.10),
    "blur": (0.0, 2.0), "jpeg": (30.0, 95.0),
}
P_CLEAN = 0.15
MAX_OPS = 3


def unit_draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return h.cast("double") * F.lit(2.0 ** -53)


def whole_draw(seed: int, lo: Column, hi: Column, *parts: Column) -> Column:
    """A whole number in [lo, hi], both ends included."""
    span = (hi - lo + 1).cast("double")
    return lo + F.floor(unit_draw(seed, *parts) * span).cast("int")


def pixels_of(row) -> np.ndarray:
    """RGB array of an image row; raises on a broken one."""
    h, w = int(row.height), int(row.width)
    if h <= 0 or w <= 0 or row.pixels is None:
        raise ValueError("not a readable image")
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(h, w, 3)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                     for f in df.schema.fields if f.name in names)


class ImageScorer(Scorer):
    """Scores RGB arrays; ``prepare_source`` runs before any degradation."""

    name = "image"
    tta_views = 1

    def prepare_source(self, img: np.ndarray) -> np.ndarray:
        return img

    def predict_images(self, images: Sequence[np.ndarray]) -> Sequence[float]:
        raise NotImplementedError

    def predict_with_views(self, images: Sequence[np.ndarray]) -> list[float]:
        """Mean score over the first ``tta_views`` of: plain, flipped, zoomed, both."""
        views = [
            lambda im: im, K.flip, lambda im: K.centre_crop(im, 0.9),
            lambda im: K.flip(K.centre_crop(im, 0.9))]
        n = int(self.tta_views)
        if not 1 <= n <= len(views):
            raise ValueError(f"there are {len(views)} views, not {n}")
        views = views[:n]
        flat = list(self.predict_images([v(im) for im in images for v in views]))
        if len(flat) != n * len(images):
            raise ValueError(f"{len(flat)} scores for {n * len(images)} views")
        return [round(float(np.mean(flat[i * n:(i + 1) * n])), 6) for i in range(len(images))]

    def predict_batch(self, rows: pd.DataFrame) -> list[float]:
        out, images, at = [float("nan")] * len(rows), [], []
        for i, row in enumerate(rows.itertuples(index=False)):
            try:
                images.append(self.prepare_source(pixels_of(row)))
                at.append(i)
            except Exception:                     # a broken file is one failed item
                continue
        for i, s in zip(at, self.predict_with_views(images) if images else []):
            out[i] = s
        return out


def _why(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def _score_cells(row, conditions: Sequence[Condition], scorer: ImageScorer,
                 max_side: int | None) -> tuple[dict, dict]:
    """Scores and errors by cell for one image, decoded and prepared once."""
    try:
        img = pixels_of(row)
        base = scorer.prepare_source(K.cap_side(img, max_side) if max_side else img)
    except Exception as exc:
        return {}, {i: _why(exc) for i in range(len(conditions))}
    scores, errors, done, images = {}, {}, [], []

    def flush() -> None:
        if not images:
            return
        try:
            got = list(scorer.predict_with_views(images))
            if len(got) != len(done):
                raise ValueError(f"{len(got)} scores for {len(done)} images")
            scores.update((i, s) for i, s in zip(done, got) if s == s)
            errors.update((i, "could not be scored") for i, s in zip(done, got) if s != s)
        except Exception as exc:
            errors.update((i, _why(exc)) for i in done)
        done.clear()
        images.clear()

    for i, c in enumerate(conditions):
        try:
            rng = np.random.default_rng([int(row.noise_seed) & (2 ** 63 - 1), i])
            images.append(K.apply_chain(base, c.chain, rng))
            done.append(i)
        except Exception as exc:
            errors[i] = _why(exc)
        if len(images) >= scorer.batch_size:
            flush()
    flush()
    return scores, errors


def _grid_work(conditions: Sequence[Condition], given: ImageScorer, keep: list[str],
               max_side: int | None) -> Callable:
    n, version = len(conditions), version_of(given)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = resident(given, version)
        for pdf in batches:
            scores, errors = [], []
            for row in pdf.itertuples(index=False):
                s, e = _score_cells(row, conditions, scorer, max_side)
                scores += [s.get(i) for i in range(n)]
                errors += [e.get(i) for i in range(n)]
            out = pdf[keep].loc[pdf.index.repeat(n)].reset_index(drop=True)
            out["cell"] = np.tile(np.arange(n, dtype=np.int32), len(pdf))
            out["s"] = pd.array(scores, dtype="Float64")
            out["error"] = pd.Series(errors, dtype=object)
            yield out
    return work


def score_grid(images: DataFrame, conditions: Sequence[Condition], scorer: ImageScorer,
               item: str = "item_id", keep: Sequence[str] = (), max_side: int | None = None,
               seed: int = 0, spread: int | None = None) -> DataFrame:
    """``keep`` columns, ``cell``, score ``s`` and ``error``: every image under every condition.

    Noise is seeded by the item and the condition, never by the order of rows.
    Images keep their size unless ``max_side`` is set. ``spread`` deals the images out to that many tasks first; files that already
    come in many splits do not need it.
    """
    keep = [item, *[k for k in keep if k != item]]
    ready = images.repartition(spread, F.col(item)) if spread else images
    ready = ready.withColumn("noise_seed", F.xxhash64(F.lit(seed), F.col(item)))
    schema = f"{_fields(images, keep)}, cell int, s double, error string"
    return ready.mapInPandas(_grid_work(conditions, scorer, keep, max_side), schema)


def image_sweep(images: DataFrame, conditions: Sequence[Condition], scorer: ImageScorer,
                threshold: float | None = None, item: str = "item_id",
                label: str = "y", **options) -> DataFrame:
    """One job for the whole grid: metrics per cell with deltas against clean."""
    from verigauge.operators.conditions import sweep_cells

    thr = scorer.default_threshold if threshold is None else threshold
    scored = score_grid(images, conditions, scorer, item, [label], **options)
    return sweep_cells(scored, thr, conditions, truth=label)


def transform_pixels(images: DataFrame, conditions: Sequence[Condition],
                     keep: Sequence[str] = ("item_id",), seed: int = 0) -> DataFrame:
    """Degraded pixels themselves, one row per image and condition."""
    keep = list(keep)
    cells = list(enumerate(conditions))

    def work(batches):
        for pdf in batches:
            kept = pdf[keep]
            for at, row in enumerate(pdf.itertuples(index=False)):
                out = []
                for i, c in cells:
                    try:
                        rng = np.random.default_rng([int(row.noise_seed) & (2 ** 63 - 1), i])
                        img = K.apply_chain(pixels_of(row), c.chain, rng)
                        out.append((i, img.shape[0], img.shape[1],
                                    np.ascontiguousarray(img).tobytes(), None))
                    except Exception as exc:
                        out.append((i, None, None, None, _why(exc)))
                pixels = pd.DataFrame(out, columns=["cell", "height", "width", "pixels", "error"])
                pixels = pixels.astype({"cell": "int32", "height": "Int32", "width": "Int32"})
                names = kept.iloc[[at] * len(out)].reset_index(drop=True)
                yield pd.concat([names, pixels], axis=1)

    schema = (f"{_fields(images, keep)}, cell int, height int, width int, pixels binary, "
              "error string")
    ready = images.withColumn("noise_seed", F.xxhash64(F.lit(seed), *[F.col(k) for k in keep]))
    return named_cells(ready.mapInPandas(work, schema), conditions)


def random_views(items: DataFrame, views: int, item: str = "item_id", seed: int = 0,
                 max_ops: int = MAX_OPS, p_clean: float = P_CLEAN) -> DataFrame:
    """Each item once per view with drawn parameters; view 0 is clean.

    ``steps`` maps an operation to its number (colour has three), empty if clean.
    The draws are hashes of (seed, item, view), so they can be read off again.
    """
    wide = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view_id"))
    who = [F.col(item), F.col("view_id")]
    count = whole_draw(seed, F.lit(1), F.lit(max_ops), F.lit("count"), *who)
    order = F.array_sort(F.array(*[
        F.struct(unit_draw(seed, F.lit("pick"), F.lit(op), *who).alias("u"), F.lit(op).alias("op"))
        for op in TRAIN_RANGES]))
    chosen = F.transform(F.slice(order, F.lit(1), count), lambda s: s["op"])
    clean = (F.col("view_id") == 0) | (unit_draw(seed, F.lit("clean"), *who) < p_clean)

    def draw(name: str, lo: float, hi: float) -> Column:
        u = unit_draw(seed, F.lit("value"), F.lit(name), *who)
        return F.floor(lo + u * (hi - lo + 1.0)).cast("double") if name == "jpeg" \
            else lo + u * (hi - lo)

    entries = []
    for op, (lo, hi) in TRAIN_RANGES.items():
        names = ["color_b", "color_c", "color_s"] if op == "color" else [op]
        for n in names:
            entries.append(F.struct(
                F.lit(n).alias("name"),
                F.when(F.array_contains(F.col("_chosen"), op), draw(n, lo, hi)).alias("value")))
    steps = F.map_from_entries(F.filter(
        F.array(*entries), lambda e: e["value"].isNotNull() & ~F.col("_clean")))
    return wide.withColumn("_chosen", chosen).withColumn("_clean", clean).withColumn(
        "steps", steps).drop("_chosen", "_clean")


def chain_of(steps: dict) -> list[tuple[str, dict]]:
    """The drawn parameters as kernels in their fixed order."""
    out = []
    for op in TRAIN_RANGES:
        if op == "color" and "color_b" in steps:
            out.append(("colour", {"b": steps["color_b"], "c": steps["color_c"],
                                   "s": steps["color_s"]}))
        elif op in steps and op != "color":
            kernel, name = {"crop": ("crop_rounded", "keep"), "resize": ("resize_cycle", "factor"),
                            "noise": ("noise01", "sigma"), "blur": ("blur", "sigma"),
                            "jpeg": ("jpeg", "quality")}[op]
            out.append((kernel, {name: steps[op]}))
    return out


def source_quality(item: str = "item_id", seed: int = 0, lo: int = 85, hi: int = 98) -> Column:
    """Training draws the source quality per item; scoring uses ``SOURCE_QUALITY``."""
    return whole_draw(seed, F.lit(lo), F.lit(hi), F.lit("source"), F.col(item))


def geometry_columns(df: DataFrame, item: str = "item_id", width: str = "width",
                     height: str = "height", lo: int = 384, hi: int = 1024,
                     seed: int = 0) -> DataFrame:
    """A random square crop and a target side from one range for all classes."""
    w, h = F.col(width), F.col(height)
    side = F.least(w, h)
    who = F.col(item)
    return df.select(
        "*", whole_draw(seed, F.lit(0), w - side, F.lit("left"), who).alias("crop_left"),
        whole_draw(seed, F.lit(0), h - side, F.lit("top"), who).alias("crop_top"),
        side.alias("crop_side"),
        whole_draw(seed, F.lit(lo), F.lit(hi), F.lit("side"), who).alias("target_side"))


def edited_fraction(df: DataFrame, mask: str = "mask", item: str = "item_id") -> DataFrame:
    """Share of edited pixels per item, after the item's own crop.

    ``mask`` holds grey bytes of ``height`` x ``width``; the crop columns come from
    ``geometry_columns``.
    """
    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                grid = np.frombuffer(getattr(r, mask), dtype=np.uint8).reshape(
                    int(r.height), int(r.width))
                cut = K.square_crop(grid, int(r.crop_left), int(r.crop_top), int(r.crop_side),
                                    int(r.target_side), "nearest")
                out.append((getattr(r, item), K.mask_fraction(cut)))
            yield pd.DataFrame(out, columns=[item, "fraction"])
    return df.mapInPandas(work, f"{_fields(df, [item])}, fraction double")


def cropped(df: DataFrame, item: str = "item_id", method: str = "bicubic") -> DataFrame:
    """Pixels after the item's own crop and resize."""
    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                img = K.square_crop(pixels_of(r), int(r.crop_left), int(r.crop_top),
                                    int(r.crop_side), int(r.target_side), method)
                rows.append((getattr(r, item), img.shape[0], img.shape[1],
                             np.ascontiguousarray(img).tobytes()))
            yield pd.DataFrame(rows, columns=[item, "height", "width", "pixels"])
    return df.mapInPandas(work, f"{_fields(df, [item])}, height int, width int, pixels binary")


def view_features(views: DataFrame, encode: Callable[[np.ndarray], Sequence[float]],
                  keep: Sequence[str] = ("item_id", "view_id"), mode: str = "resize",
                  side: int = K.TOWER_SIDE, renormalise: bool = True, seed: int = 0) -> DataFrame:
    """Feature rows of image views: source loss, drawn chain, model input, encoder.

    ``views`` are image rows with ``steps``. An unreadable image gives NULL features.
    """
    keep = list(keep)
    ready = views.withColumn("source_q", source_quality(keep[0], seed)).withColumn(
        "noise_seed", F.xxhash64(F.lit(seed), *[F.col(k) for k in keep]))

    def work(batches):
        for pdf in batches:
            vectors = []
            for r in pdf.itertuples(index=False):
                try:
                    rng = np.random.default_rng(int(r.noise_seed) & (2 ** 63 - 1))
                    img = pixels_of(r)
                    img = K.jpeg(img, r.source_q) if renormalise else img
                    img = K.apply_chain(img, chain_of(dict(r.steps)), rng)
                    vectors.append([float(x) for x in encode(
                        K.tower_input(img, mode, rng, side))])
                except Exception:
                    vectors.append(None)
            yield pdf[keep].assign(feature=pd.Series(vectors, index=pdf.index, dtype=object))
    return ready.mapInPandas(work, f"{_fields(views, keep)}, feature array<double>")


