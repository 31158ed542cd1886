"""Image kernels on uint8 RGB arrays, used inside Spark tasks.

Small per-image helpers; Spark decides which images and conditions a task gets.
They follow the public definitions of the operations and are not bit-equal to
any particular imaging library.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The quantisation tables printed in annex K of the JPEG standard.
LUMA_TABLE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]], dtype=float)
CHROMA_TABLE = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99]], dtype=float)
# Channel means and deviations the feature towers were trained with.
TOWER_MEAN = np.array([0.48145466, 0.45782750, 0.40821073])
TOWER_STD = np.array([0.26862954, 0.26130258, 0.27577711])
TOWER_SIDE = 224

_GREY = np.array([0.299, 0.587, 0.114])
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16)
                  for n in range(8)] for k in range(8)])


class NoCodec(RuntimeError):
    """A kernel needs an encoder that is not available."""


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# -- geometry ---------------------------------------------------------------

def _sinc(x):
    return np.sinc(x)


FILTERS = {                                       # name: (support, weight function)
    "bilinear": (1.0, lambda x: np.maximum(0.0, 1.0 - np.abs(x))),
    "bicubic": (2.0, lambda x: np.where(
        np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x ** 2 + 1,
        np.where(np.abs(x) < 2,
                 -0.5 * np.abs(x) ** 3 + 2.5 * x ** 2 - 4 * np.abs(x) + 2, 0.0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, _sinc(x) * _sinc(x / 3), 0.0)),
}


@lru_cache(maxsize=256)
def _resample_matrix(old: int, new: int, method: str) -> np.ndarray:
    """Rows of weights; when shrinking the filter widens, so nothing is skipped."""
    support, weight = FILTERS[method]
    scale = max(old / new, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * old / new
    w = weight((np.arange(old)[None, :] + 0.5 - centre) / scale)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int, method: str = "bicubic") -> np.ndarray:
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    if method == "nearest":
        rows = np.minimum((np.arange(height) + 0.5) * h // height, h - 1).astype(int)
        cols = np.minimum((np.arange(width) + 0.5) * w // width, w - 1).astype(int)
        return img[rows][:, cols]
    out = np.tensordot(_resample_matrix(h, height, method), img.astype(float), axes=(1, 0))
    out = np.moveaxis(np.tensordot(_resample_matrix(w, width, method), out, axes=(1, 1)), 0, 1)
    return to_bytes(out)


def cap_side(img: np.ndarray, max_side: int) -> np.ndarray:
    h, w = img.shape[:2]
    if max(h, w) <= max_side:
        return img
    s = max_side / max(h, w)
    return resize(img, max(1, int(w * s)), max(1, int(h * s)), "bilinear")


def rescale(img: np.ndarray, factor: float, down: str = "lanczos",
            up: str = "bicubic", rounded: bool = False) -> np.ndarray:
    """Down by a factor and back up again."""
    h, w = img.shape[:2]
    fit = round if rounded else int
    small = resize(img, max(1, int(fit(w * factor))), max(1, int(fit(h * factor))), down)
    return resize(small, w, h, up)


def shrink(img: np.ndarray, factor: float, method: str = "lanczos") -> np.ndarray:
    h, w = img.shape[:2]
    return resize(img, max(1, int(w * factor)), max(1, int(h * factor)), method)


def centre_crop(img: np.ndarray, keep: float, rounded: bool = False) -> np.ndarray:
    h, w = img.shape[:2]
    fit = round if rounded else int
    nw, nh = max(1, int(fit(w * keep))), max(1, int(fit(h * keep)))
    left, top = (w - nw) // 2, (h - nh) // 2
    return img[top:top + nh, left:left + nw]


def square_crop(img: np.ndarray, left: int, top: int, side: int, target: int,
                method: str = "bicubic") -> np.ndarray:
    return resize(img[top:top + side, left:left + side], target, target, method)


def flip(img: np.ndarray) -> np.ndarray:
    return img[:, ::-1]


# -- photometry -------------------------------------------------------------

def grey(img: np.ndarray) -> np.ndarray:
    return np.rint(img.astype(float) @ _GREY)


def _blend(base, img: np.ndarray, factor: float) -> np.ndarray:
    return to_bytes(base + (img.astype(float) - base) * factor)


def brightness(img: np.ndarray, factor: float) -> np.ndarray:
    return _blend(0.0, img, factor)


def contrast(img: np.ndarray, factor: float) -> np.ndarray:
    return _blend(np.floor(grey(img).mean() + 0.5), img, factor)


def saturation(img: np.ndarray, factor: float) -> np.ndarray:
    return _blend(grey(img)[..., None], img, factor)


def sharpness(img: np.ndarray, factor: float) -> np.ndarray:
    pad = np.pad(img.astype(float), ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = img.shape[:2]
    total = sum(pad[i:i + h, j:j + w] for i in range(3) for j in range(3))
    smooth = (total + 4.0 * img) / 13.0
    smooth[[0, -1]], smooth[:, [0, -1]] = img[[0, -1]], img[:, [0, -1]]
    return _blend(smooth, img, factor)


def colour(img: np.ndarray, b: float, c: float, s: float) -> np.ndarray:
    return saturation(contrast(brightness(img, b), c), s)


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return img
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma ** 2))
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, mode="edge")
        n = img.shape[axis]
        out = sum(wt * np.take(wide, range(i, i + n), axis=axis) for i, wt in enumerate(k))
    return to_bytes(out)


def noise(img: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """Additive noise with sigma in 0-255 units."""
    if sigma <= 0:
        return img
    return np.clip(img + rng.normal(0.0, sigma, img.shape), 0, 255).astype(np.uint8)


# -- codec loss -------------------------------------------------------------

def _quality(table: np.ndarray, quality: float) -> np.ndarray:
    q = min(100, max(1, int(quality)))
    s = 5000 / q if q < 50 else 200 - 2 * q
    return np.clip(np.floor((table * s + 50) / 100), 1, 255)


def _quantise(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    ph, pw = -h % 8, -w % 8
    wide = np.pad(plane, ((0, ph), (0, pw)), mode="edge") - 128.0
    blocks = wide.reshape((h + ph) // 8, 8, (w + pw) // 8, 8).transpose(0, 2, 1, 3)
    coef = np.rint(_DCT @ blocks @ _DCT.T / table) * table
    back = (_DCT.T @ coef @ _DCT).transpose(0, 2, 1, 3).reshape(h + ph, w + pw)
    return np.clip(np.rint(back + 128.0), 0, 255)[:h, :w]


def jpeg(img: np.ndarray, quality: float) -> np.ndarray:
    """The lossy part of JPEG with 4:2:0 chroma: no bit stream is written."""
    rgb = img.astype(float)
    h, w = img.shape[:2]
    y = rgb @ _GREY
    planes = [_quantise(y, _quality(LUMA_TABLE, quality))]
    for i, scale in ((2, 1.772), (0, 1.402)):
        chroma = (rgb[..., i] - y) / scale + 128.0
        wide = np.pad(chroma, ((0, h % 2), (0, w % 2)), mode="edge")
        half = wide.reshape(wide.shape[0] // 2, 2, wide.shape[1] // 2, 2).mean(axis=(1, 3))
        half = _quantise(half, _quality(CHROMA_TABLE, quality))
        planes.append(half.repeat(2, axis=0).repeat(2, axis=1)[:h, :w] - 128.0)
    y, cb, cr = planes
    return to_bytes(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr,
                              y + 1.772 * cb], axis=-1))


def webp(img: np.ndarray, quality: float) -> np.ndarray:
    raise NoCodec("no WebP encoder")


# -- inputs of a model ------------------------------------------------------

def mask_fraction(mask: np.ndarray) -> float:
    """Share of edited pixels: brighter than 127 in a grey mask."""
    plane = mask if mask.ndim == 2 else grey(mask)
    return float((plane > 127).mean())


def tower_input(img: np.ndarray, mode: str = "resize",
                rng: np.random.Generator | None = None, side: int = TOWER_SIDE) -> np.ndarray:
    """Normalised channels-first input: resize and centre crop, native crop or square."""
    h, w = img.shape[:2]
    if mode == "square":
        img = resize(img, side, side, "bilinear")
    elif mode in ("resize", "nativecrop"):
        if mode == "resize" or min(h, w) < side:
            s = side / min(h, w)
            img = resize(img, max(side, round(w * s)), max(side, round(h * s)))
            h, w = img.shape[:2]
        if mode == "resize":
            left, top = (w - side) // 2, (h - side) // 2
        else:
            rng = rng or np.random.default_rng(0)
            left, top = int(rng.integers(0, w - side + 1)), int(rng.integers(0, h - side + 1))
        img = img[top:top + side, left:left + side]
    else:
        raise ValueError(f"unknown input mode {mode!r}")
    return ((img / 255.0 - TOWER_MEAN) / TOWER_STD).transpose(2, 0, 1)


# name: fn(img, params dict, rng)
KERNELS = {
    "identity": lambda im, p, r: im,
    "jpeg": lambda im, p, r: jpeg(im, p["quality"]),
    "webp": lambda im, p, r: webp(im, p["quality"]),
    "blur": lambda im, p, r: blur(im, p["sigma"]),
    "rescale": lambda im, p, r: rescale(im, p["factor"]),
    "resize_cycle": lambda im, p, r: rescale(im, p["factor"], "bicubic", "bicubic", True),
    "shrink": lambda im, p, r: shrink(im, p["factor"]),
    "shrink_soft": lambda im, p, r: shrink(im, p["factor"], "bilinear"),
    "crop": lambda im, p, r: centre_crop(im, p["keep"]),
    "crop_rounded": lambda im, p, r: centre_crop(im, p["keep"], True),
    "bright": lambda im, p, r: contrast(
        brightness(im, 1.0 + p["delta"]), 1.0 - 0.6 * p["delta"]),
    "saturation": lambda im, p, r: saturation(im, 1.0 + p["delta"]),
    "colour": lambda im, p, r: colour(im, p["b"], p["c"], p["s"]),
    "sharpen": lambda im, p, r: sharpness(im, 1.0 + p["amount"]),
    "noise": lambda im, p, r: noise(im, p["sigma"], r),
    "noise01": lambda im, p, r: noise(im, p["sigma"] * 255.0, r),
    "flip": lambda im, p, r: flip(im),
}


def register_kernel(name: str, fn) -> None:
    """Add a kernel ``fn(img, params, rng)``; a later one of the same name replaces it."""
    KERNELS[name] = fn


def apply_chain(img: np.ndarray, chain, rng: np.random.Generator) -> np.ndarray:
    for name, params in chain:
        img = KERNELS[name](img, params, rng)
    return img
