"""The degradation grids: which kernels with which numbers, as condition lists."""

from __future__ import annotations

from verigauge.functions.kernels import KERNELS
from verigauge.operators.conditions import Condition

NO_WEBP = KERNELS["webp"]

CLEAN = Condition("clean", "clean", 0, "clean", chain=())


def _one(kernel: str, name: str, value: float) -> tuple:
    return ((kernel, {name: float(value)}),)


# Fixed values of the graded grid: kernel, parameter, levels mild to harsh, labels.
GRADED = {
    "jpeg": ("jpeg", "quality", [90, 75, 60, 45, 30], "q{:g}"),
    "webp": ("webp", "quality", [90, 80, 70, 55, 40], "q{:g}"),
    "blur": ("blur", "sigma", [0.5, 1.0, 1.5, 2.0, 3.0], "σ{:.1f}"),
    "rescale": ("rescale", "factor", [0.75, 0.5, 0.35, 0.25, 0.15], "{:.0%}"),
    "crop": ("crop", "keep", [0.95, 0.85, 0.75, 0.60, 0.50], "keep {:.0%}"),
    "bright": ("bright", "delta", [0.05, 0.10, 0.20, 0.30, 0.40], "±{:.0%}"),
    "saturation": ("saturation", "delta", [0.15, 0.30, 0.50, 0.75, 1.00], "+{:.0%}"),
    "noise": ("noise", "sigma", [2, 4, 8, 12, 20], "σ{:g}"),
}
# Fixed values of the graded grid: five passes of the two chains.
REPOST_SCALE, REPOST_QUALITY = [0.9, 0.75, 0.6, 0.45, 0.35], [88, 78, 68, 55, 42]
SCREEN_SCALE, SCREEN_QUALITY = [0.95, 0.85, 0.7, 0.55, 0.4], [92, 85, 75, 65, 55]

# Fixed values of the official grid.
OFFICIAL = {
    "off_jpeg": ("jpeg", "quality", [90, 70, 50, 30], "q{:g}"),
    "off_blur": ("blur", "sigma", [0.5, 1.0, 2.0], "σ{:.1f}"),
    "off_resize": ("rescale", "factor", [0.5, 0.25], "{:g}×"),
    "off_noise": ("noise01", "sigma", [0.02, 0.05, 0.10], "σ{:.2f}"),
    "off_jitter": ("colour", None, [0.20], "±{:.0%}"),
    "off_crop": ("crop", "keep", [0.80], "keep {:.0%}"),
}


def _cells(table: dict) -> list[Condition]:
    out = []
    for key, (kernel, name, levels, label) in table.items():
        for i, v in enumerate(levels, 1):
            chain = _one(kernel, name, v) if name else (
                (kernel, {"b": 1.0 + v, "c": 1.0 + v, "s": 1.0 + v}),)
            out.append(Condition(key, key, i, label.format(v), {"level": float(v)}, chain))
    return out


def graded_grid() -> list[Condition]:
    """Clean and 10 transforms at 5 severities."""
    cells = _cells(GRADED)
    for i in range(5):
        cells.append(Condition("social", "social", i + 1, f"pass {i + 1}", {"level": i + 1.0}, (
            ("shrink", {"factor": REPOST_SCALE[i]}), ("sharpen", {"amount": 0.4}),
            ("jpeg", {"quality": REPOST_QUALITY[i]}))))
    for i in range(5):
        cells.append(Condition(
            "screenshot", "screenshot", i + 1, f"level {i + 1}", {"level": i + 1.0}, (
                ("shrink_soft", {"factor": SCREEN_SCALE[i]}),
                ("blur", {"sigma": 0.3 + 0.2 * (i + 1)}),
                ("jpeg", {"quality": SCREEN_QUALITY[i]}))))
    return [CLEAN, *cells]


def official_grid() -> list[Condition]:
    """Clean and 14 cells at their native levels."""
    return [CLEAN, *_cells(OFFICIAL)]


def _row(name: str, family: str, *chain: tuple) -> Condition:
    return Condition(name, family, 1, name, {}, chain)


# Fixed values of the evaluation grid, after clean.
EVALUATION = [
    _row("jpeg_q90", "jpeg", ("jpeg", {"quality": 90.0})),
    _row("jpeg_q70", "jpeg", ("jpeg", {"quality": 70.0})),
    _row("jpeg_q50", "jpeg", ("jpeg", {"quality": 50.0})),
    _row("jpeg_q30", "jpeg", ("jpeg", {"quality": 30.0})),
    _row("blur_s0.5", "blur", ("blur", {"sigma": 0.5})),
    _row("blur_s1.0", "blur", ("blur", {"sigma": 1.0})),
    _row("blur_s2.0", "blur", ("blur", {"sigma": 2.0})),
    _row("resize_0.5x", "resize", ("resize_cycle", {"factor": 0.5})),
    _row("resize_0.25x", "resize", ("resize_cycle", {"factor": 0.25})),
    _row("noise_s0.02", "noise", ("noise01", {"sigma": 0.02})),
    _row("noise_s0.05", "noise", ("noise01", {"sigma": 0.05})),
    _row("noise_s0.1", "noise", ("noise01", {"sigma": 0.1})),
    _row("color_up", "color", ("colour", {"b": 1.2, "c": 1.2, "s": 1.2})),
    _row("color_down", "color", ("colour", {"b": 0.8, "c": 0.8, "s": 0.8})),
    _row("color_mixed", "color", ("colour", {"b": 1.2, "c": 0.8, "s": 1.2})),
    _row("crop_80", "crop", ("crop_rounded", {"keep": 0.8})),
]
# Fixed values of the severities and codecs outside the training ranges.
HELDOUT = [
    _row("jpeg_q20", "jpeg_ood", ("jpeg", {"quality": 20.0})),
    _row("blur_s3.0", "blur_ood", ("blur", {"sigma": 3.0})),
    _row("resize_0.125x", "resize_ood", ("resize_cycle", {"factor": 0.125})),
    _row("noise_s0.15", "noise_ood", ("noise01", {"sigma": 0.15})),
    _row("crop_50", "crop_ood", ("crop_rounded", {"keep": 0.5})),
    _row("webp_q50", "codec_ood", ("webp", {"quality": 50.0})),
]
# Fixed values of the redistribution chains.
CHAINS = [
    _row("social_repost", "chain", ("jpeg", {"quality": 90.0}), ("resize_cycle", {"factor": 0.5}), ("jpeg", {"quality": 70.0})),
    _row("filtered_share", "chain", ("colour", {"b": 1.15, "c": 1.1, "s": 1.2}), ("jpeg", {"quality": 60.0})),
    _row("thumbnail_crop", "chain", ("resize_cycle", {"factor": 0.25}), ("crop_rounded", {"keep": 0.8}), ("jpeg", {"quality": 70.0})),
    _row("lowlight_msg", "chain", ("noise01", {"sigma": 0.05}), ("blur", {"sigma": 0.5}), ("jpeg", {"quality": 50.0})),
    _row("screenshot_chain", "chain", ("colour", {"b": 1.1, "c": 1.05, "s": 0.95}), ("jpeg", {"quality": 80.0}),
         ("resize_cycle", {"factor": 0.5}), ("jpeg", {"quality": 40.0})),
]


def evaluation_grid() -> list[Condition]:
    """17 conditions of the evaluation grid, clean included."""
    return [CLEAN, *EVALUATION]


def heldout_grid() -> list[Condition]:
    """6 severities and codecs outside the training ranges."""
    return list(HELDOUT)


def chain_grid() -> list[Condition]:
    """5 composed redistribution chains."""
    return list(CHAINS)


def encodable(grid: list[Condition]) -> list[Condition]:
    """The cells that the registered kernels can make: there is no WebP encoder unless one is registered."""
    return [c for c in grid if not any(
        name == "webp" and KERNELS["webp"] is NO_WEBP for name, _ in c.chain)]


def all_conditions() -> list[Condition]:
    return evaluation_grid() + heldout_grid() + chain_grid()


def severity_cell(grid: list[Condition], key: str, severity: int) -> Condition:
    """The cell of a transform, with the severity clamped to the levels it has."""
    levels = {c.severity: c for c in grid if c.key == key}
    if not levels:
        raise KeyError(key)
    return levels[max(min(levels), min(max(levels), int(severity)))]
