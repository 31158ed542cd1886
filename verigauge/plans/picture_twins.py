"""SQL for what the picture kernels make of an 8 x 8 picture's red channel, as sums of products with fixed matrices.

A plane is a list of rows. Two cells of the official grid have no twin: noise (seeded draws) and colour (grey values
that lie halfway between two bytes, where the order of additions decides).
"""

from __future__ import annotations

import numpy as np

from verigauge.functions import kernels as K
from verigauge.operators.conditions import Condition

SIDE = 8


def matrix_sql(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x:.17e}" for x in row) + "]" for row in m) + "]"


def both_axes(m: np.ndarray, plane: str) -> str:
    """The plane multiplied by a matrix along its columns and its rows."""
    a = matrix_sql(m)
    once = f"list_transform({a}, lambda a: list_transform({plane}, lambda q: list_dot_product(a, q)))"
    return f"list_transform({a}, lambda c: list_transform({once}, lambda p: list_dot_product(c, p)))"


def each(plane: str, expr: str) -> str:
    return f"list_transform({plane}, lambda rw: list_transform(rw, lambda x: {expr}))"


def bytes_sql(plane: str) -> str:
    return each(plane, "least(greatest(round_even(x, 0), 0), 255)")


def blur_matrix(sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma ** 2))
    out = np.zeros((SIDE, SIDE))
    for i in range(SIDE):
        for step, w in zip(range(-r, r + 1), k / k.sum(), strict=True):
            out[i, min(max(i + step, 0), SIDE - 1)] += w
    return out


def quantised(plane: str, table: np.ndarray, quality: float) -> list[tuple[str, str]]:
    """(name, expression) in steps: frequencies, their whole multiples, and the plane again."""
    q = matrix_sql(K._quality(table, quality))
    freq = both_axes(K._DCT, each(plane, "x - 128.0::DOUBLE"))
    return [
        ("freq", freq),
        ("kept", f"list_transform(freq, lambda rw, i: list_transform(rw, lambda x, j: round_even(x / {q}[i][j], 0) * {q}[i][j]))"),
        ("plane", bytes_sql(each(both_axes(K._DCT.T, "kept"), "x + 128.0::DOUBLE")))]


def steps(condition: Condition) -> list[tuple[str, str]] | None:
    """(name, expression) to be computed one after the other from ``r, g, b``; the last one is the red plane."""
    if not condition.chain:
        return [("red", "r")]
    (name, p), = condition.chain
    if name == "blur":
        return [("red", bytes_sql(both_axes(blur_matrix(p["sigma"]), "r")))]
    if name == "rescale":
        n = int(SIDE * p["factor"])
        return [("small", bytes_sql(both_axes(K._resample_matrix(SIDE, n, "lanczos"), "r"))),
                ("red", bytes_sql(both_axes(K._resample_matrix(n, SIDE, "bicubic"), "small")))]
    if name == "crop":
        n = int(SIDE * p["keep"])
        lo = (SIDE - n) // 2
        return [("red", f"list_transform(r[{lo + 1}:{lo + n}], lambda q: q[{lo + 1}:{lo + n}])")]
    if name == "jpeg":
        halves = np.kron(np.eye(SIDE // 2), [[0.5, 0.5]])
        padded = np.vstack([halves, *[halves[-1:]] * (SIDE // 2)])
        twice = np.vstack([np.eye(SIDE)[i // 2] for i in range(SIDE)])
        luma = quantised("luma", K.LUMA_TABLE, p["quality"])
        chroma = quantised("half", K.CHROMA_TABLE, p["quality"])
        return [
            ("luma", "list_transform(r, lambda rw, i: list_transform(rw, lambda x, j: "
                     "0.299::DOUBLE * x + 0.587::DOUBLE * g[i][j] + 0.114::DOUBLE * b[i][j]))"),
            *[("y_" + n, e.replace("freq,", "y_freq,").replace('kept, lambda', 'y_kept, lambda')) for n, e in luma],
            ("half", both_axes(padded, "list_transform(r, lambda rw, i: list_transform(rw, lambda x, j: "
                                       "(x - luma[i][j]) / 1.402::DOUBLE + 128.0::DOUBLE))")),
            *[("c_" + n, e.replace("freq,", "c_freq,").replace('kept, lambda', 'c_kept, lambda')) for n, e in chroma],
            ("wide", both_axes(twice, "c_plane")),
            ("red", bytes_sql("list_transform(y_plane, lambda rw, i: list_transform(rw, lambda x, j: "
                              "x + 1.402::DOUBLE * (wide[i][j] - 128.0::DOUBLE)))"))]
    return None


def red_means(conditions: list[Condition]) -> tuple[str, list[Condition]]:
    """Rows (key, severity, y, s) for every cell that has a twin, from ``px(y, r, g, b)``; and the cells without one."""
    parts, without = [], []
    for c in conditions:
        chain = steps(c)
        if chain is None:
            without.append(c)
            continue
        at = "px"
        for name, expr in chain:
            at = f"(SELECT *, {expr} AS {name} FROM {at})"
        mean = "list_sum(list_transform(red, lambda q: list_sum(q))) / (len(red) * len(red[1]))::DOUBLE / 255.0::DOUBLE"
        parts.append(f"SELECT '{c.key}' AS key, {c.severity} AS severity, y, round_even({mean} * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS s FROM {at}")
    return "\nUNION ALL ".join(parts), without
