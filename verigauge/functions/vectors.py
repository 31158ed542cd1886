"""Feature-vector column expressions over array<double>."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verigauge.functions.numeric import sigmoid

L2_EPSILON = 1e-8
SD_EPSILON = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def each_with(v: Column, number: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(element, number)`` for every element; the number is computed once per row.

    Inside a lambda an outer expression would be evaluated again for every element.
    """
    return F.zip_with(v, F.array_repeat(number, F.size(v)), fn)


def l2_normalise(v: Column) -> Column:
    return each_with(v, norm(v) + L2_EPSILON, lambda x, size: x / size)


def standardise(v: Column, mu: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(v, mu, lambda x, m: x - m), sd, lambda x, s: x / s)


def linear_logit(v: Column, weights: Sequence[float], bias: float, mu: Sequence[float],
                 sd: Sequence[float], l2: bool = True) -> Column:
    """Logit of L2-normalise, standardise and a linear layer, folded into one dot product."""
    slope = [w / s for w, s in zip(weights, sd)]
    offset = bias - sum(m * k for m, k in zip(mu, slope))
    raw = dot(v, literal(slope))
    return (raw / (norm(v) + L2_EPSILON) if l2 else raw) + F.lit(float(offset))


def positive_probability(logits: Column, index: int) -> Column:
    """P(AI) from a classifier's outputs: sigmoid of a single logit, else softmax at ``index``."""
    top = F.array_max(logits)
    total = F.aggregate(each_with(logits, top, lambda x, t: F.exp(x - t)), F.lit(0.0),
                        lambda s, x: s + x)
    return F.when(F.size(logits) == 1, sigmoid(logits[0])).otherwise(
        F.exp(F.try_element_at(logits, F.lit(index + 1)) - top) / total)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + L2_EPSILON)
