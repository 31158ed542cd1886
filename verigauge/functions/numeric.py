"""Numeric column expressions. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**-53 * (1 + 2**-52): a little over half a unit in the last place.
_HALF_ULP = 2.0 ** -53 * (1.0 + 2.0 ** -52)
_SMALLEST = 5e-324
_NORMAL = 2.2250738585072014e-308
_LARGEST = 1.7976931348623157e308


def nan_to_null(c: Column) -> Column:
    """Failed scores arrive as NaN; Spark sorts NaN above everything, so make it NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL where the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def next_above(c: Column) -> Column:
    """The smallest double greater than c."""
    return F.when(F.abs(c) < _NORMAL, c + F.lit(_SMALLEST)).otherwise(
        c + F.abs(c) * F.lit(_HALF_ULP))


def ordinal_sql(name: str) -> str:
    """SQL text of a 63-bit integer that never decreases as the double column grows.

    Used to cut a score axis into buckets whose size has a bound that does not
    depend on the data: dropping the low k bits leaves at most 2**k distinct
    doubles in a bucket.
    """
    size = f"least(abs({name}), {_LARGEST!r}D)"
    exponent = f"greatest(floor(log2({size})), -1022L)"
    mantissa = f"({size} * power(2.0D, -cast({exponent} AS double)) - 1.0D)"
    # zero has no logarithm, so it takes the lowest exponent and comes out as 0
    return (f"cast(sign({name}) AS bigint) * (({exponent} + 1023L) * {2 ** 52}L "
            f"+ floor({mantissa} * {2 ** 52}.0D))")


def grid_bin(c: Column, bins: int) -> Column:
    """How many of the points 1/bins, 2/bins, ... are <= c, from 0 up to ``bins``.

    The edges are ``i * (1.0 / bins)``, so a value that sits on an edge lands in
    the bin to its right whatever ``c * bins`` rounds to.
    """
    step = 1.0 / bins
    guess = F.least(F.greatest(F.floor(c * bins), F.lit(0)), F.lit(bins)).cast("int")

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))

    return (
        F.when((guess > 0) & (c < edge(guess)), guess - 1)
        .when((guess < bins) & (c >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
