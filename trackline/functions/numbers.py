"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, for tables on a page."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def scaled_round(value: Column, digits: int) -> Column:
    """A double rounded as doubles: scaled, taken to the nearest whole number, and scaled back.

    Engines that round doubles this way differ in ties from one that rounds the printed number.
    """
    scale = 10.0**digits
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def ordered_bits(value: Column) -> Column:
    """A whole number for every double, in the order of the doubles: the bits of its size, with its sign.

    Made of a power of two and the digits behind it, both exact; NaN is greater than infinity, and
    the two zeros are one.
    """
    x = value.cast("double")
    size = F.abs(x)
    near = F.floor(F.log2(size)).cast("int")
    # The logarithm may be rounded across a power of two.
    power = (
        F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    )
    digits = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(F.isnan(x), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise((power.cast("bigint") + 1023) * F.lit(1 << 52) + digits)
    )
    return F.when(x < 0, -bits).otherwise(bits)
