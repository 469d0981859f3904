"""Sums of doubles that do not depend on the order of the rows or on where a series is cut.

A value is split exactly into whole units and two limbs of 32 bits behind the point, which are
summed as integers. Whatever the order, the integers are the same, and so is the double made of
them. Bits below 2**-64 are cut off value by value. NaN, infinities and values from 2**62 on are
summed as doubles beside the limbs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = float(1 << 32)
#: Values whose whole part fits a long with room for sums.
LARGEST = float(1 << 62)


def limbs(value: Column) -> list[Column]:
    """Whole units, two limbs, and what the limbs cannot hold; all NULL for NULL."""
    x = value.cast("double")
    fits = F.abs(x) < LARGEST
    fine = F.when(fits, x)
    whole = F.floor(fine)
    rest = (fine - whole) * LIMB
    upper = F.floor(rest)
    lower = F.floor((rest - upper) * LIMB)
    return [whole.cast("bigint"), upper.cast("bigint"), lower.cast("bigint"), F.when(~fits | F.isnan(x), x)]


def total(whole: Column, upper: Column, lower: Column, other: Column) -> Column:
    """The double of summed limbs."""
    upper = upper + F.shiftright(lower, 32)
    whole = whole + F.shiftright(upper, 32)
    mask = F.lit((1 << 32) - 1)
    # Up to 2**21 whole units the first sum is exact, so that the double is rounded once.
    fine = whole + upper.bitwiseAND(mask) / LIMB + lower.bitwiseAND(mask) / LIMB / LIMB
    return F.when(other.isNull(), fine).otherwise(F.coalesce(fine, F.lit(0.0)) + other)


def exact_sum(value: Column, summed: Callable[[Column], Column] = F.sum) -> Column:
    """Sum of a column; ``summed`` is the sum to take, over a window for example."""
    return total(*[summed(part) for part in limbs(value)])


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))
