"""Filter state of a page as column predicates: "All" or None means no restriction."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def chosen(value: Any) -> bool:
    return value is not None and not (isinstance(value, str) and value == ALL)


def predicate(filters: Mapping[str, Any]) -> Column | None:
    """AND over the chosen filters; a list means any of its values. Values are bound as literals."""
    parts = []
    for column, value in filters.items():
        if not chosen(value):
            continue
        if isinstance(value, (list, tuple, set)):
            parts.append(F.col(column).isin(*value))
        else:
            parts.append(F.col(column) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    condition = predicate(filters or {})
    return df if condition is None else df.where(condition)


def ordered_range(
    start: float | None, end: float | None, low: float, high: float
) -> tuple[float, float]:
    """Clamp both ends of a user range into [low, high] and put the smaller one first."""
    if high <= low:
        high = low + 1

    def clamp(value: float | None, default: float) -> float:
        return default if value is None else min(max(value, low), high)

    a, b = clamp(start, low), clamp(end, high)
    return min(a, b), max(a, b)
