"""Join of points to the intervals that contain them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
# Slot widths in microseconds. An interval is looked up at the narrowest width that is not
# shorter than the interval, so it touches at most two slots; the last width takes the rest.
LEVELS = (2 * MINUTE, 30 * MINUTE, 8 * 60 * MINUTE, 5 * 24 * 60 * MINUTE, 80 * 24 * 60 * MINUTE)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def join_points_in_intervals(
    intervals: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    start: str,
    end: str,
    at: str,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Inner join on ``on`` and start <= at <= end, both ends included.

    A join on ``on`` alone would test every point of a race against every interval of it. Here
    both sides also meet on a time slot, so only neighbours are tested: each interval is copied
    to the slots it touches, each point to one slot for each width in use. Intervals with a
    missing or reversed end contain nothing and are left out.

    The widths in use are looked up first, at most one number per level, so points are not copied
    for lengths that do not occur. ``intervals`` is read twice and should be a stored table.
    """
    length = _micros(end) - _micros(start)
    level = F.lit(len(levels) - 1)
    for i in range(len(levels) - 2, -1, -1):
        level = F.when(length <= levels[i], F.lit(i)).otherwise(level)
    widths = F.array(*[F.lit(w).cast("bigint") for w in levels])

    def slot(column: str, width: Column) -> Column:
        return F.floor(_micros(column) / width).cast("bigint")

    valid = intervals.where(F.col(start) <= F.col(end))
    used = sorted(row[0] for row in valid.select(level.alias("_level")).distinct().collect())
    spans = (
        valid.withColumn("_level", level)
        .withColumn("_width", F.get(widths, F.col("_level")))
        .withColumn(
            "_slot", F.explode(F.sequence(slot(start, F.col("_width")), slot(end, F.col("_width"))))
        )
        .drop("_width")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("_level"), F.lit(levels[i]).cast("bigint").alias("_width"))
            for i in used or [0]
        ]
    )
    marks = (
        points.where(F.col(at).isNotNull())
        .select("*", F.inline(wanted))
        .withColumn("_slot", slot(at, F.col("_width")))
        .drop("_width")
    )
    return (
        spans.join(marks, [*on, "_level", "_slot"], "inner")
        .where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
        .drop("_level", "_slot")
    )
