"""Signals of the long telemetry table: extraction and pairing of two channels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEHICLE = ("circuit", "race_number", "vehicle_id")


def extract(telemetry: DataFrame, name: str, alias: str) -> DataFrame:
    """Rows of one signal with its value under ``alias``; the filter reaches the scan."""
    return (
        telemetry.where(F.col("telemetry_name") == name)
        .withColumnRenamed("telemetry_value", alias)
        .drop("telemetry_name")
    )


def pair_channels(
    telemetry: DataFrame,
    left: tuple[str, str, dict[str, str]],
    right: tuple[str, str, dict[str, str]],
    keys: Sequence[str] = VEHICLE,
    time: str = "timestamp",
) -> DataFrame:
    """One row per series and exact time with the newest reading of two channels.

    Each side is (signal name, output value column, {output: input} further columns). This is the
    full outer join of both deduplicated channels, done as one aggregation on (series, time): it
    scans once, shuffles once and combines before the shuffle. A key with a NULL part matches
    nothing in a join, so its two channels stay apart.
    """
    sides = (left, right)
    both = telemetry.where(F.col("telemetry_name").isin(left[0], right[0]))
    matched = [*keys, time]
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in matched])
    newest = F.struct("meta_time", "telemetry_value")
    picks = []
    for i, (name, value, extra) in enumerate(sides):
        fields = F.struct(
            F.col("telemetry_value").alias(value),
            *[F.col(src).alias(out) for out, src in extra.items()],
        )
        picks.append(
            F.max_by(fields, F.when(F.col("telemetry_name") == name, newest)).alias(f"_side{i}")
        )
    grouped = both.groupBy(
        *matched, F.when(unmatched, F.col("telemetry_name")).alias("_apart")
    ).agg(*picks)
    return grouped.select(
        *matched,
        *[
            F.col(f"_side{i}")[out].alias(out)
            for i, (_, value, extra) in enumerate(sides)
            for out in (value, *extra)
        ],
    )
