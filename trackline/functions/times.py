"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from ``start`` to ``end``; fractions are cut off each first."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def local_time(utc: Column, zone: str = "EST") -> Column:
    """Wall-clock time in a zone of a UTC time."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone)


def utc_time(local: Column, zone: str = "EST") -> Column:
    """UTC time of a wall-clock time in a zone, for files without a zone mark."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone)
