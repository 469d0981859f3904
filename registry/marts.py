"""Finished tables of one data folder, written once per session and read by the page queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import adapter
from trackline.operators.series import Series
from trackline.operators.signals import VEHICLE
from trackline.plans import laps, pages, telemetry, track, weather
from trackline.session import use_utc, write_shared

RACE = ("circuit", "race_number")
WHOLE_TRACK = Series(VEHICLE, ("event_timestamp", "event_source"))
_open: dict[tuple[str, str], "Marts"] = {}


class Marts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        use_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir

    # Inputs, read from the given tables whenever they are used.

    def telemetry(self, metres: int = adapter.TRACK_METRES) -> DataFrame:
        return adapter.telemetry(self.spark, self.sf_dir, metres)

    def lap_events(self, kind: str) -> DataFrame:
        return adapter.lap_events(self.spark, self.sf_dir, kind)

    def weather(self) -> DataFrame:
        return adapter.weather(self.spark, self.sf_dir)

    # Tables.

    @cached_property
    def periods(self) -> DataFrame:
        table = telemetry.signal_periods(self.telemetry())
        return write_shared(table, "signal_periods", ("telemetry_name",))

    @cached_property
    def position(self) -> DataFrame:
        return write_shared(telemetry.position_periods(self.telemetry()), "position_periods")

    @cached_property
    def acc(self) -> DataFrame:
        return write_shared(telemetry.acc_periods(self.telemetry()), "acc_periods")

    @cached_property
    def timeline(self) -> DataFrame:
        table = telemetry.timeline(self.periods, self.position, self.acc)
        return write_shared(table, "timeline", RACE)

    @cached_property
    def spine(self) -> DataFrame:
        return track.sector_spine(track.sector_lengths(self.spark))

    @cached_property
    def placed(self) -> DataFrame:
        return write_shared(track.on_track(self.timeline, self.spine), "placed", RACE)

    @cached_property
    def audit_placed(self) -> DataFrame:
        """Telemetry on the short audit track, where enough laps share a metre."""
        distance = telemetry.signal_periods(
            self.telemetry(adapter.AUDIT_METRES), ["Laptrigger_lapdist_dls"]
        )
        others = self.periods.where(F.col("telemetry_name") != "Laptrigger_lapdist_dls")
        line = telemetry.timeline(others.unionByName(distance), self.position, self.acc)
        lengths = self.spark.createDataFrame(
            adapter.AUDIT_SECTORS, "sector_number int, sector_name string, metres int"
        ).select(
            "sector_number", "sector_name", F.col("metres").cast("decimal(18,4)").alias("length_m")
        )
        return write_shared(
            track.on_track(line, track.sector_spine(lengths)), "audit_placed", RACE
        )

    @cached_property
    def combined_laps(self) -> DataFrame:
        table = laps.combined_laps(
            laps.lap_starts(self.lap_events("lap_start")), laps.lap_ends(self.lap_events("lap_end"))
        )
        return write_shared(table, "combined_laps")

    @cached_property
    def laps(self) -> DataFrame:
        return write_shared(laps.with_weather(self.combined_laps, self.weather()), "lap_facts", RACE)

    @cached_property
    def braking(self) -> DataFrame:
        """Braking points of all laps of every vehicle."""
        located = self.timeline.where(
            F.col("vbox_long_minutes").isNotNull() & F.col("vbox_lat_minutes").isNotNull()
        )
        return write_shared(pages.braking_points(located, series=WHOLE_TRACK), "braking_points")

    @cached_property
    def wind(self) -> DataFrame:
        return weather.wind_of_seconds(write_shared(weather.wind_seconds(self.weather()), "wind_seconds", RACE))


def open_marts(spark: SparkSession, sf_dir: str) -> Marts:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Marts(spark, sf_dir)
    return _open[key]
