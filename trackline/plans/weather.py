"""Weather readings by quantity and wind facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import weather as W
from trackline.operators.pairs import MAX_CELL_ROWS, grouped_sides, pairs_of, self_full_join

QUANTITIES = {
    "air_temp": ("air_temp_fahrenheit", "air_temp_celsius"),
    "track_temp": ("track_temp_fahrenheit", "track_temp_celsius"),
    "humidity": ("humidity_percentage",),
    "pressure": ("pressure_inches", "pressure_mbars"),
    "wind_speed": ("wind_speed_mph", "wind_speed_kph"),
    "wind_direction": ("wind_direction_degrees",),
}
READING = ("circuit", "race_number", "time_utc", "time_utc_seconds")


def converted(weather: DataFrame, inhg_to_mbar: float = W.INHG_TO_MBAR) -> DataFrame:
    """All quantities of a reading in both unit systems, one row per reading."""
    air, track = F.col("air_temp"), F.col("track_temp")
    return weather.select(
        "circuit",
        "race_number",
        F.col("time_utc_str").alias("time_utc"),
        "time_utc_seconds",
        air.alias("air_temp_fahrenheit"),
        W.celsius(air).alias("air_temp_celsius"),
        track.alias("track_temp_fahrenheit"),
        W.celsius(track).alias("track_temp_celsius"),
        F.col("humidity").alias("humidity_percentage"),
        F.col("pressure").alias("pressure_inches"),
        W.millibar(F.col("pressure"), inhg_to_mbar).alias("pressure_mbars"),
        F.col("wind_speed").alias("wind_speed_mph"),
        W.kph(F.col("wind_speed")).alias("wind_speed_kph"),
        F.col("wind_direction").alias("wind_direction_degrees"),
    )


def quantity(weather: DataFrame, name: str) -> DataFrame:
    """Readings of one quantity, without those that lack it."""
    columns = QUANTITIES[name]
    return converted(weather).select(*READING, *columns).where(F.col(columns[0]).isNotNull())


RACE_SECOND = ("circuit", "race_number", "time_utc_seconds")


def _wind_sides() -> tuple[Column, Column]:
    """Direction and speed of a converted reading, NULL where it lacks them."""
    direction = F.struct(F.col("time_utc"), F.col("wind_direction_degrees"))
    speed = F.struct(F.col("time_utc"), F.col("wind_speed_mph"), F.col("wind_speed_kph"))
    return (
        F.when(F.col("wind_direction_degrees").isNotNull(), direction),
        F.when(F.col("wind_speed_mph").isNotNull(), speed),
    )


def wind_facts(weather: DataFrame, max_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """Wind direction and speed of one race second, also where one of the two is missing.

    The readings are read and exchanged once; ``max_rows`` bounds the readings of one side of a
    second that meet in one place.
    """
    return _wind_columns(self_full_join(converted(weather), RACE_SECOND, *_wind_sides(), max_rows))


def wind_seconds(weather: DataFrame, max_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """Directions and speeds of each race second in lists, to be stored and read by ``wind_of_seconds``.

    Wind facts are pairs of readings, whose number grows with the square of those of a second; this
    table holds every reading once.
    """
    return grouped_sides(converted(weather), RACE_SECOND, *_wind_sides(), max_rows)


def wind_of_seconds(seconds: DataFrame) -> DataFrame:
    """The rows of ``wind_facts`` from a stored table of ``wind_seconds``."""
    return _wind_columns(pairs_of(seconds, RACE_SECOND))


def _wind_columns(both: DataFrame) -> DataFrame:
    degrees, mph = F.col("left.wind_direction_degrees"), F.col("right.wind_speed_mph")
    return both.select(
        F.coalesce("left.time_utc", "right.time_utc").alias("time_utc"),
        "time_utc_seconds",
        mph.alias("wind_speed_mph"),
        F.col("right.wind_speed_kph").alias("wind_speed_kph"),
        degrees.alias("wind_direction_degrees"),
        W.compass_label(W.normal_degrees(degrees)).alias("wind_direction_label"),
        W.speed_band(mph).alias("wind_speed_band_mph"),
        "circuit",
        "race_number",
    )
