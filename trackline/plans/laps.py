"""Lap starts and ends, lap times, best laps, and lap facts with weather statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.functions.numbers import scaled_round
from trackline.functions.times import local_time, seconds_between
from trackline.operators.intervals import LEVELS, join_points_in_intervals
from trackline.operators.ranges import MAX_WINDOW_ROWS, range_statistics
from trackline.operators.series import Series, fixed_chunk, shift, unsplit
from trackline.plans.weather import converted

LAP_EVENT = ("circuit", "race_number", "vehicle_id", "lap")
LAP = ("circuit", "race_number", "vehicle_id", "vehicle_number", "lap", "outing")
DETAILS = ("meta_event", "meta_session", "meta_source", "meta_time", "original_vehicle_id",
           "expire_at")
OUTING = Series(("circuit", "race_number", "vehicle_id", "outing"), ("lap",))
LAPS_PER_CHUNK = 4096

MEASURES = ("humidity_percentage", "pressure_inches", "pressure_mbars", "air_temp_fahrenheit",
            "air_temp_celsius", "track_temp_fahrenheit", "track_temp_celsius")


def _one_per_lap(events: DataFrame, newest: bool) -> DataFrame:
    """One event per vehicle and lap, by time; aggregated before the shuffle, never a full sort."""
    rest = [c for c in events.columns if c not in LAP_EVENT]
    pick = F.max_by if newest else F.min_by
    rank = F.struct("timestamp", "meta_time", "outing", "original_vehicle_id")
    kept = events.groupBy(*LAP_EVENT).agg(pick(F.struct(*rest), rank).alias("_kept"))
    return kept.select(*LAP_EVENT, "_kept.*")


def lap_starts(events: DataFrame, zone: str = "EST") -> DataFrame:
    """The earliest start of each lap; starts without a time are left out."""
    first = _one_per_lap(events.where(F.col("timestamp").isNotNull()), newest=False)
    return first.withColumn(
        "lap_start_timestamp", local_time(F.col("timestamp"), zone)
    ).withColumnRenamed("timestamp", "lap_start_timestamp_utc")


def lap_ends(events: DataFrame, zone: str = "EST") -> DataFrame:
    """The latest end of each lap."""
    last = _one_per_lap(events, newest=True)
    return last.withColumn(
        "lap_end_timestamp", local_time(F.col("timestamp"), zone)
    ).withColumnRenamed("timestamp", "lap_end_timestamp_utc")


def lap_times(events: DataFrame) -> DataFrame:
    return events.where(F.col("timestamp").isNotNull()).withColumnRenamed(
        "timestamp", "lap_time_timestamp"
    )


def best_laps(raw: DataFrame) -> DataFrame:
    """Ten best laps per vehicle, kept wide."""
    renamed = {f"bestlap_{i}": f"bestlap_{i}_elapsed_time" for i in range(1, 11)}
    renamed |= {"number": "vehicle_number", "average": "average_best_lap"}
    return raw.withColumnsRenamed(renamed).where(F.col("vehicle_number").isNotNull())


def combined_laps(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts and ends joined per lap; a missing side is taken from the neighbouring lap.

    Durations use the measured times only, so a lap with an imputed side has none. Laps whose
    outing is NULL do not match and stay as two rows.
    """
    # After the deduplication a lap number occurs once per vehicle, so a chunk of lap numbers is
    # bounded by its width.
    chunk = F.coalesce(F.floor(F.col("lap") / LAPS_PER_CHUNK), F.lit(2**63 - 1))
    starts = unsplit(
        shift(
            fixed_chunk(starts, OUTING, chunk),
            OUTING,
            {"_next_start": "lap_start_timestamp_utc"},
            -1,
        )
    )
    ends = unsplit(
        shift(
            fixed_chunk(ends, OUTING, chunk), OUTING, {"_previous_end": "lap_end_timestamp_utc"}, 1
        )
    )
    on = ["circuit", "race_number", "vehicle_id", "outing", "lap"]
    s = starts.select(*on, *[F.col(c).alias(f"s_{c}") for c in ("vehicle_number", *DETAILS)],
                      F.col("lap_start_timestamp_utc").alias("s_start"), "_next_start")
    e = ends.select(*on, *[F.col(c).alias(f"e_{c}") for c in ("vehicle_number", *DETAILS)],
                    F.col("lap_end_timestamp_utc").alias("e_end"), "_previous_end")
    both = s.join(e, on, "full_outer")
    return both.select(
        *on,
        F.coalesce("s_vehicle_number", "e_vehicle_number").alias("vehicle_number"),
        F.coalesce("s_start", "_previous_end").alias("lap_start_timestamp_utc"),
        F.coalesce("e_end", "_next_start").alias("lap_end_timestamp_utc"),
        seconds_between(F.col("s_start"), F.col("e_end")).alias("lap_duration_seconds"),
        (F.col("e_end") - F.col("s_start")).alias("lap_duration_minutes"),
        *[F.coalesce(f"s_{c}", f"e_{c}").alias(c) for c in DETAILS],
    )


def lap_weather(
    laps: DataFrame, weather: DataFrame, levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Each lap with every reading from its start to its end, both included."""
    keyed = laps.select(*LAP, "lap_start_timestamp_utc", "lap_end_timestamp_utc").dropna(
        subset=list(LAP)
    )
    readings = converted(weather).select("circuit", "race_number", "time_utc", *MEASURES)
    return join_points_in_intervals(
        keyed,
        readings,
        ["circuit", "race_number"],
        "lap_start_timestamp_utc",
        "lap_end_timestamp_utc",
        "time_utc",
        levels,
    )


def lap_weather_statistics(
    laps: DataFrame,
    weather: DataFrame,
    levels: Sequence[int] = LEVELS,
    max_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Maximum, mean and median of each measure per lap, without a row per lap and reading."""
    keyed = laps.select(*LAP, "lap_start_timestamp_utc", "lap_end_timestamp_utc").dropna(subset=list(LAP))
    readings = converted(weather).select("circuit", "race_number", "time_utc", *MEASURES)
    found = range_statistics(
        keyed,
        readings,
        ["circuit", "race_number"],
        LAP,
        "lap_start_timestamp_utc",
        "lap_end_timestamp_utc",
        "time_utc",
        MEASURES,
        levels,
        max_rows,
    )
    return found.withColumnsRenamed({f"{s}_{m}": f"lap_{s}_{m}" for s in ("max", "mean", "median") for m in MEASURES})


def lap_facts(
    start_events: DataFrame,
    end_events: DataFrame,
    weather: DataFrame,
    levels: Sequence[int] = LEVELS,
    max_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    laps = combined_laps(lap_starts(start_events), lap_ends(end_events))
    return with_weather(laps, weather, levels, max_rows)


def with_weather(
    laps: DataFrame,
    weather: DataFrame,
    levels: Sequence[int] = LEVELS,
    max_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Lap facts of combined laps. The laps are used twice, so hand in a stored table of them."""
    statistics = lap_weather_statistics(laps, weather, levels, max_rows)
    # Plain equality: a lap with a NULL in its key keeps its row and gets no statistics.
    joined = laps.join(statistics, list(LAP), "left")
    rounded = [
        scaled_round(F.col(f"lap_{s}_{m}"), 3).alias(f"lap_{s}_{m}")
        for m in MEASURES
        for s in ("max", "mean", "median")
    ]
    return joined.where(
        F.col("lap_start_timestamp_utc").isNotNull() | F.col("lap_end_timestamp_utc").isNotNull()
    ).select(
        *LAP,
        "lap_start_timestamp_utc",
        "lap_end_timestamp_utc",
        "lap_duration_seconds",
        "lap_duration_minutes",
        *DETAILS,
        *rounded,
    )
