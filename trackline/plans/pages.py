"""Queries of the analysis pages, over the finished tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import weather as W
from trackline.functions.filters import apply_filters, chosen, ordered_range
from trackline.functions.numbers import fixed
from trackline.operators import stats
from trackline.operators.series import TIME_SLOTS, Series, running_sum, shift, split, unsplit

Filters = Mapping[str, Any] | None

LAP_METRICS = {
    "speed": "speed",
    "nmot": "nmot",
    "aps": "aps",
    "front_brake": "front_brake_pressure",
    "rear_brake": "rear_brake_pressure",
}
HISTOGRAM_METRICS = ("speed", "aps", "front_brake_pressure", "rear_brake_pressure")


def _asc(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def _desc(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def _top(df: DataFrame, order: Sequence[Column], rows: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if rows is None else ordered.limit(rows)


# Pick-lists


def options(table: DataFrame, column: str, filters: Filters = None) -> DataFrame:
    """Distinct non-null values of a column under the other chosen filters, in order."""
    return (
        apply_filters(table, filters)
        .where(F.col(column).isNotNull())
        .select(column)
        .distinct()
        .orderBy(column)
    )


def first_vehicles(table: DataFrame, filters: Filters = None, count: int = 3) -> list[Any]:
    """The first few vehicles of a pick-list, as values for a filter."""
    return [row[0] for row in options(table, "vehicle_id", filters).limit(count).collect()]


# Overview


def _kinds(column: str) -> Column:
    """Number of distinct values, as the size of their set; for columns of few values.

    Several distinct counts in one aggregation would copy every row for each of them.
    """
    return F.size(F.collect_set(column)).cast("bigint")


def overview_counts(timeline: DataFrame) -> DataFrame:
    """Numbers of races, vehicles and circuits, counted on their distinct combinations."""
    names = ["race_number", "vehicle_id", "circuit"]
    found = timeline.where(F.col("race_number").isNotNull()).select(*names).distinct()
    return found.agg(
        _kinds("race_number").alias("total_races"),
        _kinds("vehicle_id").alias("total_vehicles"),
        _kinds("circuit").alias("total_circuits"),
    )


def race_summary(timeline: DataFrame, rows: int | None = None) -> DataFrame:
    """Vehicles, laps and mean speed per race, newest race first, from one aggregation."""
    summary = (
        timeline.where(F.col("race_number").isNotNull() & F.col("speed").isNotNull())
        .groupBy("circuit", "race_number")
        .agg(
            _kinds("vehicle_id").alias("vehicle_count"),
            _kinds("lap").alias("total_laps"),
            F.avg("speed").alias("avg_speed"),
        )
    )
    return _top(summary, [*_desc("race_number"), *_asc("circuit")], rows)


def average_speed_by_lap(timeline: DataFrame, circuit: str) -> DataFrame:
    return (
        timeline.where(F.col("circuit") == circuit)
        .groupBy("lap")
        .agg(F.avg("speed").alias("avg_speed"))
        .orderBy(*_asc("lap"))
    )


# Telemetry page


def lap_box_statistics(
    timeline: DataFrame, filters: Filters = None, group_rows: int | None = None
) -> DataFrame:
    """Five-number summary of five metrics per lap."""
    rows = apply_filters(timeline, filters).where(F.col("lap").isNotNull())
    return stats.box_statistics(rows, ["lap"], LAP_METRICS, group_rows).orderBy("lap")


def metric_boxes(boxes: DataFrame, metric: str) -> DataFrame:
    """Laps with a value of the metric and its five numbers as an array."""
    return boxes.where(F.col(f"{metric}_median").isNotNull()).select(
        F.col("lap").alias("lap_number"), stats.five_numbers(metric).alias(metric)
    )


def brake_boxes(boxes: DataFrame) -> DataFrame:
    """Front and rear brake boxes as rows."""
    arrays = boxes.select(
        F.col("lap").alias("lap_number"),
        *[
            F.when(F.col(f"{m}_median").isNotNull(), stats.five_numbers(m)).alias(m)
            for m in ("front_brake", "rear_brake")
        ],
    )
    labels = {"front_brake": "Front Brake", "rear_brake": "Rear Brake"}
    return stats.unpivot(arrays, labels, "metric", "value", ["lap_number"])


# Race page


def vehicle_performance(timeline: DataFrame, circuit: str) -> DataFrame:
    return (
        timeline.where((F.col("circuit") == circuit) & F.col("vehicle_id").isNotNull())
        .groupBy("vehicle_id", "vehicle_number")
        .agg(
            F.countDistinct("lap").alias("total_laps"),
            F.avg("speed").alias("avg_speed"),
            F.avg("nmot").alias("avg_rpm"),
            F.avg("aps").alias("avg_throttle"),
            F.avg("gear").alias("avg_gear"),
        )
        .orderBy(*_desc("avg_speed"))
    )


def performance_table(performance: DataFrame) -> DataFrame:
    """Vehicle performance as the page prints it."""
    digits = {"avg_speed": 2, "avg_rpm": 0, "avg_throttle": 1, "avg_gear": 1}
    return performance.withColumns({c: fixed(F.col(c), n) for c, n in digits.items()})


def speed_histogram(timeline: DataFrame, circuit: str, bins: int = 40) -> DataFrame:
    moving = timeline.where((F.col("circuit") == circuit) & (F.col("speed") > 0))
    return stats.histogram(moving, "speed", bins)


def gear_usage(timeline: DataFrame, circuit: str) -> DataFrame:
    return (
        timeline.where((F.col("circuit") == circuit) & F.col("gear").isNotNull())
        .groupBy("gear")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("gear")
    )


LINE = ("vbox_long_minutes", "vbox_lat_minutes", "speed", "vehicle_id", "lap")


def racing_line(
    timeline: DataFrame, circuit: str, last_lap: int = 5, rows: int | None = None
) -> DataFrame:
    """Position and speed of the first laps, by vehicle, lap and time."""
    points = timeline.where(
        (F.col("circuit") == circuit)
        & F.col("vbox_long_minutes").isNotNull()
        & F.col("vbox_lat_minutes").isNotNull()
        & F.col("speed").isNotNull()
        & (F.col("lap") <= last_lap)
    )
    order = _asc("vehicle_id", "lap", "event_timestamp", "event_source", *LINE[:3])
    return _top(points, order, rows).select(*LINE)


def vehicle_lines(
    timeline: DataFrame, circuit: str, lap: int = 1, rows: int | None = None
) -> DataFrame:
    points = timeline.where(
        (F.col("circuit") == circuit)
        & F.col("vbox_long_minutes").isNotNull()
        & F.col("vbox_lat_minutes").isNotNull()
        & (F.col("lap") == lap)
    )
    order = _asc("vehicle_id", "event_timestamp", "event_source", *LINE[:3])
    return _top(points, order, rows).select(*LINE)


def lap_progression(timeline: DataFrame, circuit: str, rows: int | None = None) -> DataFrame:
    averages = (
        timeline.where(
            (F.col("circuit") == circuit) & F.col("lap").isNotNull() & F.col("speed").isNotNull()
        )
        .groupBy("lap", "vehicle_id")
        .agg(F.avg("speed").alias("avg_speed"))
    )
    return _top(averages, _asc("lap", "vehicle_id"), rows)


# Consistency page


def meter_extent(placed: DataFrame, filters: Filters = None) -> DataFrame:
    return (
        apply_filters(placed, filters)
        .where(F.col("meter_position_m").isNotNull())
        .agg(
            F.min("meter_position_m").alias("min_meter_position"),
            F.max("meter_position_m").alias("max_meter_position"),
        )
    )


def filtered_telemetry(
    placed: DataFrame,
    filters: Filters = None,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """Rows under the filters with the metre in the wanted range, clamped to what exists."""
    rows = apply_filters(placed, filters).where(F.col("meter_position_m").isNotNull())
    if chosen(start) or chosen(end):
        low, high = meter_extent(placed, filters).first()
        if low is None:
            low = high = 0
        rows = rows.where(F.col("meter_position_m").between(*ordered_range(start, end, low, high)))
    return rows.select("vehicle_id", "lap", "sector_number", "meter_position_m",
                       *HISTOGRAM_METRICS, "steering_angle")


def metric_histograms(rows: DataFrame, bins: int = 30) -> DataFrame:
    return stats.histograms(rows, HISTOGRAM_METRICS, bins)


# Lap page


def lap_summary(laps: DataFrame, filters: Filters = None) -> DataFrame:
    """Lap times of timed laps and mean weather of all laps, in one aggregation."""
    seconds = F.col("lap_duration_seconds")
    return apply_filters(laps, filters).agg(
        F.count(seconds).alias("total_laps"),
        F.avg(seconds).alias("avg_lap_duration_seconds"),
        F.min(seconds).alias("fastest_lap_seconds"),
        F.max(seconds).alias("slowest_lap_seconds"),
        F.avg("lap_mean_air_temp_celsius").alias("mean_air_temp_c"),
        F.avg("lap_mean_track_temp_celsius").alias("mean_track_temp_c"),
        F.avg("lap_mean_humidity_percentage").alias("mean_humidity_pct"),
        F.avg("lap_mean_pressure_inches").alias("mean_pressure_in"),
    )


LAP_DETAIL = ("circuit", "race_number", "vehicle_id", "vehicle_number", "lap",
              "lap_duration_seconds", "lap_start_timestamp_utc", "lap_end_timestamp_utc",
              "lap_mean_air_temp_celsius", "lap_mean_track_temp_celsius",
              "lap_mean_humidity_percentage", "lap_mean_pressure_inches")


def lap_detail(laps: DataFrame, filters: Filters = None, rows: int | None = None) -> DataFrame:
    found = apply_filters(laps, filters).where(F.col("lap").isNotNull())
    order = _asc("lap", "circuit", "race_number", "vehicle_id", "vehicle_number", "outing",
                 "lap_start_timestamp_utc", "lap_end_timestamp_utc")
    return _top(found, order, rows).select(*LAP_DETAIL)


def duration_boxes(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the lap duration per lap number, and the outlying laps."""
    return stats.tukey_box(detail, ["lap"], "lap_duration_seconds")


def temperatures(detail: DataFrame) -> DataFrame:
    """Track and air temperature as rows."""
    labels = {
        "lap_mean_track_temp_celsius": "Track Temp (°C)",
        "lap_mean_air_temp_celsius": "Air Temp (°C)",
    }
    return stats.unpivot(detail, labels, "metric", "value", ["lap"])


def temperature_boxes(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stats.tukey_box(temperatures(detail), ["metric"], "value")


def humidity_series(detail: DataFrame) -> DataFrame:
    return detail.select("lap", F.col("lap_mean_humidity_percentage").alias("value")).where(
        F.col("value").isNotNull()
    )


def best_lap_per_driver(laps: DataFrame, filters: Filters = None) -> DataFrame:
    """Fastest timed lap of each vehicle and race, the lowest lap number on a tie."""
    driver = ["vehicle_id", "vehicle_number", "circuit", "race_number"]
    timed = apply_filters(laps, filters).where(F.col("lap_duration_seconds").isNotNull())
    order = F.struct(
        "lap_duration_seconds", F.col("lap").isNull(), "lap", "lap_start_timestamp_utc"
    )
    kept = F.struct("lap", "lap_duration_seconds", "lap_start_timestamp_utc")
    best = timed.dropna(subset=driver).groupBy(*driver).agg(F.min_by(kept, order).alias("_best"))
    return best.select(
        *driver,
        F.col("_best.lap").alias("best_lap"),
        F.col("_best.lap_duration_seconds").alias("best_lap_duration_seconds"),
        F.col("_best.lap_start_timestamp_utc").alias("lap_start_timestamp_utc"),
    ).orderBy(*_asc("best_lap_duration_seconds", *driver))


# Track map page


#: What tells one drive from another, as far as points have it.
DRIVE = ("circuit", "race_number", "vehicle_id", "lap")


def _drive(points: DataFrame) -> Series:
    """One track for each lap of a vehicle in a race; points without these columns are one drive a vehicle."""
    return Series(tuple(c for c in DRIVE if c in points.columns), ("event_timestamp", "event_source"))


def track_points(
    timeline: DataFrame,
    circuit: str,
    lap: int,
    vehicles: Sequence[str] | None = None,
    count: int = 3,
) -> DataFrame:
    """Positions of a lap for the wanted vehicles; if none are named, the first ``count`` of the circuit."""
    if vehicles is None:
        vehicles = first_vehicles(timeline, {"circuit": circuit}, count)
    return timeline.where(
        (F.col("circuit") == circuit)
        & (F.col("lap") == lap)
        & F.col("vehicle_id").isin(*vehicles)
        & F.col("vbox_long_minutes").isNotNull()
        & F.col("vbox_lat_minutes").isNotNull()
    ).select("circuit", "race_number", "vehicle_id", "lap", "vbox_long_minutes", "vbox_lat_minutes", "speed",
             "event_timestamp", "event_source")


def points_per_vehicle(points: DataFrame, vehicles: Sequence[str] | None = None) -> DataFrame:
    """Number of points per vehicle; wanted vehicles without points count zero."""
    counts = points.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("count"))
    if vehicles is None:
        return counts
    wanted = points.sparkSession.createDataFrame([(v,) for v in vehicles], "vehicle_id string").distinct()
    return wanted.join(counts, "vehicle_id", "left").fillna(0, ["count"])


def cumulative_distance(
    points: DataFrame, slots: Sequence[float] = TIME_SLOTS, series: Series | None = None
) -> DataFrame:
    """Distance driven up to each point of each drive: a lap of a vehicle in a race, if no series is given.

    Unit: sixtieths of the coordinate unit, straight lines between points, not metres.
    """
    series = series or _drive(points)
    rows = shift(
        split(points, series, slots),
        series,
        {"_long": "vbox_long_minutes", "_lat": "vbox_lat_minutes"},
    )
    east = (F.col("vbox_long_minutes") - F.col("_long")) * 60
    north = (F.col("vbox_lat_minutes") - F.col("_lat")) * 60
    step = F.coalesce(F.sqrt(north * north + east * east), F.lit(0.0))
    rows = running_sum(rows.withColumn("_step", step), series, {"distance": "_step"})
    return unsplit(rows).drop("_long", "_lat", "_step")


def braking_points(
    points: DataFrame,
    lookback: int = 30,
    threshold: float = 8,
    slots: Sequence[float] = TIME_SLOTS,
    series: Series | None = None,
) -> DataFrame:
    """Points where the speed fell by more than ``threshold`` over the last ``lookback`` points of a drive.

    A drive is a lap of a vehicle in a race, if no series is given. A point without a speed on
    either side shows no drop.
    """
    series = series or _drive(points)
    rows = shift(split(points, series, slots), series, {"initial_speed": "speed"}, lookback)
    drop = F.col("initial_speed") - F.col("speed")
    return (
        unsplit(rows)
        .withColumn("speed_drop", drop)
        .where(F.col("speed_drop") > threshold)
        .select(
            "vehicle_id",
            "event_timestamp",
            "vbox_long_minutes",
            "vbox_lat_minutes",
            "speed_drop",
            "initial_speed",
            F.col("speed").alias("final_speed"),
            (F.col("speed_drop") / lookback).alias("deceleration_rate"),
        )
    )


def braking_bands(braking: DataFrame) -> DataFrame:
    """Range of the speed drops and the number of light, medium and heavy ones."""
    drop = F.col("speed_drop")
    return braking.agg(
        F.min(drop).alias("min_speed_drop"),
        F.max(drop).alias("max_speed_drop"),
        (F.max(drop) - F.min(drop)).alias("speed_drop_range"),
        F.count_if(drop < 20).alias("light"),
        F.count_if((drop >= 20) & (drop < 40)).alias("medium"),
        F.count_if(drop >= 40).alias("heavy"),
    ).withColumn(
        "color_scale", F.when(F.col("speed_drop_range") < 10, "quantile").otherwise("linear")
    )


def vehicle_statistics(points: DataFrame) -> DataFrame:
    """Speed statistics per vehicle; points without a speed count as points only."""
    return points.groupBy("vehicle_id").agg(
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.min("speed").alias("min_speed"),
        F.count(F.lit(1)).alias("data_points"),
    )


# Wind page


def wind_summary(wind: DataFrame, filters: Filters = None) -> DataFrame:
    rows = apply_filters(wind, filters)
    return rows.agg(
        *[
            f(f"wind_speed_{unit}").alias(f"{name}_wind_speed_{unit}")
            for unit in ("mph", "kph")
            for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ]
    )


def wind_rose(wind: DataFrame, filters: Filters = None) -> DataFrame:
    """Number of readings per rose bin and speed band.

    A wind table without a band column gets the bands from its speeds.
    """
    known = "wind_speed_band_mph" in wind.columns
    band = F.col("wind_speed_band_mph") if known else W.speed_band(F.col("wind_speed_mph"))
    return (
        apply_filters(wind, filters)
        .where(F.col("wind_direction_degrees").isNotNull() & F.col("wind_speed_mph").isNotNull())
        .select(
            W.rose_index(F.col("wind_direction_degrees")).alias("direction_index"),
            band.alias("speed_bin"),
        )
        .where(F.col("speed_bin").isNotNull())
        .groupBy("direction_index", "speed_bin")
        .agg(F.count(F.lit(1)).alias("sample_count"))
    )


def wind_rose_stack(rose: DataFrame) -> DataFrame:
    """Rose bins with labels, shares of all readings, and inner and outer edge of each segment.

    The input has at most 16 x 5 rows, so the windows over it are small by construction.
    """
    total = F.sum("sample_count").over(Window.partitionBy(F.lit(1)))
    direction = Window.partitionBy("direction_index")
    stacked = direction.orderBy("band_order")
    labelled = rose.withColumns(
        {
            "direction_label": W.rose_label(F.col("direction_index")),
            "band_order": W.band_order(F.col("speed_bin")),
            "percentage": F.col("sample_count") / total * 100,
        }
    ).where(F.col("direction_label").isNotNull())
    edges = labelled.withColumns(
        {
            "outer_value": F.sum("percentage").over(stacked),
            "direction_percentage": F.sum("percentage").over(direction),
        }
    )
    return edges.withColumns(
        {
            "inner_value": F.col("outer_value") - F.col("percentage"),
            "radial_max": F.max("direction_percentage").over(Window.partitionBy(F.lit(1))) * 1.1,
        }
    ).orderBy("direction_index", "band_order")


def wind_timeline(wind: DataFrame, filters: Filters = None, rows: int | None = None) -> DataFrame:
    """Readings in order of time; the earliest ``rows`` if given."""
    order = _asc("time_utc", "circuit", "race_number", "wind_direction_degrees", "wind_speed_mph")
    return _top(apply_filters(wind, filters), order, rows).select(
        "time_utc", "wind_speed_mph", "wind_speed_kph", "wind_direction_degrees",
        "wind_direction_label",
    )


def wind_vectors(readings: DataFrame) -> DataFrame:
    complete = readings.dropna(subset=["time_utc", "wind_speed_mph", "wind_direction_degrees"])
    return complete.withColumns(
        W.wind_vector(F.col("wind_direction_degrees"), F.col("wind_speed_mph"))
    )


def wind_recent(wind: DataFrame, filters: Filters = None, rows: int | None = None) -> DataFrame:
    """Readings, newest first; the latest ``rows`` if given."""
    found = apply_filters(wind, filters).where(
        F.col("wind_speed_mph").isNotNull() | F.col("wind_direction_degrees").isNotNull()
    )
    order = [
        *_desc("time_utc"),
        *_asc("circuit", "race_number", "wind_direction_degrees", "wind_speed_mph"),
    ]
    return _top(found, order, rows).select(
        "time_utc", "wind_speed_mph", "wind_speed_kph", "wind_direction_degrees",
        "wind_direction_label", "circuit", "race_number",
    )
