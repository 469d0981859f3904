"""Full refresh of all tables from race files, and views under the names queries know."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.plans import laps, telemetry, track, weather
from trackline.session import use_utc
from trackline.sources.catalog import race_files, read_kind
from trackline.sources.schemas import SCHEMAS
from trackline.sources.tables import RACE_PARTITIONS, Versions, publish_view, read_table, write_table

SIGNAL_PARTITIONS = (*RACE_PARTITIONS, "telemetry_name")


def refresh(
    spark: SparkSession,
    root: str,
    out: str,
    circuits: list[str] | None = None,
    races: list[int] | None = None,
) -> None:
    """Write a new version of every table below ``out`` and publish it when all are written.

    Telemetry is parsed once and stored by race and signal, so a signal table is a folder filter
    and no text is parsed twice. The timeline is computed from the stored period tables. Wind facts
    are stored by race second with every reading once, and paired when they are read. Readers
    see the version published before until the last table is done; a refresh that fails publishes
    nothing.
    """
    use_utc(spark)
    versions = Versions(spark, out)
    version = versions.new()

    def source(kind: str) -> DataFrame:
        return read_kind(spark, kind, root, circuits, races)

    def store(df: DataFrame, name: str, by: tuple[str, ...] = RACE_PARTITIONS) -> DataFrame:
        write_table(df, version, name, by)
        return read_table(spark, version, name)

    signals = store(source("telemetry_data"), "telemetry", SIGNAL_PARTITIONS)
    periods = store(telemetry.signal_periods(signals), "signal_periods", SIGNAL_PARTITIONS)
    position = store(telemetry.position_periods(signals), "fact_position")
    acc = store(telemetry.acc_periods(signals), "fact_acc")
    timeline = store(telemetry.timeline(periods, position, acc), "fact_telemetry_data")
    spine = store(track.sector_spine(track.sector_lengths(spark)), "dim_track_sectors", ())
    store(track.on_track(timeline, spine), "viz_driver_consistency")

    starts, ends = source("lap_start"), source("lap_end")
    readings = store(source("weather"), "weather")
    starts = store(laps.lap_starts(starts), "int_laps_start")
    ends = store(laps.lap_ends(ends), "int_laps_end")
    combined = store(laps.combined_laps(starts, ends), "laps_combined")
    store(laps.lap_times(source("lap_time")), "int_laps_time")
    store(laps.best_laps(source("best_laps")), "int_laps_best")
    store(laps.with_weather(combined, readings), "fact_laps")
    store(weather.wind_seconds(readings), "wind_seconds")
    versions.publish(version)


STORED = ("fact_position", "fact_acc", "fact_telemetry_data", "dim_track_sectors",
          "viz_driver_consistency", "int_laps_start", "int_laps_end", "int_laps_time",
          "int_laps_best", "fact_laps")


def tables(spark: SparkSession, out: str) -> dict[str, Callable[[], DataFrame]]:
    """Readers of all finished tables by name; signal, quantity and wind tables are derived views.

    All of them read the version that is published when this is called.
    """
    version = Versions(spark, out).current()

    def stored(name: str) -> Callable[[], DataFrame]:
        return lambda: read_table(spark, version, name)

    found = {"fact_wind": lambda: weather.wind_of_seconds(stored("wind_seconds")())}
    found |= {name: stored(name) for name in STORED}
    for signal, column in telemetry.SIGNAL_TABLES.items():
        found[f"int_telemetry_data_{column}"] = (
            lambda signal=signal: telemetry.signal_table(stored("telemetry")(), signal)
        )
    for signal, (measure, _) in telemetry.SINGLE_SIGNALS.items():
        found[f"fact_{measure}"] = lambda signal=signal: telemetry.period_table(
            stored("signal_periods")(), signal
        )
    for quantity in weather.QUANTITIES:
        found[f"int_weather_{quantity}"] = lambda quantity=quantity: weather.quantity(
            stored("weather")(), quantity
        )
    return found


def publish(spark: SparkSession, out: str) -> list[str]:
    """Register every finished table of the version now published as a temporary view for SQL."""
    use_utc(spark)
    readers = tables(spark, out)
    for name, read in readers.items():
        publish_view(read(), name)
    return sorted(readers)


def publish_raw(
    spark: SparkSession,
    root: str,
    circuits: list[str] | None = None,
    races: list[int] | None = None,
) -> list[str]:
    """Register the race files themselves, one view per circuit, race and kind."""
    use_utc(spark)
    names = []
    for f in race_files(root):
        if circuits is not None and f.circuit not in circuits:
            continue
        if races is not None and f.race_number not in races:
            continue
        df = read_kind(spark, f.kind, root, [f.circuit], [f.race_number])
        race = "" if f.race_number is None else f"race_{f.race_number}_"
        columns = SCHEMAS[f.kind].names if f.kind in SCHEMAS else df.drop("circuit", "race_number").columns
        names.append(f"raw_{f.circuit}_{race}{f.kind}")
        publish_view(df.select(*[F.col(f"`{c}`") for c in columns]), names[-1])
    return names
