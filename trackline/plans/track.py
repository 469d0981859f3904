"""Track sectors and the telemetry placed on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackline.functions.weather import metres

# Sector number, name and length in inches of the modelled circuit.
SECTOR_INCHES = [
    (1, "Sector 1", 40512),
    (2, "Sector 2", 62220),
    (3, "Sector 3", 41940),
]

MAX_BROADCAST_ROWS = 200_000

PLACED = ("circuit", "race_number", "vehicle_id", "vehicle_number", "outing", "lap",
          "event_timestamp", "laptrigger_lapdist_dls", "meter_position_m", "event_source",
          "speed", "gear", "aps", "steering_angle", "front_brake_pressure",
          "rear_brake_pressure", "sector_number", "sector_name", "sector_length_m")


def sector_lengths(
    spark: SparkSession, sectors: Sequence[tuple[int, str, int]] = SECTOR_INCHES
) -> DataFrame:
    lengths = spark.createDataFrame(
        list(sectors), "sector_number int, sector_name string, length_inches int"
    )
    return lengths.select(
        "sector_number", "sector_name", metres(F.col("length_inches")).alias("length_m")
    )


def sector_spine(lengths: DataFrame) -> DataFrame:
    """One row per metre of track with the sector it lies in.

    ``lengths`` holds sector_number, sector_name and length_m; a circuit column, if present, keeps
    tracks apart. Metres run from 0 to the whole metres of the track, and a metre belongs to the
    sector with start <= metre < end.
    """
    circuit = ["circuit"] if "circuit" in lengths.columns else []
    along = Window.partitionBy(*circuit).orderBy("sector_number")
    metre = "decimal(18,4)"
    ends = lengths.select(
        *circuit,
        "sector_number",
        "sector_name",
        (F.sum("length_m").over(along) - F.col("length_m")).cast(metre).alias(
            "sector_start_distance_m"
        ),
        F.sum("length_m").over(along).cast(metre).alias("sector_end_distance_m"),
    )
    first = F.ceil("sector_start_distance_m").cast("bigint")
    after = F.ceil("sector_end_distance_m").cast("bigint")
    return (
        ends.where(after > first)
        .select("*", F.explode(F.sequence(first, after - 1)).alias("meter_position_m"))
        .select(
            *circuit,
            "meter_position_m",
            "sector_number",
            "sector_name",
            "sector_start_distance_m",
            "sector_end_distance_m",
            (F.col("sector_end_distance_m") - F.col("sector_start_distance_m"))
            .cast(metre)
            .alias("sector_length_m"),
        )
    )


def on_track(
    timeline: DataFrame, spine: DataFrame, broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Timeline rows with a lap and a lap distance, and the metre and sector of that distance.

    A spine has one row per metre of track. Up to ``broadcast_rows`` of them, checked by a count,
    it is sent to every task and the timeline is not shuffled; a longer one is joined by shuffle.
    Distances beyond the spine keep their row without a sector.
    """
    rows = timeline.where(
        F.col("lap").isNotNull() & F.col("laptrigger_lapdist_dls").isNotNull()
    ).withColumn("_metre", F.floor("laptrigger_lapdist_dls").cast("bigint"))
    sectors = spine.drop("sector_start_distance_m", "sector_end_distance_m").withColumn(
        "_metre", F.col("meter_position_m").cast("bigint")
    )
    on = ["circuit", "_metre"] if "circuit" in sectors.columns else ["_metre"]
    if spine.limit(broadcast_rows + 1).count() <= broadcast_rows:
        sectors = F.broadcast(sectors)
    return rows.join(sectors, on, "left").select(*PLACED)
