"""Audit of how closely each lap follows its driver's usual behaviour per metre of track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.operators.quantiles import percentiles_by_group
from trackline.operators.series import (
    MAX_CHUNK_ROWS,
    Series,
    largest_group,
    number_rows,
    split,
    unsplit,
)
from trackline.operators.stats import modal_value
from trackline.session import write_shared

LAP_SERIES = Series(
    ("circuit", "race_number", "vehicle_id", "outing", "lap"),
    ("laptrigger_lapdist_dls", "event_timestamp", "event_source"),
)
DISTANCE_SLOTS = (1000.0, 50.0, 1.0)
PLACE = ("circuit", "vehicle_id", "meter_position_m")
DRIVER = ("circuit", "vehicle_id", "vehicle_number")

# Measure, its deviation column per metre, delta column, deviation column of the
# audit. The uneven name in the last row is the one callers know.
MEASURES = [
    ("laptrigger_lapdist_dls", "laptrigger_variability", "laptrigger_delta", None),
    ("speed", "speed_variability", "speed_delta", "speed_stddev"),
    ("gear", "gear_variability", "gear_delta", "gear_stddev"),
    ("aps", "aps_variability", "aps_delta", "aps_stddev"),
    ("steering_angle", "steering_variability", "steering_delta", "steering_stddev"),
    ("front_brake_pressure", "front_brake_variability", "front_brake_delta", "front_brake_stddev"),
    ("rear_brake_pressure", "avg_rear_brake_variability", "rear_brake_delta", "rear_brake_stddev"),
]


def event_order(
    placed: DataFrame,
    slots: Sequence[float] = DISTANCE_SLOTS,
    max_rows: int = MAX_CHUNK_ROWS,
) -> DataFrame:
    """Number the events of a lap along the track and add the number of events in the lap."""
    rows = split(placed, LAP_SERIES, slots, max_rows)
    return unsplit(number_rows(rows, LAP_SERIES, "event_order", "events_per_lap"))


def signature(placed: DataFrame) -> DataFrame:
    """The usual event source of a driver per metre, its share, and in how many laps it occurs."""
    modal = modal_value(
        placed,
        PLACE,
        "event_source",
        [F.countDistinct("lap").alias("laps_with_event")],
        also_by=("vehicle_number",),
    )
    return modal.withColumnsRenamed(
        {
            "event_source": "signature_event_source",
            "share": "signature_event_share",
            "instances": "event_instances",
        }
    )


def metre_metrics(placed: DataFrame) -> DataFrame:
    """Mean and deviation of every measure per driver and metre."""
    aggregates = []
    for measure, deviation, _, _ in MEASURES:
        aggregates += [
            F.avg(measure).alias(f"avg_{measure}"),
            F.stddev_pop(measure).alias(deviation),
        ]
    return placed.groupBy(*PLACE).agg(*aggregates, F.countDistinct("lap").alias("laps_covered"))


def lattice(placed: DataFrame) -> DataFrame:
    """Events counted, and their measures summed, per driver, outing, lap, metre and source; stored.

    Counts and sums can be added up along any of these, so signature, share, means and the
    matches of laps all come from this table, and the events are read for it once.
    """
    sums = [a for m, _, _, _ in MEASURES for a in (F.sum(m).alias(f"_sum_{m}"), F.count(m).alias(f"_count_{m}"))]
    counted = placed.groupBy(*DRIVER, "outing", "lap", "meter_position_m", "event_source").agg(
        F.count(F.lit(1)).alias("_n"), *sums
    )
    return write_shared(counted, "audit-lattice")


def usual_behaviour(counts: DataFrame) -> DataFrame:
    """Signature source, its share, and the mean of every measure per driver and metre."""
    modal = modal_value(counts, PLACE, "event_source", also_by=("vehicle_number",), instances=F.sum("_n"))
    modal = modal.select(
        *PLACE, F.col("event_source").alias("signature_event_source"), F.col("share").alias("signature_event_share")
    )
    means = counts.groupBy(*PLACE).agg(
        *[
            (F.sum(f"_sum_{m}") / F.nullif(F.sum(f"_count_{m}"), F.lit(0))).alias(f"_mean_{m}")
            for m, _, _, _ in MEASURES
        ]
    )
    return modal.join(means, list(PLACE))


def lap_matches(counts: DataFrame, usual: DataFrame) -> DataFrame:
    """Share of the events of each lap that follow their driver's signature."""
    follows = F.col("event_source") == F.col("signature_event_source")
    return (
        counts.join(usual.select(*PLACE, "signature_event_source"), list(PLACE))
        .groupBy(*DRIVER, "outing", "lap")
        .agg((F.sum(F.when(follows, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("alignment_ratio"))
    )


def _flagged(joined: DataFrame) -> DataFrame:
    follows = F.col("event_source") == F.col("signature_event_source")
    return joined.withColumn("event_match_flag", F.when(follows, 1).otherwise(0))


def alignment_rows(
    placed: DataFrame, slots: Sequence[float] = DISTANCE_SLOTS, max_rows: int = MAX_CHUNK_ROWS
) -> DataFrame:
    """The alignment of each event with its order in the lap and the usual distance at the metre."""
    return alignment(event_order(placed, slots, max_rows), ("avg_laptrigger_lapdist_dls", "laptrigger_variability"))


def alignment(placed: DataFrame, kept: Sequence[str] = (), usual: DataFrame | None = None) -> DataFrame:
    """Each event against its driver's signature and means at the metre.

    Signature and means share their key, so they are joined to each other first and the events
    are joined once. ``kept`` names columns of ``metre_metrics`` to carry along, ``usual`` is the
    ``usual_behaviour`` where it is known.
    """
    usual = usual_behaviour(lattice(placed)) if usual is None else usual
    if kept:
        usual = usual.join(metre_metrics(placed).select(*PLACE, *kept), list(PLACE))
    joined = _flagged(placed.join(usual, list(PLACE)))
    return joined.withColumns(
        {d: F.abs(F.col(m) - F.col(f"_mean_{m}")) for m, _, d, _ in MEASURES}
    ).drop(*[f"_mean_{m}" for m, _, _, _ in MEASURES])


def lap_consistency(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("circuit", "vehicle_id", "vehicle_number", "outing", "lap").agg(
        F.count(F.lit(1)).alias("evaluated_events"),
        F.sum("event_match_flag").alias("matched_events"),
        F.avg("event_match_flag").alias("alignment_ratio"),
        *[F.avg(delta).alias(f"avg_{delta}") for _, _, delta, _ in MEASURES],
    )


def driver_consistency(placed: DataFrame) -> DataFrame:
    """Mean, median and decile alignment over the laps of a driver."""
    driver = list(DRIVER)
    outputs = {
        "median_alignment_ratio": ("alignment_ratio", 0.5),
        "p10_alignment_ratio": ("alignment_ratio", 0.1),
        "p90_alignment_ratio": ("alignment_ratio", 0.9),
    }
    extra = [
        F.countDistinct("lap").alias("laps_analyzed"),
        F.avg("alignment_ratio").alias("avg_alignment_ratio"),
        *[F.avg(f"avg_{d}").alias(f"avg_{d}") for _, _, d, _ in MEASURES],
    ]
    counts = lattice(placed)
    laps = lap_consistency(alignment(placed, usual=usual_behaviour(counts)))
    # No driver has more laps than rows of the lattice.
    return percentiles_by_group(laps, driver, outputs, extra, largest_group(counts, driver))


def metre_changes(aligned: DataFrame) -> DataFrame:
    """How much a driver's behaviour varies per metre."""
    keys = [*PLACE, "vehicle_number", "sector_number", "sector_name"]
    deltas = [d for _, _, d, _ in MEASURES if d != "laptrigger_delta"]
    return aligned.groupBy(*keys).agg(
        F.max("sector_length_m").alias("sector_length_m"),
        F.count(F.lit(1)).alias("evaluated_events"),
        # Sets of small numbers, the laps of one driver; two distinct counts would copy every event.
        F.size(F.collect_set("outing")).cast("bigint").alias("outings_covered"),
        F.size(F.collect_set("lap")).cast("bigint").alias("laps_covered"),
        F.avg("event_match_flag").alias("meter_alignment_ratio"),
        (1 - F.avg("event_match_flag")).alias("meter_change_ratio"),
        F.avg("signature_event_share").alias("avg_signature_event_share"),
        *[F.avg(d).alias(f"avg_{d}") for d in deltas],
        *[F.stddev_pop(m).alias(s) for m, _, _, s in MEASURES if s],
    )


def audit(placed: DataFrame, least_laps: int = 3, rows: int | None = None) -> DataFrame:
    """Metres where drivers deviate most from their usual behaviour, greatest change first.

    The driver average is attached by circuit and vehicle without the vehicle number, so a vehicle
    that ran under two numbers shows once per number.
    """
    counts = lattice(placed)
    usual = write_shared(usual_behaviour(counts), "usual-behaviour")
    drivers = (
        lap_matches(counts, usual)
        .groupBy(*DRIVER)
        .agg(
            F.countDistinct("lap").alias("laps_analyzed"),
            F.avg("alignment_ratio").alias("avg_alignment_ratio"),
        )
        .drop("vehicle_number")
    )
    kept = metre_changes(alignment(placed, usual=usual)).where(F.col("laps_covered") >= least_laps)
    joined = kept.join(drivers, ["circuit", "vehicle_id"], "left").orderBy(
        F.col("meter_change_ratio").desc_nulls_last(),
        F.col("meter_position_m").asc_nulls_last(),
        F.col("vehicle_number").asc_nulls_last(),
        F.col("circuit").asc_nulls_last(),
        F.col("vehicle_id").asc_nulls_last(),
        F.col("laps_analyzed").asc_nulls_last(),
    )
    return joined if rows is None else joined.limit(rows)
