"""Signal tables, validity periods and the carried-forward timeline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.operators.runs import collapse_runs
from trackline.operators.series import (
    CHUNK,
    MAX_CHUNK_ROWS,
    TIME_SLOTS,
    Series,
    fill_forward,
    split,
    unsplit,
)
from trackline.operators.signals import VEHICLE, extract, pair_channels

# Signal names in the files and the columns their values become.
SIGNAL_TABLES = {
    "accx_can": "accx_can",
    "accy_can": "accy_can",
    "aps": "aps",
    "gear": "gear",
    "Laptrigger_lapdist_dls": "laptrigger_lapdist_dls",
    "nmot": "nmot",
    "pbrake_f": "pbrake_f",
    "pbrake_r": "pbrake_r",
    "speed": "speed",
    "Steering_Angle": "steering_angle",
    "VBOX_Lat_Min": "vbox_lat_minutes",
    "VBOX_Long_Minutes": "vbox_long_minutes",
}
# Signals with a period table of their own: (measure column, event source on the timeline).
SINGLE_SIGNALS = {
    "Laptrigger_lapdist_dls": ("laptrigger_lapdist_dls", "laptrigger"),
    "aps": ("aps", "aps"),
    "gear": ("gear", "gear"),
    "nmot": ("nmot", "nmot"),
    "speed": ("speed", "speed"),
    "Steering_Angle": ("steering_angle", "steering_angle"),
    "pbrake_f": ("front_brake_pressure", "front_brake_pressure"),
    "pbrake_r": ("rear_brake_pressure", "rear_brake_pressure"),
}
CONTEXT = ("lap", "outing", "meta_event", "meta_session", "meta_source", "meta_time")
ORIGIN = ("original_vehicle_id", "expire_at")

SIGNAL_SERIES = Series((*VEHICLE, "telemetry_name"), ("timestamp", "meta_time", "telemetry_value"))
PAIR_SERIES = Series(VEHICLE, ("timestamp",))
TIMELINE_SERIES = Series(VEHICLE, ("event_timestamp", "event_source", "_event_end"))


def signal_table(telemetry: DataFrame, name: str) -> DataFrame:
    return extract(telemetry, name, SIGNAL_TABLES[name])


def signal_periods(
    telemetry: DataFrame,
    names: Sequence[str] = tuple(SINGLE_SIGNALS),
    slots: Sequence[float] = TIME_SLOTS,
    max_rows: int = MAX_CHUNK_ROWS,
) -> DataFrame:
    """Validity periods of all single signals in long form, from one scan and one shuffle.

    Columns: vehicle key, telemetry_name, value, previous_value, value_change, start and end
    timestamps, context.
    """
    rows = telemetry.where(F.col("telemetry_name").isin(*names)).select(
        *SIGNAL_SERIES.keys,
        "timestamp",
        "telemetry_value",
        "vehicle_number",
        *CONTEXT,
        *ORIGIN,
    )
    periods = collapse_runs(
        split(rows, SIGNAL_SERIES, slots, max_rows),
        SIGNAL_SERIES,
        ["telemetry_value"],
        start="start_timestamp",
        end="end_timestamp",
        previous={"telemetry_value": "previous_value"},
        lowest=("vehicle_number", *CONTEXT, *ORIGIN),
    )
    change = F.col("telemetry_value") - F.coalesce("previous_value", F.lit(0.0))
    return unsplit(periods).select(
        *SIGNAL_SERIES.keys,
        "vehicle_number",
        "start_timestamp",
        "end_timestamp",
        *CONTEXT,
        F.col("telemetry_value").alias("value"),
        "previous_value",
        change.alias("value_change"),
        *ORIGIN,
    )


def period_table(periods: DataFrame, name: str) -> DataFrame:
    """Period table of one signal under its own column names."""
    measure, _ = SINGLE_SIGNALS[name]
    return (
        periods.where(F.col("telemetry_name") == name)
        .drop("telemetry_name")
        .withColumnsRenamed(
            {
                "start_timestamp": f"{measure}_start_timestamp",
                "end_timestamp": f"{measure}_end_timestamp",
                "value": measure,
                "previous_value": f"previous_{measure}",
                "value_change": f"{measure}_change",
            }
        )
    )


POSITION_FILL = ("vbox_long_minutes", "vbox_lat_minutes", "lap", "outing", "meta_event",
                 "meta_session")
ACC_FILL = ("accx_can", "accy_can", *CONTEXT, *ORIGIN)


def position_pairs(telemetry: DataFrame) -> DataFrame:
    plain = ("vehicle_number", "lap", "outing", "meta_event", "meta_session")
    return pair_channels(
        telemetry,
        (
            "VBOX_Long_Minutes",
            "vbox_long_minutes",
            {**{c: c for c in plain}, "long_meta_time": "meta_time"},
        ),
        ("VBOX_Lat_Min", "vbox_lat_minutes", {"lat_meta_time": "meta_time"}),
    )


def acc_pairs(telemetry: DataFrame) -> DataFrame:
    plain = ("vehicle_number", *CONTEXT, *ORIGIN)
    return pair_channels(
        telemetry, ("accx_can", "accx_can", {c: c for c in plain}), ("accy_can", "accy_can", {})
    )


def position_filled(telemetry: DataFrame, slots: Sequence[float] = TIME_SLOTS,
                    max_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """Paired coordinates with values and context carried forward; still split."""
    channels = telemetry.where(F.col("telemetry_name").isin("VBOX_Long_Minutes", "VBOX_Lat_Min"))
    pairs = split(position_pairs(telemetry), PAIR_SERIES, slots, max_rows, channels)
    return fill_forward(pairs, PAIR_SERIES, POSITION_FILL)


def acc_filled(telemetry: DataFrame, slots: Sequence[float] = TIME_SLOTS,
               max_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    channels = telemetry.where(F.col("telemetry_name").isin("accx_can", "accy_can"))
    pairs = split(acc_pairs(telemetry), PAIR_SERIES, slots, max_rows, channels)
    return fill_forward(pairs, PAIR_SERIES, ACC_FILL)


def position_periods(telemetry: DataFrame, slots: Sequence[float] = TIME_SLOTS,
                     max_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    values = ("vbox_long_minutes", "vbox_lat_minutes")
    context = ("vehicle_number", "lap", "outing", "meta_event", "meta_session",
               "long_meta_time", "lat_meta_time")
    periods = collapse_runs(
        position_filled(telemetry, slots, max_rows),
        PAIR_SERIES,
        values,
        start="position_start_timestamp",
        end="position_end_timestamp",
        previous={},
        highest=context,
        null_safe=True,
    )
    return unsplit(periods)


def acc_periods(telemetry: DataFrame, slots: Sequence[float] = TIME_SLOTS,
                max_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    periods = collapse_runs(
        acc_filled(telemetry, slots, max_rows),
        PAIR_SERIES,
        ("accx_can", "accy_can"),
        start="acc_start_timestamp",
        end="acc_end_timestamp",
        previous={"accx_can": "previous_accx_can", "accy_can": "previous_accy_can"},
        lowest=("vehicle_number", *CONTEXT, *ORIGIN),
        null_safe=True,
    )
    zero = F.lit(0.0)
    return unsplit(periods).withColumns(
        {
            "accx_change": F.col("accx_can") - F.coalesce("previous_accx_can", zero),
            "accy_change": F.col("accy_can") - F.coalesce("previous_accy_can", zero),
        }
    )


EVENT_COLUMNS = (*VEHICLE, "vehicle_number", "event_timestamp", "event_source", "_event_end",
                 "lap", "outing", "meta_event", "meta_session")
POSITION_COLUMNS = ("position_start_timestamp", "position_end_timestamp", "vbox_long_minutes",
                    "vbox_lat_minutes", "long_meta_time", "lat_meta_time")
ACC_COLUMNS = ("acc_start_timestamp", "acc_end_timestamp", "accx_can", "accy_can")


def _measure_columns(measure: str) -> tuple[str, str, str]:
    return f"{measure}_start_timestamp", f"{measure}_end_timestamp", measure


CARRIED = (
    *POSITION_COLUMNS,
    *[c for m, _ in SINGLE_SIGNALS.values() for c in _measure_columns(m)],
    *ACC_COLUMNS,
)


def timeline_events(periods: DataFrame, position: DataFrame, acc: DataFrame) -> DataFrame:
    """One row per period start of any metric; only the columns of that metric are filled."""
    name = F.col("telemetry_name")
    spread = {}
    source = F.lit(None).cast("string")
    for signal, (measure, label) in SINGLE_SIGNALS.items():
        start, end, value = _measure_columns(measure)
        spread[start] = F.when(name == signal, F.col("start_timestamp"))
        spread[end] = F.when(name == signal, F.col("end_timestamp"))
        spread[value] = F.when(name == signal, F.col("value"))
        source = F.when(name == signal, label).otherwise(source)
    singles = periods.withColumns(
        {
            "event_timestamp": F.col("start_timestamp"),
            "_event_end": F.col("end_timestamp"),
            "event_source": source,
            **spread,
        }
    ).select(*EVENT_COLUMNS, *spread)

    def paired(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
        return df.withColumns(
            {
                "event_timestamp": F.col(f"{label}_start_timestamp"),
                "_event_end": F.col(f"{label}_end_timestamp"),
                "event_source": F.lit(label),
            }
        ).select(*EVENT_COLUMNS, *columns)

    parts = [
        singles,
        paired(position, "position", POSITION_COLUMNS),
        paired(acc, "acc", ACC_COLUMNS),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def timeline(
    periods: DataFrame,
    position: DataFrame,
    acc: DataFrame,
    slots: Sequence[float] = TIME_SLOTS,
    max_rows: int = MAX_CHUNK_ROWS,
) -> DataFrame:
    """Every change of any metric with the last known value of all others.

    Each column is carried by itself, so an open period end is filled from the period before it.
    Changes at one time follow the name of their source.
    """
    events = split(timeline_events(periods, position, acc), TIMELINE_SERIES, slots, max_rows)
    filled = fill_forward(events, TIMELINE_SERIES, CARRIED)
    return unsplit(filled).select(*[c for c in EVENT_COLUMNS if c != "_event_end"], *CARRIED)
