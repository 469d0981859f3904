"""Every registered query: its Spark form, its DuckDB form, and the columns compared rounded."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import adapter
from registry import oracle as O
from registry.marts import WHOLE_TRACK, Marts, open_marts
from trackline.functions import weather as W
from trackline.operators import stats
from trackline.operators.series import unsplit
from trackline.operators.signals import VEHICLE
from trackline.plans import build, consistency, laps, pages, telemetry, track, weather
from trackline.sources.catalog import race_files, read_kind, select_files, unread_values
from trackline.sources.schemas import HEADERS, SCHEMAS
from trackline.sources.tables import write_json
from trackline.session import remove_at_end, shared_dir


@dataclass(frozen=True)
class Query:
    run: Callable[[Marts], DataFrame]
    sql: str | None = None
    rounded: dict[str, int] = field(default_factory=dict)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(self.run(open_marts(spark, sf_dir)), self.rounded)

    def oracle(self) -> str:
        sql = self.sql
        if self.rounded:
            replaced = ", ".join(f"round({c} + 1e-{n + 3}, {n}) + 0.0 AS {c}" for c, n in self.rounded.items())
            sql = f"SELECT * REPLACE ({replaced}) FROM ({sql})"
        return O.expand(sql)


def comparable(df: DataFrame, rounded: dict[str, int]) -> DataFrame:
    """Types both engines print alike; ``rounded`` maps columns to their digits."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            parts = {"day": 86_400, "hour": 3_600, "minute": 60}
            whole = " + ".join(
                f"bigint(extract({u} from `{f.name}`)) * {n * 1_000_000}L" for u, n in parts.items()
            )
            c = F.expr(f"{whole} + bigint(extract(second from `{f.name}`) * 1000000)")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        if f.name in rounded:
            c = stable_round(c, rounded[f.name]) + F.lit(0.0)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def stable_round(value: Column, digits: int) -> Column:
    """A value for comparison: a thousandth of the last digit keeps sums in another order off a border."""
    return F.round(value + F.lit(10.0 ** -(digits + 3)), digits)


QUERIES: dict[str, Query] = {}


def add(name: str, run: Callable[[Marts], DataFrame], sql: str | None = None,
        rounded: str | list[str] = (), digits: int = 6) -> None:
    names = rounded.split() if isinstance(rounded, str) else list(rounded)
    QUERIES[name] = Query(run, sql, {c: digits for c in names})


# Signals and periods

add(
    "signal_extract",
    lambda m: telemetry.signal_table(m.telemetry(), "speed"),
    f"SELECT {O.ROW_COLUMNS}, telemetry_value AS speed, timestamp FROM tel"
    " WHERE telemetry_name = 'speed'",
)
add(
    "signal_tables",
    lambda m: reduce(
        lambda a, b: a.unionByName(b),
        [
            telemetry.signal_table(m.telemetry(), name).select(
                *VEHICLE, F.lit(column).alias("signal"), "timestamp", F.col(column).alias("value")
            )
            for name, column in telemetry.SIGNAL_TABLES.items()
        ],
    ),
    f"SELECT {O.VK}, lower(CASE telemetry_name WHEN 'VBOX_Lat_Min' THEN 'vbox_lat_minutes' "
    "ELSE telemetry_name END) AS signal, timestamp, telemetry_value AS value FROM tel",
)
add(
    "value_periods",
    lambda m: telemetry.period_table(
        telemetry.signal_periods(m.telemetry(), ["speed"]), "speed"
    ),
    f"SELECT {O.VK}, vehicle_number, start_timestamp AS speed_start_timestamp,"
    f" end_timestamp AS speed_end_timestamp, {O.cols(O.CONTEXT)}, value AS speed,"
    f" previous_value AS previous_speed, value_change AS speed_change, {O.cols(O.ORIGIN)}"
    " FROM periods WHERE telemetry_name = 'speed'",
    "speed_change",
)
add(
    "value_periods_all_signals",
    lambda m: telemetry.signal_periods(m.telemetry()),
    "SELECT * FROM periods",
    "value_change",
)
add("paired_signal_join", lambda m: telemetry.acc_pairs(m.telemetry()), "SELECT * FROM acc_pairs")
add(
    "forward_fill",
    lambda m: unsplit(telemetry.position_filled(m.telemetry())),
    "SELECT * FROM position_filled",
)
add(
    "position_periods",
    lambda m: telemetry.position_periods(m.telemetry()),
    "SELECT * FROM position_periods",
)
add(
    "acc_periods",
    lambda m: telemetry.acc_periods(m.telemetry()),
    "SELECT * FROM acc_periods",
    "accx_change accy_change",
)
add(
    "timeline_union",
    lambda m: telemetry.timeline_events(m.periods, m.position, m.acc).drop("_event_end"),
    "SELECT * FROM events_union",
)
add(
    "timeline_carry_forward",
    lambda m: telemetry.timeline(m.periods, m.position, m.acc),
    "SELECT * FROM timeline",
)

# Laps

LAP_STAGES = {
    "lap_dedup_start": (lambda m: laps.lap_starts(m.lap_events("lap_start")), "starts"),
    "lap_dedup_end": (lambda m: laps.lap_ends(m.lap_events("lap_end")), "ends"),
}
for _name, (_run, _cte) in LAP_STAGES.items():
    add(_name, _run, f"SELECT * FROM {_cte}")
add(
    "lap_time_events",
    lambda m: laps.lap_times(m.lap_events("lap_time")),
    f"SELECT {O.ROW_COLUMNS}, ts AS lap_time_timestamp FROM base WHERE event_type = 'click'",
)


def _combined(m: Marts) -> DataFrame:
    return laps.combined_laps(
        laps.lap_starts(m.lap_events("lap_start")), laps.lap_ends(m.lap_events("lap_end"))
    )


add("lap_full_outer_impute", _combined, "SELECT * FROM combined")
add(
    "lap_weather_interval",
    lambda m: laps.lap_weather(m.combined_laps, m.weather()),
    "SELECT * FROM lap_readings",
    O.WEATHER,
)
add(
    "lap_facts",
    lambda m: laps.with_weather(m.combined_laps, m.weather()),
    "SELECT * FROM lap_facts",
)

# Weather and wind

add(
    "weather_units",
    lambda m: weather.converted(m.weather()),
    "SELECT * FROM weather",
    "air_temp_celsius track_temp_celsius pressure_mbars wind_speed_kph",
)
add(
    "weather_quantities",
    lambda m: reduce(
        lambda a, b: a.unionByName(b),
        [
            weather.quantity(m.weather(), name).select(
                "circuit", "race_number", "time_utc", "time_utc_seconds",
                F.lit(name).alias("quantity"), F.col(columns[0]).alias("value"),
                F.col(columns[-1]).alias("converted"),
            )
            for name, columns in weather.QUANTITIES.items()
        ],
    ),
    " UNION ALL ".join(
        f"SELECT circuit, race_number, time_utc, time_utc_seconds, '{n}' AS quantity,"
        f" {c[0]} AS value, {c[-1]} AS converted FROM weather WHERE {c[0]} IS NOT NULL"
        for n, c in weather.QUANTITIES.items()
    ),
    "converted",
)
add("wind_facts", lambda m: weather.wind_facts(m.weather()), "SELECT * FROM wind",
    "wind_speed_kph")
add(
    "wind_compass_label",
    lambda m: m.weather().groupBy(
        W.compass_label(W.normal_degrees(F.col("wind_direction"))).alias("wind_direction_label")
    ).agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("wind_direction").alias("least"),
        F.max("wind_direction").alias("greatest"),
    ),
    f"SELECT {O.LABEL} AS wind_direction_label, count(*) AS readings,"
    " min(wind_direction_degrees) AS least, max(wind_direction_degrees) AS greatest"
    " FROM weather GROUP BY 1",
)
add(
    "wind_speed_band",
    lambda m: m.weather().groupBy(
        W.speed_band(F.col("wind_speed")).alias("wind_speed_band_mph")
    ).agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("wind_speed").alias("least"),
        F.max("wind_speed").alias("greatest"),
    ),
    f"SELECT {O.BAND} AS wind_speed_band_mph, count(*) AS readings, min(wind_speed_mph) AS least,"
    " max(wind_speed_mph) AS greatest FROM weather GROUP BY 1",
)
WIND_STATS = [f"{s}_wind_speed_{u}" for u in ("mph", "kph") for s in ("avg", "min", "max")]
add(
    "wind_summary",
    lambda m: pages.wind_summary(m.wind),
    "SELECT " + ", ".join(
        f"{s}(wind_speed_{u}) AS {s}_wind_speed_{u}"
        for u in ("mph", "kph") for s in ("avg", "min", "max")
    ) + " FROM wind",
    WIND_STATS,
)
add("wind_rose", lambda m: pages.wind_rose(m.wind), "SELECT * FROM rose")
add(
    "wind_rose_stack",
    lambda m: pages.wind_rose_stack(pages.wind_rose(m.wind)),
    """SELECT *, outer_value - percentage AS inner_value,
 max(direction_percentage) OVER () * 1.1 AS radial_max
 FROM (SELECT *, sum(percentage) OVER (PARTITION BY direction_index ORDER BY band_order) AS outer_value,
  sum(percentage) OVER (PARTITION BY direction_index) AS direction_percentage
  FROM (SELECT direction_index, speed_bin, sample_count,
   ['North', 'North-Northeast', 'Northeast', 'East-Northeast', 'East', 'East-Southeast',
    'Southeast', 'South-Southeast', 'South', 'South-Southwest', 'Southwest', 'West-Southwest',
    'West', 'West-Northwest', 'Northwest', 'North-Northwest'][CAST(direction_index + 1 AS INT)]
    AS direction_label,
   CASE speed_bin WHEN '00-05 mph' THEN 0 WHEN '05-10 mph' THEN 1 WHEN '10-15 mph' THEN 2
    WHEN '15-20 mph' THEN 3 ELSE 4 END AS band_order,
   sample_count / sum(sample_count) OVER () * 100 AS percentage FROM rose))""",
    "percentage outer_value inner_value direction_percentage radial_max",
)
WIND_ORDER = "circuit, race_number, wind_direction_degrees, wind_speed_mph"
add(
    "wind_timeline_vectors",
    lambda m: pages.wind_vectors(pages.wind_timeline(m.wind)),
    f"""SELECT *, (wind_direction_degrees + 180) % 360 AS flow_direction_degrees,
 90 - (wind_direction_degrees + 180) % 360 AS arrow_rotation,
 sin(radians((wind_direction_degrees + 180) % 360)) * wind_speed_mph AS u_component_mph,
 cos(radians((wind_direction_degrees + 180) % 360)) * wind_speed_mph AS v_component_mph
 FROM (SELECT time_utc, wind_speed_mph, wind_speed_kph, wind_direction_degrees, wind_direction_label
  FROM wind)
 WHERE time_utc IS NOT NULL AND wind_speed_mph IS NOT NULL AND wind_direction_degrees IS NOT NULL""",
    "wind_speed_kph u_component_mph v_component_mph",
)
RECENT_SQL = (
    "SELECT time_utc, wind_speed_mph, wind_speed_kph, wind_direction_degrees, wind_direction_label,"
    " circuit, race_number FROM wind"
)
add("wind_recent", lambda m: pages.wind_recent(m.wind), RECENT_SQL, "wind_speed_kph")
add(
    "wind_recent_top",
    lambda m: pages.wind_recent(m.wind, rows=500),
    f"{RECENT_SQL} ORDER BY time_utc DESC, {WIND_ORDER} LIMIT 500",
    "wind_speed_kph",
)
add(
    "wind_rose_without_bands",
    lambda m: pages.wind_rose(m.wind.drop("wind_speed_band_mph")),
    "SELECT * FROM rose",
)

# Track and audit


def _spine_use(m: Marts) -> DataFrame:
    readings = (
        telemetry.signal_table(m.telemetry(), "Laptrigger_lapdist_dls")
        .groupBy(F.floor("laptrigger_lapdist_dls").cast("bigint").alias("meter_position_m"))
        .agg(F.count(F.lit(1)).alias("readings"))
    )
    return m.spine.join(readings, "meter_position_m", "left")


add(
    "sector_spine",
    _spine_use,
    """SELECT s.* REPLACE (CAST(sector_start_distance_m AS DOUBLE) AS sector_start_distance_m,
  CAST(sector_end_distance_m AS DOUBLE) AS sector_end_distance_m,
  CAST(sector_length_m AS DOUBLE) AS sector_length_m), readings
 FROM spine s LEFT JOIN (SELECT CAST(floor(telemetry_value) AS BIGINT) AS meter_position_m,
  count(*) AS readings FROM tel WHERE telemetry_name = 'Laptrigger_lapdist_dls' GROUP BY 1) r
 USING (meter_position_m)""",
    "sector_start_distance_m sector_end_distance_m sector_length_m",
    4,
)
add("sector_lookup", lambda m: track.on_track(m.timeline, m.spine), "SELECT * FROM placed",
    "sector_length_m", 4)
add(
    "event_order_in_lap",
    lambda m: consistency.event_order(m.audit_placed),
    f"""SELECT *, row_number() OVER (PARTITION BY {O.VK}, outing, lap
  ORDER BY laptrigger_lapdist_dls, event_timestamp, event_source) AS event_order,
 count(*) OVER (PARTITION BY {O.VK}, outing, lap) AS events_per_lap FROM placed_audit""",
)
add("modal_signature", lambda m: consistency.signature(m.audit_placed), "SELECT * FROM signature",
    "signature_event_share")
METRICS = [f"avg_{x}" for x in O.AUDIT] + list(O.DEVIATION.values())
add("meter_metrics", lambda m: consistency.metre_metrics(m.audit_placed), "SELECT * FROM metrics",
    METRICS)
DELTAS = [f"{s}_delta" for s in O.SHORT.values()]
add("lap_alignment", lambda m: consistency.alignment(m.audit_placed), "SELECT * FROM aligned",
    ["signature_event_share", *DELTAS])
add(
    "lap_alignment_rows",
    lambda m: consistency.alignment_rows(m.audit_placed),
    f"""SELECT a.*, row_number() OVER (PARTITION BY a.{O.VK.replace(", ", ", a.")}, a.outing, a.lap
  ORDER BY a.laptrigger_lapdist_dls, a.event_timestamp, a.event_source) AS event_order,
 count(*) OVER (PARTITION BY a.{O.VK.replace(", ", ", a.")}, a.outing, a.lap) AS events_per_lap,
 k.avg_laptrigger_lapdist_dls, k.laptrigger_variability
 FROM aligned a JOIN metrics k USING (circuit, vehicle_id, meter_position_m)""",
    ["signature_event_share", "avg_laptrigger_lapdist_dls", "laptrigger_variability", *DELTAS],
)
add(
    "lap_consistency",
    lambda m: consistency.lap_consistency(consistency.alignment(m.audit_placed)),
    "SELECT * FROM by_lap",
    ["alignment_ratio", *[f"avg_{d}" for d in DELTAS]],
)
RATIOS = "avg_alignment_ratio median_alignment_ratio p10_alignment_ratio p90_alignment_ratio"
add("driver_consistency", lambda m: consistency.driver_consistency(m.audit_placed),
    "SELECT * FROM by_driver", RATIOS.split() + [f"avg_{d}" for d in DELTAS])
METRE_VALUES = ["meter_alignment_ratio", "meter_change_ratio", "avg_signature_event_share",
                *[f"avg_{d}" for d in DELTAS[1:]],
                *[f"{O.SHORT[x]}_stddev" for x in O.OTHERS]]
add("meter_changes",
    lambda m: consistency.metre_changes(consistency.alignment(m.audit_placed)),
    "SELECT * FROM by_metre", METRE_VALUES)
AUDIT_SQL = """SELECT a.*, d.laps_analyzed, d.avg_alignment_ratio FROM by_metre a
 LEFT JOIN by_driver d ON a.circuit = d.circuit AND a.vehicle_id = d.vehicle_id
 WHERE a.laps_covered >= 3"""
add(
    "consistency_audit",
    lambda m: consistency.audit(m.audit_placed),
    AUDIT_SQL,
    [*METRE_VALUES, "avg_alignment_ratio"],
)
add(
    "consistency_audit_top",
    lambda m: consistency.audit(m.audit_placed, rows=200),
    f"""{AUDIT_SQL} ORDER BY meter_change_ratio DESC, meter_position_m, a.vehicle_number, a.circuit,
 a.vehicle_id, laps_analyzed LIMIT 200""",
    [*METRE_VALUES, "avg_alignment_ratio"],
)

# Overview and telemetry pages

add(
    "overview_counts",
    lambda m: pages.overview_counts(m.timeline),
    "SELECT count(DISTINCT race_number) AS total_races, count(DISTINCT vehicle_id) AS"
    " total_vehicles, count(DISTINCT circuit) AS total_circuits FROM timeline"
    " WHERE race_number IS NOT NULL",
)
RACE_SQL = (
    "SELECT circuit, race_number, count(DISTINCT vehicle_id) AS vehicle_count,"
    " count(DISTINCT lap) AS total_laps, avg(speed) AS avg_speed FROM timeline"
    " WHERE speed IS NOT NULL GROUP BY circuit, race_number"
)
add("race_summary", lambda m: pages.race_summary(m.timeline), RACE_SQL, "avg_speed")
add(
    "race_summary_top",
    lambda m: pages.race_summary(m.timeline, 10),
    f"{RACE_SQL} ORDER BY race_number DESC, circuit LIMIT 10",
    "avg_speed",
)
add(
    "average_speed_by_lap",
    lambda m: pages.average_speed_by_lap(m.timeline, "north"),
    "SELECT lap, avg(speed) AS avg_speed FROM timeline WHERE circuit = 'north' GROUP BY lap",
    "avg_speed",
)

PICK_LISTS = [
    ("timeline", "circuit", {}),
    ("timeline", "vehicle_id", {"circuit": "north"}),
    ("timeline", "lap", {"circuit": "north", "vehicle_id": "V002"}),
    ("placed", "vehicle_id", {}),
    ("placed", "sector_number", {}),
    ("placed", "lap", {"vehicle_id": "V007", "sector_number": 2}),
    ("laps", "circuit", {}),
    ("laps", "race_number", {"circuit": "south"}),
    ("laps", "vehicle_id", {"circuit": "south", "race_number": 2}),
    ("wind", "circuit", {}),
    ("wind", "race_number", {"circuit": "All"}),
]


def _filter_options(m: Marts) -> DataFrame:
    parts = [
        pages.options(getattr(m, table), column, filters).select(
            F.lit(f"{i} {table} {column}").alias("list"),
            F.col(column).cast("string").alias("option"),
        )
        for i, (table, column, filters) in enumerate(PICK_LISTS)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _filter_sql() -> str:
    parts = []
    for i, (table, column, filters) in enumerate(PICK_LISTS):
        where = "".join(
            f" AND {k} = {v!r}" for k, v in filters.items() if v != "All"
        )
        source = "lap_facts" if table == "laps" else table
        parts.append(
            f"SELECT DISTINCT '{i} {table} {column}' AS list, CAST({column} AS VARCHAR) AS option"
            f" FROM {source} WHERE {column} IS NOT NULL{where}"
        )
    return " UNION ALL ".join(parts)


add("filter_options", _filter_options, _filter_sql())
BOX = [f"{p}_{s}" for p in pages.LAP_METRICS for s in ("q1", "median", "q3")]
add("lap_box_stats", lambda m: pages.lap_box_statistics(m.timeline), "SELECT * FROM boxes", BOX)


def _five(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The five-number array as columns, which both engines print alike."""
    names = ("low", "q1", "mid", "q3", "high")
    return df.select(*keep, *[F.get(column, i).alias(n) for i, n in enumerate(names)])


add(
    "metric_unpivot",
    lambda m: _five(
        pages.brake_boxes(pages.lap_box_statistics(m.timeline)), "value", "lap_number", "metric"
    ),
    " UNION ALL ".join(
        f"SELECT lap AS lap_number, '{label}' AS metric, {p}_min AS low, {p}_q1 AS q1,"
        f" {p}_median AS mid, {p}_q3 AS q3, {p}_max AS high FROM boxes"
        f" WHERE {p}_median IS NOT NULL"
        for p, label in (("front_brake", "Front Brake"), ("rear_brake", "Rear Brake"))
    ),
    "q1 mid q3",
)
add(
    "metric_boxes",
    lambda m: _five(
        pages.metric_boxes(pages.lap_box_statistics(m.timeline, {"circuit": "south"}), "nmot"),
        "nmot",
        "lap_number",
    ),
    "SELECT lap AS lap_number, min(nmot) AS low, quantile_cont(nmot, 0.25) AS q1,"
    " quantile_cont(nmot, 0.5) AS mid, quantile_cont(nmot, 0.75) AS q3, max(nmot) AS high"
    " FROM timeline WHERE circuit = 'south' AND lap IS NOT NULL GROUP BY lap"
    " HAVING count(nmot) > 0",
    "q1 mid q3",
)

# Race page

add(
    "vehicle_performance",
    lambda m: pages.vehicle_performance(m.timeline, "north"),
    "SELECT vehicle_id, vehicle_number, count(DISTINCT lap) AS total_laps, avg(speed) AS avg_speed,"
    " avg(nmot) AS avg_rpm, avg(aps) AS avg_throttle, avg(gear) AS avg_gear FROM timeline"
    " WHERE circuit = 'north' AND vehicle_id IS NOT NULL GROUP BY vehicle_id, vehicle_number",
    "avg_speed avg_rpm avg_throttle avg_gear",
)
add(
    "vehicle_performance_table",
    lambda m: pages.performance_table(pages.vehicle_performance(m.timeline, "south")),
    "SELECT vehicle_id, vehicle_number, count(DISTINCT lap) AS total_laps, "
    + ", ".join(
        f"printf('%.{n}f', round(avg({c}), {n})) AS {out}"
        for c, out, n in (("speed", "avg_speed", 2), ("nmot", "avg_rpm", 0),
                          ("aps", "avg_throttle", 1), ("gear", "avg_gear", 1))
    )
    + " FROM timeline WHERE circuit = 'south' AND vehicle_id IS NOT NULL"
    " GROUP BY vehicle_id, vehicle_number",
)
add("speed_histogram", lambda m: pages.speed_histogram(m.timeline, "north"),
    O.bins_sql("timeline", "speed", 40, "circuit = 'north' AND speed > 0"), "lower upper")
add("gear_usage", lambda m: pages.gear_usage(m.timeline, "north"),
    "SELECT gear, count(*) AS count FROM timeline WHERE circuit = 'north' AND gear IS NOT NULL"
    " GROUP BY gear")
LINE_ORDER = "event_source, vbox_long_minutes, vbox_lat_minutes, speed"
add(
    "racing_line_top",
    lambda m: pages.racing_line(m.timeline, "north", rows=10_000),
    f"SELECT {O.cols(pages.LINE)} FROM timeline WHERE circuit = 'north' AND {O.COORDS}"
    " AND speed IS NOT NULL AND lap <= 5"
    f" ORDER BY vehicle_id, lap, event_timestamp, {LINE_ORDER} LIMIT 10000",
)
add(
    "racing_line",
    lambda m: pages.racing_line(m.timeline, "north"),
    f"SELECT {O.cols(pages.LINE)} FROM timeline WHERE circuit = 'north' AND {O.COORDS}"
    " AND speed IS NOT NULL AND lap <= 5",
)
add(
    "vehicle_lines",
    lambda m: pages.vehicle_lines(m.timeline, "north"),
    f"SELECT {O.cols(pages.LINE)} FROM timeline WHERE circuit = 'north' AND {O.COORDS} AND lap = 1",
)
add(
    "lap_progression",
    lambda m: pages.lap_progression(m.timeline, "south"),
    "SELECT lap, vehicle_id, avg(speed) AS avg_speed FROM timeline WHERE circuit = 'south'"
    " AND lap IS NOT NULL AND speed IS NOT NULL GROUP BY lap, vehicle_id",
    "avg_speed",
)

# Consistency page

add(
    "meter_extent",
    lambda m: pages.meter_extent(m.placed, {"sector_number": 2, "vehicle_id": "All"}),
    "SELECT min(meter_position_m) AS min_meter_position, max(meter_position_m) AS"
    " max_meter_position FROM placed WHERE sector_number = 2",
)
add(
    "filtered_telemetry",
    lambda m: pages.filtered_telemetry(m.placed, {"vehicle_id": "V003"}, 3200, 400),
    "SELECT vehicle_id, lap, sector_number, meter_position_m, speed, aps, front_brake_pressure,"
    " rear_brake_pressure, steering_angle FROM placed"
    " WHERE vehicle_id = 'V003' AND meter_position_m BETWEEN 400 AND 3200",
)
add(
    "filtered_histograms",
    lambda m: pages.metric_histograms(pages.filtered_telemetry(m.placed, {"sector_number": 1})),
    " UNION ALL ".join(
        O.bins_sql("placed", c, 30, "sector_number = 1 AND meter_position_m IS NOT NULL", c)
        for c in pages.HISTOGRAM_METRICS
    ),
    "lower upper",
)

# Lap page

SUMMARY = {
    "mean_air_temp_c": "lap_mean_air_temp_celsius",
    "mean_track_temp_c": "lap_mean_track_temp_celsius",
    "mean_humidity_pct": "lap_mean_humidity_percentage",
    "mean_pressure_in": "lap_mean_pressure_inches",
}
add(
    "lap_summary",
    lambda m: pages.lap_summary(m.laps),
    "SELECT count(lap_duration_seconds) AS total_laps,"
    " avg(lap_duration_seconds) AS avg_lap_duration_seconds,"
    " min(lap_duration_seconds) AS fastest_lap_seconds,"
    " max(lap_duration_seconds) AS slowest_lap_seconds, "
    + ", ".join(f"avg({c}) AS {n}" for n, c in SUMMARY.items())
    + " FROM lap_facts",
    ["avg_lap_duration_seconds", *SUMMARY],
)
DETAIL_SQL = f"SELECT {O.cols(pages.LAP_DETAIL)} FROM lap_facts WHERE lap IS NOT NULL"
add("lap_detail", lambda m: pages.lap_detail(m.laps), DETAIL_SQL)
TEMPERATURE_SQL = " UNION ALL ".join(
    f"SELECT lap, '{label}' AS metric, {c} AS value FROM lap_facts WHERE {c} IS NOT NULL"
    for label, c in (("Track Temp (°C)", "lap_mean_track_temp_celsius"),
                     ("Air Temp (°C)", "lap_mean_air_temp_celsius"))
)
add("temperature_unpivot", lambda m: pages.temperatures(m.laps), TEMPERATURE_SQL)
add("temperature_boxes", lambda m: pages.temperature_boxes(m.laps)[0],
    O.box_sql(f"({TEMPERATURE_SQL})", "metric", "value"),
    "q1 median q3")
add(
    "temperature_outliers",
    lambda m: pages.temperature_boxes(m.laps)[1],
    O.outliers_sql(f"({TEMPERATURE_SQL})", "metric", "value", "lap, metric, value"),
)
add("humidity_series", lambda m: pages.humidity_series(m.laps),
    "SELECT lap, lap_mean_humidity_percentage AS value FROM lap_facts"
    " WHERE lap_mean_humidity_percentage IS NOT NULL")
add("tukey_box", lambda m: pages.duration_boxes(m.laps)[0],
    O.box_sql("lap_facts", "lap", "lap_duration_seconds"), "q1 median q3")
add(
    "tukey_outliers",
    lambda m: pages.duration_boxes(m.laps)[1].select(*pages.LAP_DETAIL),
    O.outliers_sql("lap_facts", "lap", "lap_duration_seconds", O.cols(pages.LAP_DETAIL)),
)
add(
    "best_lap",
    lambda m: pages.best_lap_per_driver(m.laps),
    "SELECT vehicle_id, vehicle_number, circuit, race_number, lap AS best_lap,"
    " lap_duration_seconds AS best_lap_duration_seconds, lap_start_timestamp_utc FROM lap_facts"
    " WHERE lap_duration_seconds IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id,"
    " vehicle_number, circuit, race_number ORDER BY lap_duration_seconds, lap,"
    " lap_start_timestamp_utc) = 1",
)

# Track map page

def _points(m: Marts) -> DataFrame:
    return m.timeline.where(
        F.col("vbox_long_minutes").isNotNull() & F.col("vbox_lat_minutes").isNotNull()
    )


def _braking(m: Marts) -> DataFrame:
    return pages.braking_points(_points(m), series=WHOLE_TRACK)


TRACK_SQL = (
    "SELECT circuit, race_number, vehicle_id, lap, vbox_long_minutes, vbox_lat_minutes, speed, event_timestamp,"
    f" event_source FROM timeline WHERE circuit = 'north' AND lap = 3 AND {O.COORDS}"
    " AND vehicle_id IN (SELECT DISTINCT vehicle_id FROM timeline WHERE circuit = 'north'"
    " ORDER BY vehicle_id LIMIT 3)"
)
add("track_points", lambda m: pages.track_points(m.timeline, "north", 3), TRACK_SQL)
add(
    "track_points_per_vehicle",
    lambda m: pages.points_per_vehicle(pages.track_points(m.timeline, "north", 3)),
    f"SELECT vehicle_id, count(*) AS count FROM ({TRACK_SQL}) GROUP BY vehicle_id",
)
WANTED = ["V001", "V002", "V003", "V004", "V005", "none"]
add(
    "track_points_per_wanted_vehicle",
    lambda m: pages.points_per_vehicle(pages.track_points(m.timeline, "north", 3, WANTED), WANTED),
    f"SELECT vehicle_id, count(lap) AS count FROM (SELECT unnest({WANTED!r}) AS vehicle_id)"
    " LEFT JOIN (SELECT vehicle_id, lap FROM timeline WHERE circuit = 'north' AND lap = 3"
    f" AND {O.COORDS}) USING (vehicle_id) GROUP BY vehicle_id",
)
add(
    "cumulative_distance",
    lambda m: pages.cumulative_distance(
        _points(m).select(*VEHICLE, "event_timestamp", "event_source", "vbox_long_minutes",
                          "vbox_lat_minutes", "speed"),
        series=WHOLE_TRACK,
    ),
    f"""SELECT * EXCLUDE (step), sum(step) OVER (PARTITION BY {O.VK}
  ORDER BY event_timestamp, event_source ROWS UNBOUNDED PRECEDING) AS distance
 FROM (SELECT {O.VK}, event_timestamp, event_source, vbox_long_minutes, vbox_lat_minutes, speed,
  coalesce(sqrt(pow((vbox_long_minutes - lag(vbox_long_minutes) OVER w) * 60, 2)
   + pow((vbox_lat_minutes - lag(vbox_lat_minutes) OVER w) * 60, 2)), 0) AS step
  FROM timeline WHERE {O.COORDS}
  WINDOW w AS (PARTITION BY {O.VK} ORDER BY event_timestamp, event_source))""",
    "distance",
)
add("braking_points", _braking, "SELECT * EXCLUDE (circuit, race_number) FROM braking",
    "speed_drop deceleration_rate")
add(
    "braking_bands",
    lambda m: pages.braking_bands(m.braking),
    "SELECT *, CASE WHEN speed_drop_range < 10 THEN 'quantile' ELSE 'linear' END AS color_scale"
    " FROM (SELECT min(speed_drop) AS min_speed_drop, max(speed_drop) AS max_speed_drop,"
    " max(speed_drop) - min(speed_drop) AS speed_drop_range,"
    " count(*) FILTER (speed_drop < 20) AS light,"
    " count(*) FILTER (speed_drop >= 20 AND speed_drop < 40) AS medium,"
    " count(*) FILTER (speed_drop >= 40) AS heavy FROM braking)",
    "min_speed_drop max_speed_drop speed_drop_range",
)
add(
    "quantile_class",
    lambda m: stats.quantile_class(
        m.braking.select("vehicle_id", "event_timestamp", "speed_drop"), "speed_drop"
    ),
    "SELECT vehicle_id, event_timestamp, speed_drop, "
    + " + ".join(
        f"CAST(speed_drop >= (SELECT quantile_cont(speed_drop, 0.{q}) FROM braking) AS BIGINT)"
        for q in (2, 4, 6, 8)
    )
    + " AS quantile_class FROM braking",
    "speed_drop",
)
add(
    "vehicle_stats",
    lambda m: pages.vehicle_statistics(_points(m)),
    "SELECT vehicle_id, avg(speed) AS avg_speed, max(speed) AS max_speed, min(speed) AS min_speed,"
    f" count(*) AS data_points FROM timeline WHERE {O.COORDS} GROUP BY vehicle_id",
    "avg_speed",
)


# Files: what was written is read back and compared with the given tables

CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CIRCUIT_FILES = {"north": "barber", "south": "cota"}


def _write_race_files(table: DataFrame, kind: str, root: str, circuits: dict[str, str]) -> None:
    """A table as race files in the catalogue's folders, with the files' own headers."""
    files = race_files(root)
    for circuit, folder in circuits.items():
        for race in (1, 2):
            (file,) = select_files(files, kind, [folder], [race])
            part = table.where((F.col("circuit") == circuit) & (F.col("race_number") == race))
            part.select(
                *[F.col(c).alias(HEADERS.get(c, c)) for c in SCHEMAS[kind].names]
            ).write.option("header", True).option(
                "timestampFormat", CSV_TIME
            ).csv(file.path)


def _scratch(spark: SparkSession, name: str) -> str:
    return remove_at_end(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _csv_read(
    kind: str, source: Callable[[Marts], DataFrame], circuits: dict[str, str] = CIRCUIT_FILES
) -> Callable[[Marts], DataFrame]:
    """Write a table as race files in the catalogue's folders, then read them as race files."""

    def run(m: Marts) -> DataFrame:
        root = _scratch(m.spark, "race-files")
        _write_race_files(source(m), kind, root, circuits)
        return read_kind(m.spark, kind, root, list(circuits.values()))

    return run


FOLDER = "CASE circuit WHEN 'north' THEN 'barber' ELSE 'cota' END AS circuit"
add(
    "csv_telemetry",
    _csv_read("telemetry_data", lambda m: m.telemetry()),
    f"SELECT * REPLACE ({FOLDER}) FROM tel",
)
add(
    "csv_weather",
    _csv_read("weather", lambda m: m.weather()),
    f"SELECT * EXCLUDE (time_utc), time_utc AS time_utc_str, CAST(0 AS DOUBLE) AS rain FROM"
    f" (SELECT * REPLACE ({FOLDER}) FROM readings)",
)


for _kind, _where in (
    ("lap_start", "event_type = 'signup' AND event_id % 4 = 0"),
    ("lap_end", "event_type = 'purchase' AND event_id % 4 = 1"),
    ("lap_time", "event_type = 'click'"),
):
    add(
        f"csv_{_kind}",
        _csv_read(_kind, lambda m, kind=_kind: m.lap_events(kind)),
        f"SELECT * REPLACE ({FOLDER}) FROM (SELECT {O.ROW_COLUMNS}, ts AS timestamp FROM base WHERE {_where})",
    )


def _us_weather(m: Marts) -> DataFrame:
    return m.weather().withColumn("time_utc_str", F.date_format("time_utc_str", "M/d/yyyy h:mm:ss a"))


add(
    "csv_weather_us_times",
    _csv_read("weather", _us_weather),
    f"SELECT * EXCLUDE (time_utc), date_trunc('second', time_utc) AS time_utc_str, CAST(0 AS DOUBLE) AS rain"
    f" FROM (SELECT * REPLACE ({FOLDER}) FROM readings)",
)
add(
    "csv_best_laps",
    _csv_read("best_laps", lambda m: adapter.best_laps(m.spark, m.sf_dir)),
    f"SELECT {FOLDER}, race_number, CASE WHEN event_id % 9 <> 0 THEN user_id % 10 END AS number,"
    " event_type AS vehicle, 'Am' AS class, event_id % 30 AS total_driver_laps, "
    + ", ".join(
        f"'1:' || CAST(event_id % {20 + i} AS VARCHAR) AS bestlap_{i}, event_id % {i} AS bestlap_{i}_lapnum"
        for i in range(1, 11)
    )
    + ", '1:' || CAST(user_id AS VARCHAR) AS average"
    f" FROM (SELECT *, {O.RACE_SQL} FROM events WHERE event_type = 'error')",
)


def _shaped(kind: str, known: dict[str, str]) -> Callable[[Marts], DataFrame]:
    """Click events in the columns of a result file, from one SQL expression per known column."""

    def run(m: Marts) -> DataFrame:
        clicks = m.spark.read.parquet(f"{m.sf_dir}/events.parquet").where("event_type = 'click'")
        columns = [F.expr(known.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in SCHEMAS[kind].fields]
        return clicks.select(*adapter._race(), *columns)

    return run


BY_CLASS = {"class_type": "event_type", "pos": "event_id", "number": "user_id % 10", "best_lap_kph": "value"}
ENDURANCE = {"number": "user_id % 10", "lap_number": "event_id % 30", "lap_improvement": "event_id % 3",
             "class": "event_type", "kph": "value"}
for _name, _kind, _known, _circuits in (
    ("csv_results_by_class", "results_by_class", BY_CLASS, CIRCUIT_FILES),
    ("csv_official_by_class", "official_results_by_class", BY_CLASS,
     {"north": "indianapolis", "south": "road_america"}),
    ("csv_endurance", "analysis_endurance", ENDURANCE, CIRCUIT_FILES),
):
    add(
        _name,
        _csv_read(_kind, _shaped(_kind, _known), _circuits),
        "SELECT " + ", ".join(f'{_known.get(c, "NULL")} AS "{c}"' for c in SCHEMAS[_kind].names)
        + f", CASE circuit WHEN 'north' THEN '{_circuits['north']}' ELSE '{_circuits['south']}' END AS circuit,"
        f" race_number FROM (SELECT *, {O.RACE_SQL} FROM events WHERE event_type = 'click')",
    )


CLICKS = f"(SELECT *, {O.RACE_SQL} FROM events WHERE event_type = 'click')"
RESULT_TEXT = {
    "group": "'g' || CAST(event_id % 4 AS VARCHAR)",
    "ecm_car_id": "'c;,' || CAST(event_id % 5 AS VARCHAR)",
    "extra_7": "'e' || CAST(event_id % 6 AS VARCHAR)",
    "driver_extra_5": "'d' || CAST(event_id % 7 AS VARCHAR)",
    "position": "event_id",
    "number": "user_id % 10",
    "status": "event_type",
    "fl_kph": "value",
}
add(
    "csv_results",
    _csv_read("provisional_results", lambda m: adapter.results(m.spark, m.sf_dir)),
    "SELECT "
    + ", ".join(
        f'{RESULT_TEXT.get(c, "NULL")} AS "{c}"' for c in SCHEMAS["provisional_results"].names
    )
    + f", {FOLDER}, race_number FROM {CLICKS}",
)
add(
    "best_laps_wide",
    lambda m: laps.best_laps(adapter.best_laps(m.spark, m.sf_dir)),
    f"SELECT {O.RACE_SQL}, user_id % 10 AS vehicle_number, event_type AS vehicle, 'Am' AS class,"
    " event_id % 30 AS total_driver_laps, "
    + ", ".join(
        f"'1:' || CAST(event_id % {20 + i} AS VARCHAR) AS bestlap_{i}_elapsed_time,"
        f" event_id % {i} AS bestlap_{i}_lapnum"
        for i in range(1, 11)
    )
    + ", '1:' || CAST(user_id AS VARCHAR) AS average_best_lap FROM events"
    " WHERE event_type = 'error' AND event_id % 9 <> 0",
)


def _json_read(m: Marts) -> DataFrame:
    path = remove_at_end(m.spark, f"{shared_dir(m.spark)}/json-{uuid.uuid4().hex}")
    summary = pages.race_summary(m.timeline)
    write_json(summary, path)
    return m.spark.read.schema(summary.schema).json(path)


add("json_race_summary", _json_read, QUERIES["race_summary"].sql, "avg_speed")


# The season file, values that cannot be read, and a refresh from race files to published views


def _season(m: Marts) -> DataFrame:
    """The season file has no race and no fixed columns, so all its columns stay text."""
    root = _scratch(m.spark, "race-files")
    (file,) = select_files(race_files(root), "drivers_championship")
    standings = (
        adapter.events(m.spark, m.sf_dir)
        .groupBy((F.col("user_id") % 10).alias("NUMBER"))
        .agg(F.count(F.lit(1)).alias("Points"), F.concat(F.lit("Driver, "), F.min("event_type")).alias(" Participant "))
    )
    standings.write.option("header", True).csv(file.path)
    return read_kind(m.spark, "drivers_championship", root)


add(
    "csv_championship",
    _season,
    """SELECT CAST(user_id % 10 AS VARCHAR) AS "NUMBER", CAST(count(*) AS VARCHAR) AS "Points",
 'Driver, ' || min(event_type) AS "Participant", 'indianapolis' AS circuit, CAST(NULL AS BIGINT) AS race_number
 FROM events GROUP BY user_id % 10""",
)


def _unread(m: Marts) -> DataFrame:
    """Weather files with words and broken times among their numbers."""
    root = _scratch(m.spark, "race-files")
    table = m.weather()
    odd = F.pmod(F.col("time_utc_seconds"), F.lit(9)) == 0
    table = table.withColumns(
        {
            "humidity": F.when(odd, F.lit("wet")).otherwise(F.col("humidity").cast("string")),
            "air_temp": F.when(odd, F.concat(F.col("race_number").cast("string"), F.lit(" F"))).otherwise(
                F.col("air_temp").cast("string")
            ),
        }
    )
    _write_race_files(table, "weather", root, CIRCUIT_FILES)
    return unread_values(read_kind(m.spark, "weather", root, list(CIRCUIT_FILES.values()), report=True))


add(
    "unread_values",
    _unread,
    f"""SELECT circuit, race_number, col AS "column", count(*) AS "values", min(col || '=' || val) AS example
 FROM (SELECT {FOLDER}, race_number, unnest(['air_temp', 'humidity']) AS col,
  unnest([CAST(race_number AS VARCHAR) || ' F', 'wet']) AS val
  FROM readings WHERE time_utc_seconds % 9 = 0) GROUP BY ALL""",
)


def _refreshed(m: Marts) -> str:
    """Race files of the given tables, refreshed twice into published tables; done once per session."""
    if "refreshed" not in m.__dict__:
        root, out = _scratch(m.spark, "race-files"), _scratch(m.spark, "published")
        sources = {"telemetry_data": m.telemetry(), "weather": m.weather(),
                   "best_laps": adapter.best_laps(m.spark, m.sf_dir)}
        sources |= {kind: m.lap_events(kind) for kind in ("lap_start", "lap_end", "lap_time")}
        for kind, table in sources.items():
            _write_race_files(table, kind, root, CIRCUIT_FILES)
        build.refresh(m.spark, root, out, list(CIRCUIT_FILES.values()))
        m.__dict__["refreshed"] = out
    return m.__dict__["refreshed"]


def _published(m: Marts, sql: str) -> DataFrame:
    """SQL over the views, as a user writes it."""
    build.publish(m.spark, _refreshed(m))
    return m.spark.sql(sql)


add(
    "published_lap_facts",
    lambda m: _published(m, "SELECT * FROM fact_laps"),
    f"SELECT * REPLACE ({FOLDER}) FROM lap_facts",
)
add(
    "published_wind",
    lambda m: _published(
        m, "SELECT circuit, race_number, wind_direction_label, count(*) AS readings, max(wind_speed_mph) AS fastest"
        " FROM fact_wind GROUP BY circuit, race_number, wind_direction_label"
    ),
    f"SELECT {FOLDER}, race_number, wind_direction_label, count(*) AS readings, max(wind_speed_mph) AS fastest"
    " FROM wind GROUP BY ALL",
)
_VIEWS = {
    "fact_speed": "(SELECT * FROM periods WHERE telemetry_name = 'speed')",
    "fact_gear": "(SELECT * FROM periods WHERE telemetry_name = 'gear')",
    "fact_acc": "acc_periods",
    "fact_position": "position_periods",
    "fact_telemetry_data": "timeline",
    "viz_driver_consistency": "placed",
    "int_laps_start": "starts",
    "int_laps_end": "ends",
    "int_weather_humidity": "(SELECT * FROM readings WHERE humidity IS NOT NULL)",
    "int_telemetry_data_aps": "(SELECT * FROM tel WHERE telemetry_name = 'aps')",
}
add(
    "published_views",
    lambda m: _published(
        m,
        " UNION ALL ".join(
            f"SELECT '{v}' AS view, circuit, race_number, count(*) AS n FROM {v} GROUP BY circuit, race_number"
            for v in _VIEWS
        ),
    ),
    " UNION ALL ".join(
        f"SELECT '{v}' AS view, {FOLDER}, race_number, count(*) AS n FROM {t} GROUP BY ALL" for v, t in _VIEWS.items()
    ),
)
