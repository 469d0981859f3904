"""DuckDB text for every registered query, composed from named subqueries.

The text says what each table holds in the plainest way: one window per whole series, joins on
whole groups. It shares nothing with the Spark code but column names and fixed values.
"""

from __future__ import annotations

import re

VK = "circuit, race_number, vehicle_id"
SERIES = f"{VK}, telemetry_name"
CONTEXT = ["lap", "outing", "meta_event", "meta_session", "meta_source", "meta_time"]
ORIGIN = ["original_vehicle_id", "expire_at"]
# measure column, signal name, source label
SINGLES = [
    ("laptrigger_lapdist_dls", "Laptrigger_lapdist_dls", "laptrigger"),
    ("aps", "aps", "aps"),
    ("gear", "gear", "gear"),
    ("nmot", "nmot", "nmot"),
    ("speed", "speed", "speed"),
    ("steering_angle", "Steering_Angle", "steering_angle"),
    ("front_brake_pressure", "pbrake_f", "front_brake_pressure"),
    ("rear_brake_pressure", "pbrake_r", "rear_brake_pressure"),
]
WEATHER = ["humidity_percentage", "pressure_inches", "pressure_mbars", "air_temp_fahrenheit",
           "air_temp_celsius", "track_temp_fahrenheit", "track_temp_celsius"]
LK = ["circuit", "race_number", "vehicle_id", "vehicle_number", "lap", "outing"]


def cols(names, prefix=""):
    return ", ".join(prefix + n for n in names)


def each(names, template):
    return ", ".join(template.format(n) for n in names)


RACE_SQL = """CASE WHEN user_id % 10 < 5 THEN 'north' ELSE 'south' END AS circuit,
 1 + user_id % 2 AS race_number"""

CTES: dict[str, str] = {}

CTES["base"] = f"""SELECT event_id, event_type, value, ts, {RACE_SQL},
 'V' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') AS vehicle_id,
 user_id % 10 AS vehicle_number,
 CAST(day(ts) AS BIGINT) AS lap,
 CAST((day(ts) - 1) // 10 AS BIGINT) AS outing,
 event_type AS meta_event,
 'R' || CAST(1 + user_id % 2 AS VARCHAR) AS meta_session,
 'logger' || CAST(event_id % 3 AS VARCHAR) AS meta_source,
 ts + to_seconds(event_id % 5) AS meta_time,
 'U' || CAST(user_id AS VARCHAR) AS original_vehicle_id,
 ts + INTERVAL 1 DAY AS expire_at,
 ['speed','aps','gear','nmot','accx_can','accy_can','pbrake_f','pbrake_r','Steering_Angle',
  'Laptrigger_lapdist_dls','VBOX_Long_Minutes','VBOX_Lat_Min'][1 + event_id % 12] AS telemetry_name
 FROM events"""

ROW_COLUMNS = f"{VK}, vehicle_number, {cols(CONTEXT)}, {cols(ORIGIN)}"

for tag, metres in (("", 3674), ("_audit", 36)):
    CTES[f"tel{tag}"] = f"""SELECT {ROW_COLUMNS}, telemetry_name,
 CAST(CASE telemetry_name WHEN 'gear' THEN floor(value) % 6 + 1
  WHEN 'Laptrigger_lapdist_dls' THEN (value * 73.1) % {metres} ELSE value END AS DOUBLE)
  AS telemetry_value,
 CASE WHEN telemetry_name IN ('accx_can','accy_can','VBOX_Long_Minutes','VBOX_Lat_Min')
  THEN date_trunc('hour', ts) ELSE ts END AS timestamp
 FROM base"""
    in_singles = ", ".join(f"'{s}'" for _, s, _ in SINGLES)
    CTES[f"stepped{tag}"] = f"""SELECT *, lag(telemetry_value) OVER w AS before
 FROM tel{tag} WHERE telemetry_name IN ({in_singles})
 WINDOW w AS (PARTITION BY {SERIES} ORDER BY timestamp, meta_time, telemetry_value)"""
    CTES[f"grouped{tag}"] = f"""SELECT *,
 sum(CASE WHEN before IS NULL OR telemetry_value <> before THEN 1 ELSE 0 END) OVER w AS grp
 FROM stepped{tag}
 WINDOW w AS (PARTITION BY {SERIES} ORDER BY timestamp, meta_time, telemetry_value
  ROWS UNBOUNDED PRECEDING)"""
    CTES[f"runs{tag}"] = f"""SELECT {SERIES}, grp, telemetry_value AS value,
 min(timestamp) AS start_timestamp, min(vehicle_number) AS vehicle_number,
 {each(CONTEXT + ORIGIN, 'min({0}) AS {0}')}
 FROM grouped{tag} GROUP BY {SERIES}, grp, telemetry_value"""
    CTES[f"periods{tag}"] = f"""SELECT {SERIES}, vehicle_number, start_timestamp,
 lead(start_timestamp) OVER w AS end_timestamp, {cols(CONTEXT)}, value,
 lag(value) OVER w AS previous_value, value - coalesce(lag(value) OVER w, 0) AS value_change,
 {cols(ORIGIN)} FROM runs{tag}
 WINDOW w AS (PARTITION BY {SERIES} ORDER BY start_timestamp, grp)"""

def newest(name):
    return f"""SELECT * FROM tel WHERE telemetry_name = '{name}'
 QUALIFY row_number() OVER (PARTITION BY {VK}, timestamp
  ORDER BY meta_time DESC, telemetry_value DESC) = 1"""

MATCH = " AND ".join(f"a.{k} = b.{k}" for k in ("circuit", "race_number", "vehicle_id", "timestamp"))
EITHER = each(["circuit", "race_number", "vehicle_id", "timestamp"], "coalesce(a.{0}, b.{0}) AS {0}")
PLAIN = ["lap", "outing", "meta_event", "meta_session"]

CTES["long_side"], CTES["lat_side"] = newest("VBOX_Long_Minutes"), newest("VBOX_Lat_Min")
CTES["x_side"], CTES["y_side"] = newest("accx_can"), newest("accy_can")
CTES["position_pairs"] = f"""SELECT {EITHER}, a.telemetry_value AS vbox_long_minutes,
 a.vehicle_number, {cols(PLAIN, 'a.')}, a.meta_time AS long_meta_time,
 b.telemetry_value AS vbox_lat_minutes, b.meta_time AS lat_meta_time
 FROM long_side a FULL JOIN lat_side b ON {MATCH}"""
CTES["acc_pairs"] = f"""SELECT {EITHER}, a.telemetry_value AS accx_can, a.vehicle_number,
 {cols(CONTEXT + ORIGIN, 'a.')}, b.telemetry_value AS accy_can
 FROM x_side a FULL JOIN y_side b ON {MATCH}"""
UPTO = f"(PARTITION BY {VK} ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"
CARRY = "last_value({0} IGNORE NULLS) OVER w AS {0}"
CTES["position_filled"] = f"""SELECT {VK}, timestamp, vehicle_number,
 {each(['vbox_long_minutes', 'vbox_lat_minutes'] + PLAIN, CARRY)}, long_meta_time, lat_meta_time
 FROM position_pairs WINDOW w AS {UPTO}"""
CTES["acc_filled"] = f"""SELECT {VK}, timestamp, vehicle_number,
 {each(['accx_can', 'accy_can'] + CONTEXT + ORIGIN, CARRY)} FROM acc_pairs WINDOW w AS {UPTO}"""

def changes(source, first, second):
    return f"""SELECT *, sum(CAST(p IS DISTINCT FROM {first} OR q IS DISTINCT FROM {second} AS INT))
  OVER (PARTITION BY {VK} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS grp
 FROM (SELECT *, lag({first}) OVER w AS p, lag({second}) OVER w AS q FROM {source}
  WINDOW w AS (PARTITION BY {VK} ORDER BY timestamp))"""

CTES["position_groups"] = changes("position_filled", "vbox_long_minutes", "vbox_lat_minutes")
CTES["acc_groups"] = changes("acc_filled", "accx_can", "accy_can")
POSITION_MAX = ["vehicle_number"] + PLAIN + ["long_meta_time", "lat_meta_time"]
CTES["position_periods"] = f"""SELECT *,
 lead(position_start_timestamp) OVER (PARTITION BY {VK} ORDER BY position_start_timestamp)
  AS position_end_timestamp
 FROM (SELECT {VK}, min(timestamp) AS position_start_timestamp,
  {each(['vbox_long_minutes', 'vbox_lat_minutes'] + POSITION_MAX, 'max({0}) AS {0}')}
  FROM position_groups GROUP BY {VK}, grp)"""
CTES["acc_runs"] = f"""SELECT {VK}, accx_can, accy_can, min(timestamp) AS acc_start_timestamp,
 {each(['vehicle_number'] + CONTEXT + ORIGIN, 'min({0}) AS {0}')}
 FROM acc_groups GROUP BY {VK}, grp, accx_can, accy_can"""
CTES["acc_periods"] = f"""SELECT *, lead(acc_start_timestamp) OVER w AS acc_end_timestamp,
 lag(accx_can) OVER w AS previous_accx_can, lag(accy_can) OVER w AS previous_accy_can,
 accx_can - coalesce(lag(accx_can) OVER w, 0) AS accx_change,
 accy_can - coalesce(lag(accy_can) OVER w, 0) AS accy_change
 FROM acc_runs WINDOW w AS (PARTITION BY {VK} ORDER BY acc_start_timestamp)"""

HEAD = f"{VK}, vehicle_number, {cols(PLAIN)}"
POSITION = ["position_start_timestamp", "position_end_timestamp", "vbox_long_minutes",
            "vbox_lat_minutes", "long_meta_time", "lat_meta_time"]
ACC = ["acc_start_timestamp", "acc_end_timestamp", "accx_can", "accy_can"]
CARRIED = POSITION + ACC + [
    c for m, _, _ in SINGLES for c in (f"{m}_start_timestamp", f"{m}_end_timestamp", m)
]
for tag in ("", "_audit"):
    parts = [
        f"""SELECT {HEAD}, position_start_timestamp AS event_timestamp,
 'position' AS event_source, {cols(POSITION)} FROM position_periods""",
        f"""SELECT {HEAD}, acc_start_timestamp AS event_timestamp, 'acc' AS event_source,
 {cols(ACC)} FROM acc_periods""",
    ] + [
        f"""SELECT {HEAD}, start_timestamp AS event_timestamp, '{label}' AS event_source,
 start_timestamp AS {m}_start_timestamp, end_timestamp AS {m}_end_timestamp, value AS {m}
 FROM periods{tag} WHERE telemetry_name = '{signal}'"""
        for m, signal, label in SINGLES
    ]
    CTES[f"events_union{tag}"] = "\n UNION ALL BY NAME ".join(parts)
    CTES[f"timeline{tag}"] = f"""SELECT {HEAD}, event_timestamp, event_source,
 {each(CARRIED, CARRY)} FROM events_union{tag}
 WINDOW w AS (PARTITION BY {VK} ORDER BY event_timestamp, event_source
  ROWS UNBOUNDED PRECEDING)"""

# Laps and weather
LAP_ROW = f"{ROW_COLUMNS}, ts AS timestamp"
CTES["starts"] = f"""SELECT * EXCLUDE (timestamp), timestamp AS lap_start_timestamp_utc,
 timestamp - INTERVAL 5 HOUR AS lap_start_timestamp
 FROM (SELECT {LAP_ROW} FROM base WHERE event_type = 'signup' AND event_id % 4 = 0)
 QUALIFY row_number() OVER (PARTITION BY {VK}, lap ORDER BY timestamp) = 1"""
CTES["ends"] = f"""SELECT * EXCLUDE (timestamp), timestamp AS lap_end_timestamp_utc,
 timestamp - INTERVAL 5 HOUR AS lap_end_timestamp
 FROM (SELECT {LAP_ROW} FROM base WHERE event_type = 'purchase' AND event_id % 4 = 1)
 QUALIFY row_number() OVER (PARTITION BY {VK}, lap ORDER BY timestamp DESC) = 1"""
DETAILS = ["meta_event", "meta_session", "meta_source", "meta_time"] + ORIGIN
CTES["combined"] = f"""SELECT {each(LK + DETAILS, 'coalesce(a.{0}, b.{0}) AS {0}')},
 coalesce(a.lap_start_timestamp_utc, b.earlier) AS lap_start_timestamp_utc,
 coalesce(b.lap_end_timestamp_utc, a.later) AS lap_end_timestamp_utc,
 date_diff('second', a.lap_start_timestamp_utc, b.lap_end_timestamp_utc) AS lap_duration_seconds,
 epoch_us(b.lap_end_timestamp_utc) - epoch_us(a.lap_start_timestamp_utc) AS lap_duration_minutes
 FROM (SELECT *, lead(lap_start_timestamp_utc)
   OVER (PARTITION BY {VK}, outing ORDER BY lap) AS later FROM starts) a
 FULL JOIN (SELECT *, lag(lap_end_timestamp_utc)
   OVER (PARTITION BY {VK}, outing ORDER BY lap) AS earlier FROM ends) b
 ON {' AND '.join(f'a.{k} = b.{k}' for k in ('circuit', 'race_number', 'vehicle_id', 'outing', 'lap'))}"""
CTES["readings"] = f"""SELECT {RACE_SQL}, epoch_us(ts) // 1000000 AS time_utc_seconds,
 ts AS time_utc, 60 + value % 40 AS air_temp, 70 + value % 50 AS track_temp,
 CASE WHEN event_id % 11 <> 0 THEN value % 100 END AS humidity,
 28 + (value % 20) / 10 AS pressure,
 CASE WHEN event_id % 7 <> 0 THEN value % 25 END AS wind_speed,
 CASE WHEN event_id % 13 <> 0 THEN CAST(event_id * 7 % 361 AS DOUBLE) END AS wind_direction
 FROM events WHERE event_type = 'view'"""
CTES["weather"] = """SELECT circuit, race_number, time_utc, time_utc_seconds,
 air_temp AS air_temp_fahrenheit, (air_temp - 32) * 5 / 9 AS air_temp_celsius,
 track_temp AS track_temp_fahrenheit, (track_temp - 32) * 5 / 9 AS track_temp_celsius,
 humidity AS humidity_percentage, pressure AS pressure_inches, pressure * 36.86 AS pressure_mbars,
 wind_speed AS wind_speed_mph, wind_speed * 1.609 AS wind_speed_kph,
 wind_direction AS wind_direction_degrees FROM readings"""
CTES["lap_readings"] = f"""SELECT {cols(LK, 'l.')}, l.lap_start_timestamp_utc,
 l.lap_end_timestamp_utc, r.time_utc, {cols(WEATHER, 'r.')}
 FROM combined l JOIN weather r ON l.circuit = r.circuit AND l.race_number = r.race_number
 AND r.time_utc BETWEEN l.lap_start_timestamp_utc AND l.lap_end_timestamp_utc"""
# Means to be rounded are of exact sums, in units of 2**-60, which do not depend on the order of the rows.
UNIT = 2**60
CTES["lap_facts"] = f"""SELECT {cols(LK, 'l.')}, l.lap_start_timestamp_utc, l.lap_end_timestamp_utc,
 l.lap_duration_seconds, l.lap_duration_minutes, {cols(DETAILS, 'l.')},
 {each(WEATHER, 'round(s.x_{0}, 3) AS lap_max_{0}, round(s.a_{0}, 3) AS lap_mean_{0}, round(s.m_{0}, 3) AS lap_median_{0}')}
 FROM combined l LEFT JOIN (SELECT {cols(LK)},
  {each(WEATHER, 'max({0}) AS x_{0}, CAST(sum(CAST({0} * ' + str(UNIT) + ' AS HUGEINT)) AS DOUBLE) / ' + str(UNIT) + ' / count({0}) AS a_{0}, median({0}) AS m_{0}')}
  FROM lap_readings GROUP BY ALL) s
 ON {' AND '.join(f'l.{k} = s.{k}' for k in LK)}
 WHERE l.lap_start_timestamp_utc IS NOT NULL OR l.lap_end_timestamp_utc IS NOT NULL"""

BAND = """CASE WHEN wind_speed_mph < 5 THEN '00-05 mph' WHEN wind_speed_mph < 10 THEN '05-10 mph'
 WHEN wind_speed_mph < 15 THEN '10-15 mph' WHEN wind_speed_mph < 20 THEN '15-20 mph'
 WHEN wind_speed_mph IS NOT NULL THEN '20+ mph' END"""
LABEL = """['North','North East','East','South East','South','South West','West','North West']
 [1 + CAST(floor((wind_direction_degrees % 360 + 22.5) / 45) AS INT) % 8]"""
CTES["wind"] = f"""SELECT coalesce(d.time_utc, s.time_utc) AS time_utc, time_utc_seconds,
 wind_speed_mph, wind_speed_kph, wind_direction_degrees,
 {LABEL} AS wind_direction_label, {BAND} AS wind_speed_band_mph, circuit, race_number
 FROM (SELECT circuit, race_number, time_utc, time_utc_seconds, wind_direction_degrees
  FROM weather WHERE wind_direction_degrees IS NOT NULL) d
 FULL JOIN (SELECT circuit, race_number, time_utc, time_utc_seconds, wind_speed_mph, wind_speed_kph
  FROM weather WHERE wind_speed_mph IS NOT NULL) s
 USING (circuit, race_number, time_utc_seconds)"""
CTES["rose"] = """SELECT CAST(floor((wind_direction_degrees % 360) / 22.5) AS BIGINT)
 AS direction_index, wind_speed_band_mph AS speed_bin, count(*) AS sample_count
 FROM wind WHERE wind_direction_degrees IS NOT NULL AND wind_speed_band_mph IS NOT NULL
 GROUP BY ALL"""

# Track
CTES["spine"] = """SELECT m AS meter_position_m, n AS sector_number, name AS sector_name,
 s AS sector_start_distance_m, e AS sector_end_distance_m, e - s AS sector_length_m
 FROM (SELECT n, name, sum(metres) OVER (ORDER BY n) - metres AS s,
   sum(metres) OVER (ORDER BY n) AS e
  FROM (SELECT n, name, CAST(inches * 0.0254 AS DECIMAL(18,4)) AS metres
   FROM (VALUES (1, 'Sector 1', 40512), (2, 'Sector 2', 62220), (3, 'Sector 3', 41940))
    t(n, name, inches)))
 JOIN (SELECT unnest(range(0, 3675)) AS m) ON m >= s AND m < e"""
CTES["spine_audit"] = """SELECT m AS meter_position_m, 1 + m // 12 AS sector_number,
 'Sector ' || CAST(1 + m // 12 AS VARCHAR) AS sector_name, 12.0 AS sector_length_m
 FROM (SELECT unnest(range(0, 36)) AS m)"""
for tag in ("", "_audit"):
    CTES[f"placed{tag}"] = f"""SELECT {VK}, vehicle_number, outing, lap, event_timestamp,
 laptrigger_lapdist_dls, meter_position_m, event_source, speed, gear, aps, steering_angle,
 front_brake_pressure, rear_brake_pressure, CAST(sector_number AS BIGINT) AS sector_number,
 sector_name, CAST(sector_length_m AS DOUBLE) AS sector_length_m
 FROM timeline{tag} LEFT JOIN spine{tag} ON floor(laptrigger_lapdist_dls) = meter_position_m
 WHERE lap IS NOT NULL AND laptrigger_lapdist_dls IS NOT NULL"""

# Audit
PLACE = "circuit, vehicle_id, meter_position_m"
AUDIT = ["laptrigger_lapdist_dls", "speed", "gear", "aps", "steering_angle",
         "front_brake_pressure", "rear_brake_pressure"]
SHORT = dict(zip(AUDIT, ["laptrigger", "speed", "gear", "aps", "steering", "front_brake",
                         "rear_brake"]))
DEVIATION = {m: f"{SHORT[m]}_variability" for m in AUDIT}
DEVIATION["rear_brake_pressure"] = "avg_rear_brake_variability"
CTES["signature"] = f"""SELECT {PLACE}, vehicle_number, event_source AS signature_event_source,
 n AS event_instances, laps_with_event,
 n / sum(n) OVER (PARTITION BY {PLACE}) AS signature_event_share
 FROM (SELECT {PLACE}, vehicle_number, event_source, count(*) AS n,
  count(DISTINCT lap) AS laps_with_event FROM placed_audit GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY {PLACE} ORDER BY n DESC, event_source, vehicle_number) = 1"""
CTES["metrics"] = f"""SELECT {PLACE},
 {', '.join(f'avg({m}) AS avg_{m}, stddev_pop({m}) AS {DEVIATION[m]}' for m in AUDIT)},
 count(DISTINCT lap) AS laps_covered FROM placed_audit GROUP BY {PLACE}"""
CTES["aligned"] = f"""SELECT p.*, g.signature_event_source, g.signature_event_share,
 CAST(p.event_source = g.signature_event_source AS BIGINT) AS event_match_flag,
 {', '.join(f'abs(p.{m} - k.avg_{m}) AS {SHORT[m]}_delta' for m in AUDIT)}
 FROM placed_audit p JOIN signature g USING (circuit, vehicle_id, meter_position_m)
 JOIN metrics k USING (circuit, vehicle_id, meter_position_m)"""
DRIVER = "circuit, vehicle_id, vehicle_number"
CTES["by_lap"] = f"""SELECT {DRIVER}, outing, lap, avg(event_match_flag) AS alignment_ratio,
 count(*) AS evaluated_events, CAST(sum(event_match_flag) AS BIGINT) AS matched_events,
 {', '.join(f'avg({s}_delta) AS avg_{s}_delta' for s in SHORT.values())}
 FROM aligned GROUP BY {DRIVER}, outing, lap"""
CTES["by_driver"] = f"""SELECT {DRIVER}, count(DISTINCT lap) AS laps_analyzed,
 avg(alignment_ratio) AS avg_alignment_ratio,
 quantile_cont(alignment_ratio, 0.5) AS median_alignment_ratio,
 quantile_cont(alignment_ratio, 0.1) AS p10_alignment_ratio,
 quantile_cont(alignment_ratio, 0.9) AS p90_alignment_ratio,
 {', '.join(f'avg(avg_{s}_delta) AS avg_{s}_delta' for s in SHORT.values())}
 FROM by_lap GROUP BY {DRIVER}"""
OTHERS = AUDIT[1:]
CTES["by_metre"] = f"""SELECT circuit, vehicle_id, vehicle_number, meter_position_m,
 sector_number, sector_name, max(sector_length_m) AS sector_length_m,
 count(*) AS evaluated_events, count(DISTINCT outing) AS outings_covered,
 count(DISTINCT lap) AS laps_covered, avg(event_match_flag) AS meter_alignment_ratio,
 1 - avg(event_match_flag) AS meter_change_ratio,
 avg(signature_event_share) AS avg_signature_event_share,
 {', '.join(f'avg({SHORT[m]}_delta) AS avg_{SHORT[m]}_delta' for m in OTHERS)},
 {', '.join(f'stddev_pop({m}) AS {SHORT[m]}_stddev' for m in OTHERS)}
 FROM aligned GROUP BY ALL"""

# Page helpers
COORDS = "vbox_long_minutes IS NOT NULL AND vbox_lat_minutes IS NOT NULL"
CTES["boxes"] = "SELECT lap, " + ", ".join(
    f"min({c}) AS {p}_min, quantile_cont({c}, 0.25) AS {p}_q1, quantile_cont({c}, 0.5) AS {p}_median,"
    f" quantile_cont({c}, 0.75) AS {p}_q3, max({c}) AS {p}_max"
    for p, c in (("speed", "speed"), ("nmot", "nmot"), ("aps", "aps"),
                 ("front_brake", "front_brake_pressure"), ("rear_brake", "rear_brake_pressure"))
) + " FROM timeline WHERE lap IS NOT NULL GROUP BY lap"
CTES["braking"] = f"""SELECT * FROM (SELECT {VK}, event_timestamp, vbox_long_minutes,
  vbox_lat_minutes, lag(speed, 30) OVER w - speed AS speed_drop, lag(speed, 30) OVER w AS initial_speed,
  speed AS final_speed, (lag(speed, 30) OVER w - speed) / 30 AS deceleration_rate
  FROM timeline WHERE {COORDS}
  WINDOW w AS (PARTITION BY {VK} ORDER BY event_timestamp, event_source))
 WHERE speed_drop > 8"""


def box_sql(source, key, value):
    return f"""SELECT v.{key}, q1, median, q3, n,
 min({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER ({value} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
 FROM (SELECT * FROM {source} WHERE {value} IS NOT NULL) v
 JOIN (SELECT {key}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
  quantile_cont({value}, 0.75) AS q3, count({value}) AS n FROM {source}
  WHERE {value} IS NOT NULL GROUP BY {key}) q ON v.{key} = q.{key}
 GROUP BY v.{key}, q1, median, q3, n"""


def outliers_sql(source, key, value, columns):
    picked = ", ".join(f"v.{c.strip()}" for c in columns.split(","))
    return f"""SELECT {picked} FROM (SELECT * FROM {source} WHERE {value} IS NOT NULL) v
 JOIN (SELECT {key}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3 FROM {source}
  WHERE {value} IS NOT NULL GROUP BY {key}) q ON v.{key} = q.{key}
 WHERE v.{value} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


def bins_sql(source, column, bins, where="TRUE", metric=None):
    label = f"'{metric}' AS metric, " if metric else ""
    return f"""SELECT {label}bin, lo + bin * w AS lower, lo + (bin + 1) * w AS upper, count(*) AS count
 FROM (SELECT lo, (hi - lo) / {bins} AS w,
  CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) END
   AS BIGINT) AS bin
  FROM (SELECT CAST({column} AS DOUBLE) AS v, min({column}) OVER () AS lo, max({column}) OVER () AS hi
   FROM {source} WHERE {column} IS NOT NULL AND {where}))
 GROUP BY bin, lo, w"""


def expand(sql: str) -> str:
    """Put the subqueries a text uses in front of it, each once and before its first use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql
