"""Columns of the race files: output name, type and, where it differs, the header in the file."""

from __future__ import annotations

from pyspark.sql import types as T

# Column lists of the race files, in the order of the files.
SCHEMAS: dict[str, T.StructType] = {
    "telemetry_data": T.StructType(
        [
            T.StructField("expire_at", T.TimestampType()),
            T.StructField("lap", T.LongType()),
            T.StructField("meta_event", T.StringType()),
            T.StructField("meta_session", T.StringType()),
            T.StructField("meta_source", T.StringType()),
            T.StructField("meta_time", T.TimestampType()),
            T.StructField("original_vehicle_id", T.StringType()),
            T.StructField("outing", T.LongType()),
            T.StructField("telemetry_name", T.StringType()),
            T.StructField("telemetry_value", T.DoubleType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("vehicle_id", T.StringType()),
            T.StructField("vehicle_number", T.LongType()),
        ]
    ),
    "lap_start": T.StructType(
        [
            T.StructField("expire_at", T.TimestampType()),
            T.StructField("lap", T.LongType()),
            T.StructField("meta_event", T.StringType()),
            T.StructField("meta_session", T.StringType()),
            T.StructField("meta_source", T.StringType()),
            T.StructField("meta_time", T.TimestampType()),
            T.StructField("original_vehicle_id", T.StringType()),
            T.StructField("outing", T.LongType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("vehicle_id", T.StringType()),
            T.StructField("vehicle_number", T.LongType()),
        ]
    ),
    "lap_end": T.StructType(
        [
            T.StructField("expire_at", T.TimestampType()),
            T.StructField("lap", T.LongType()),
            T.StructField("meta_event", T.StringType()),
            T.StructField("meta_session", T.StringType()),
            T.StructField("meta_source", T.StringType()),
            T.StructField("meta_time", T.TimestampType()),
            T.StructField("original_vehicle_id", T.StringType()),
            T.StructField("outing", T.LongType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("vehicle_id", T.StringType()),
            T.StructField("vehicle_number", T.LongType()),
        ]
    ),
    "lap_time": T.StructType(
        [
            T.StructField("expire_at", T.TimestampType()),
            T.StructField("lap", T.LongType()),
            T.StructField("meta_event", T.StringType()),
            T.StructField("meta_session", T.StringType()),
            T.StructField("meta_source", T.StringType()),
            T.StructField("meta_time", T.TimestampType()),
            T.StructField("original_vehicle_id", T.StringType()),
            T.StructField("outing", T.LongType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("vehicle_id", T.StringType()),
            T.StructField("vehicle_number", T.LongType()),
        ]
    ),
    "weather": T.StructType(
        [
            T.StructField("time_utc_seconds", T.LongType()),
            T.StructField("time_utc_str", T.TimestampType()),
            T.StructField("air_temp", T.DoubleType()),
            T.StructField("track_temp", T.DoubleType()),
            T.StructField("humidity", T.DoubleType()),
            T.StructField("pressure", T.DoubleType()),
            T.StructField("wind_speed", T.DoubleType()),
            T.StructField("wind_direction", T.DoubleType()),
            T.StructField("rain", T.DoubleType()),
        ]
    ),
    "best_laps": T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("vehicle", T.StringType()),
            T.StructField("class", T.StringType()),
            T.StructField("total_driver_laps", T.LongType()),
            T.StructField("bestlap_1", T.StringType()),
            T.StructField("bestlap_1_lapnum", T.LongType()),
            T.StructField("bestlap_2", T.StringType()),
            T.StructField("bestlap_2_lapnum", T.LongType()),
            T.StructField("bestlap_3", T.StringType()),
            T.StructField("bestlap_3_lapnum", T.LongType()),
            T.StructField("bestlap_4", T.StringType()),
            T.StructField("bestlap_4_lapnum", T.LongType()),
            T.StructField("bestlap_5", T.StringType()),
            T.StructField("bestlap_5_lapnum", T.LongType()),
            T.StructField("bestlap_6", T.StringType()),
            T.StructField("bestlap_6_lapnum", T.LongType()),
            T.StructField("bestlap_7", T.StringType()),
            T.StructField("bestlap_7_lapnum", T.LongType()),
            T.StructField("bestlap_8", T.StringType()),
            T.StructField("bestlap_8_lapnum", T.LongType()),
            T.StructField("bestlap_9", T.StringType()),
            T.StructField("bestlap_9_lapnum", T.LongType()),
            T.StructField("bestlap_10", T.StringType()),
            T.StructField("bestlap_10_lapnum", T.LongType()),
            T.StructField("average", T.StringType()),
        ]
    ),
    "results_by_class": T.StructType(
        [
            T.StructField("class_type", T.StringType()),
            T.StructField("pos", T.LongType()),
            T.StructField("pic", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("vehicle", T.StringType()),
            T.StructField("laps", T.LongType()),
            T.StructField("elapsed", T.StringType()),
            T.StructField("gap_first", T.StringType()),
            T.StructField("gap_previous", T.StringType()),
            T.StructField("best_lap_num", T.LongType()),
            T.StructField("best_lap_time", T.StringType()),
            T.StructField("best_lap_kph", T.DoubleType()),
        ]
    ),
    "official_results_by_class": T.StructType(
        [
            T.StructField("class_type", T.StringType()),
            T.StructField("pos", T.LongType()),
            T.StructField("pic", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("vehicle", T.StringType()),
            T.StructField("laps", T.LongType()),
            T.StructField("elapsed", T.StringType()),
            T.StructField("gap_first", T.StringType()),
            T.StructField("gap_previous", T.StringType()),
            T.StructField("best_lap_num", T.LongType()),
            T.StructField("best_lap_time", T.StringType()),
            T.StructField("best_lap_kph", T.DoubleType()),
        ]
    ),
    "provisional_results": T.StructType(
        [
            T.StructField("position", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("laps", T.LongType()),
            T.StructField("total_time", T.StringType()),
            T.StructField("gap_first", T.StringType()),
            T.StructField("gap_previous", T.StringType()),
            T.StructField("fl_lapnum", T.LongType()),
            T.StructField("fl_time", T.StringType()),
            T.StructField("fl_kph", T.DoubleType()),
            T.StructField("class", T.StringType()),
            T.StructField("group", T.StringType()),
            T.StructField("division", T.StringType()),
            T.StructField("vehicle", T.StringType()),
            T.StructField("tires", T.StringType()),
            T.StructField("ecm_participant_id", T.StringType()),
            T.StructField("ecm_team_id", T.StringType()),
            T.StructField("ecm_category_id", T.StringType()),
            T.StructField("ecm_car_id", T.StringType()),
            T.StructField("ecm_brand_id", T.StringType()),
            T.StructField("ecm_country_id", T.StringType()),
            T.StructField("extra_7", T.StringType()),
            T.StructField("extra_8", T.StringType()),
            T.StructField("extra_9", T.StringType()),
            T.StructField("sort_key", T.StringType()),
            T.StructField("driver_extra_3", T.StringType()),
            T.StructField("driver_extra_4", T.StringType()),
            T.StructField("driver_extra_5", T.StringType()),
        ]
    ),
    "official_results": T.StructType(
        [
            T.StructField("position", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("laps", T.LongType()),
            T.StructField("total_time", T.StringType()),
            T.StructField("gap_first", T.StringType()),
            T.StructField("gap_previous", T.StringType()),
            T.StructField("fl_lapnum", T.LongType()),
            T.StructField("fl_time", T.StringType()),
            T.StructField("fl_kph", T.DoubleType()),
            T.StructField("class", T.StringType()),
            T.StructField("group", T.StringType()),
            T.StructField("division", T.StringType()),
            T.StructField("vehicle", T.StringType()),
            T.StructField("tires", T.StringType()),
            T.StructField("ecm_participant_id", T.StringType()),
            T.StructField("ecm_team_id", T.StringType()),
            T.StructField("ecm_category_id", T.StringType()),
            T.StructField("ecm_car_id", T.StringType()),
            T.StructField("ecm_brand_id", T.StringType()),
            T.StructField("ecm_country_id", T.StringType()),
            T.StructField("extra_7", T.StringType()),
            T.StructField("extra_8", T.StringType()),
            T.StructField("extra_9", T.StringType()),
            T.StructField("sort_key", T.StringType()),
            T.StructField("driver_extra_3", T.StringType()),
            T.StructField("driver_extra_4", T.StringType()),
            T.StructField("driver_extra_5", T.StringType()),
        ]
    ),
    "analysis_endurance": T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("driver_number", T.LongType()),
            T.StructField("lap_number", T.LongType()),
            T.StructField("lap_time", T.StringType()),
            T.StructField("lap_improvement", T.LongType()),
            T.StructField("crossing_finish_line_in_pit", T.StringType()),
            T.StructField("s1", T.StringType()),
            T.StructField("s1_improvement", T.LongType()),
            T.StructField("s2", T.StringType()),
            T.StructField("s2_improvement", T.LongType()),
            T.StructField("s3", T.StringType()),
            T.StructField("s3_improvement", T.LongType()),
            T.StructField("kph", T.DoubleType()),
            T.StructField("elapsed", T.StringType()),
            T.StructField("hour", T.StringType()),
            T.StructField("s1_large", T.StringType()),
            T.StructField("s2_large", T.StringType()),
            T.StructField("s3_large", T.StringType()),
            T.StructField("top_speed", T.DoubleType()),
            T.StructField("pit_time", T.StringType()),
            T.StructField("class", T.StringType()),
            T.StructField("group", T.StringType()),
            T.StructField("manufacturer", T.StringType()),
            T.StructField("flag_at_fl", T.StringType()),
            T.StructField("s1_seconds", T.DoubleType()),
            T.StructField("s2_seconds", T.DoubleType()),
            T.StructField("s3_seconds", T.DoubleType()),
            T.StructField("im1a_time", T.StringType()),
            T.StructField("im1a_elapsed", T.StringType()),
            T.StructField("im1_time", T.StringType()),
            T.StructField("im1_elapsed", T.StringType()),
            T.StructField("im2a_time", T.StringType()),
            T.StructField("im2a_elapsed", T.StringType()),
            T.StructField("im2_time", T.StringType()),
            T.StructField("im2_elapsed", T.StringType()),
            T.StructField("im3a_time", T.StringType()),
            T.StructField("im3a_elapsed", T.StringType()),
            T.StructField("fl_time", T.StringType()),
            T.StructField("fl_elapsed", T.StringType()),
        ]
    ),
}

# Headers that are no plain names.
HEADERS: dict[str, str] = {
    "ecm_participant_id": "ECM Participant Id",
    "ecm_team_id": "ECM Team Id",
    "ecm_category_id": "ECM Category Id",
    "ecm_car_id": "ECM Car Id",
    "ecm_brand_id": "ECM Brand Id",
    "ecm_country_id": "ECM Country Id",
    "extra_7": "*Extra 7",
    "extra_8": "*Extra 8",
    "extra_9": "*Extra 9",
    "sort_key": "Sort Key",
    "driver_extra_3": "DRIVER_*Extra 3",
    "driver_extra_4": "DRIVER_*Extra 4",
    "driver_extra_5": "DRIVER_*Extra 5",
}
