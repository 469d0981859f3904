"""Race tables derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.sources.schemas import SCHEMAS

SIGNALS = ["speed", "aps", "gear", "nmot", "accx_can", "accy_can", "pbrake_f", "pbrake_r",
           "Steering_Angle", "Laptrigger_lapdist_dls", "VBOX_Long_Minutes", "VBOX_Lat_Min"]
PAIRED = SIGNALS[4:6] + SIGNALS[10:]
TRACK_METRES = 3674
AUDIT_METRES = 36
AUDIT_SECTORS = [(1, "Sector 1", 12), (2, "Sector 2", 12), (3, "Sector 3", 12)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _race() -> list[Column]:
    number = F.col("user_id") % 10
    return [
        F.when(number < 5, "north").otherwise("south").alias("circuit"),
        (1 + F.col("user_id") % 2).alias("race_number"),
    ]


def _context() -> list[Column]:
    number, day = F.col("user_id") % 10, F.dayofmonth("ts")
    return [
        *_race(),
        F.concat(F.lit("V"), F.lpad(number.cast("string"), 3, "0")).alias("vehicle_id"),
        number.alias("vehicle_number"),
        day.cast("bigint").alias("lap"),
        F.floor((day - 1) / 10).cast("bigint").alias("outing"),
        F.col("event_type").alias("meta_event"),
        F.concat(F.lit("R"), (1 + F.col("user_id") % 2).cast("string")).alias("meta_session"),
        F.concat(F.lit("logger"), (F.col("event_id") % 3).cast("string")).alias("meta_source"),
        F.timestamp_micros(
            F.unix_micros("ts") + F.col("event_id") % 5 * 1_000_000
        ).alias("meta_time"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("original_vehicle_id"),
        (F.col("ts") + F.expr("interval 1 day")).alias("expire_at"),
    ]


def telemetry(spark: SparkSession, sf_dir: str, metres: int = TRACK_METRES) -> DataFrame:
    name = F.get(F.array(*[F.lit(s) for s in SIGNALS]), (F.col("event_id") % 12).cast("int"))
    value = F.col("value")
    return (
        events(spark, sf_dir)
        .withColumn("telemetry_name", name)
        .select(
            *_context(),
            "telemetry_name",
            F.when(name == "gear", F.floor(value) % 6 + 1)
            .when(name == "Laptrigger_lapdist_dls", (value * 73.1) % metres)
            .otherwise(value)
            .cast("double")
            .alias("telemetry_value"),
            F.when(name.isin(PAIRED), F.date_trunc("hour", "ts"))
            .otherwise(F.col("ts"))
            .alias("timestamp"),
        )
    )


def lap_events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``lap_start``, ``lap_end`` or ``lap_time`` events."""
    chosen = {
        "lap_start": (F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0),
        "lap_end": (F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 1),
        "lap_time": F.col("event_type") == "click",
    }[kind]
    return events(spark, sf_dir).where(chosen).select(*_context(), F.col("ts").alias("timestamp"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, whole = F.col("value"), F.col("event_id") % 11 != 0
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "view")
        .select(
            *_race(),
            F.unix_seconds("ts").alias("time_utc_seconds"),
            F.col("ts").alias("time_utc_str"),
            (60 + value % 40).alias("air_temp"),
            (70 + value % 50).alias("track_temp"),
            F.when(whole, value % 100).alias("humidity"),
            (28 + (value % 20) / 10).alias("pressure"),
            F.when(F.col("event_id") % 7 != 0, value % 25).alias("wind_speed"),
            F.when(F.col("event_id") % 13 != 0, (F.col("event_id") * 7 % 361).cast("double"))
            .alias("wind_direction"),
            F.lit(0.0).alias("rain"),
        )
    )


def best_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shaped like the best-laps file; one in nine lacks its number."""
    whole = F.col("event_id") % 9 != 0
    columns = [
        *_race(),
        F.when(whole, F.col("user_id") % 10).alias("number"),
        F.col("event_type").alias("vehicle"),
        F.lit("Am").alias("class"),
        (F.col("event_id") % 30).alias("total_driver_laps"),
    ]
    for i in range(1, 11):
        columns.append(F.concat(F.lit("1:"), (F.col("event_id") % (20 + i)).cast("string")).alias(
            f"bestlap_{i}"
        ))
        columns.append((F.col("event_id") % i).alias(f"bestlap_{i}_lapnum"))
    columns.append(F.concat(F.lit("1:"), F.col("user_id").cast("string")).alias("average"))
    return events(spark, sf_dir).where(F.col("event_type") == "error").select(*columns)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shaped like the provisional results file, filled where a type or a header is odd."""
    known = {
        "position": F.col("event_id"),
        "number": F.col("user_id") % 10,
        "status": F.col("event_type"),
        "fl_kph": F.col("value"),
        "group": F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")),
        "ecm_car_id": F.concat(F.lit("c;,"), (F.col("event_id") % 5).cast("string")),
        "extra_7": F.concat(F.lit("e"), (F.col("event_id") % 6).cast("string")),
        "driver_extra_5": F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")),
    }
    columns = [
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS["provisional_results"].fields
    ]
    return events(spark, sf_dir).where(F.col("event_type") == "click").select(*_race(), *columns)
