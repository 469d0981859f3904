"""Race files by circuit, race and kind, and their reader."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.sources.schemas import HEADERS, SCHEMAS


@dataclass(frozen=True)
class RaceFile:
    circuit: str
    race_number: int | None
    kind: str
    path: str


# Circuit, race (none for a season), kind and path below the data root.
FILES: tuple[tuple[str, int | None, str, str], ...] = (
    ("barber", 1, "telemetry_data", "barber/R1_barber_telemetry_data.csv"),
    ("barber", 2, "telemetry_data", "barber/R2_barber_telemetry_data.csv"),
    ("barber", 1, "lap_time", "barber/R1_barber_lap_time.csv"),
    ("barber", 2, "lap_time", "barber/R2_barber_lap_time.csv"),
    ("barber", 1, "lap_start", "barber/R1_barber_lap_start.csv"),
    ("barber", 2, "lap_start", "barber/R2_barber_lap_start.csv"),
    ("barber", 1, "lap_end", "barber/R1_barber_lap_end.csv"),
    ("barber", 2, "lap_end", "barber/R2_barber_lap_end.csv"),
    ("barber", 1, "provisional_results", "barber/03_Provisional Results_Race 1_Anonymized.CSV"),
    ("barber", 2, "provisional_results", "barber/03_Provisional Results_Race 2_Anonymized.CSV"),
    ("barber", 1, "results_by_class", "barber/05_Provisional Results by Class_Race 1_Anonymized.CSV"),
    ("barber", 2, "results_by_class", "barber/05_Provisional Results by Class_Race 2_Anonymized.CSV"),
    ("barber", 1, "analysis_endurance", "barber/23_AnalysisEnduranceWithSections_Race 1_Anonymized.CSV"),
    ("barber", 2, "analysis_endurance", "barber/23_AnalysisEnduranceWithSections_Race 2_Anonymized.CSV"),
    ("barber", 1, "weather", "barber/26_Weather_Race 1_Anonymized.CSV"),
    ("barber", 2, "weather", "barber/26_Weather_Race 2_Anonymized.CSV"),
    ("barber", 1, "best_laps", "barber/99_Best 10 Laps By Driver_Race 1_Anonymized.CSV"),
    ("barber", 2, "best_laps", "barber/99_Best 10 Laps By Driver_Race 2_Anonymized.CSV"),
    ("barber", 2, "official_results", "barber/03_Results GR Cup Race 2 Official_Anonymized.CSV"),
    ("barber", 1, "official_results_by_class", "barber/05_Results by Class GR Cup Race 1 Official_Anonymized.CSV"),
    ("cota", 1, "telemetry_data", "COTA/Race 1/R1_cota_telemetry_data.csv"),
    ("cota", 2, "telemetry_data", "COTA/Race 2/R2_cota_telemetry_data.csv"),
    ("cota", 1, "lap_time", "COTA/Race 1/COTA_lap_time_R1.csv"),
    ("cota", 2, "lap_time", "COTA/Race 2/COTA_lap_time_R2.csv"),
    ("cota", 1, "lap_start", "COTA/Race 1/COTA_lap_start_time_R1.csv"),
    ("cota", 2, "lap_start", "COTA/Race 2/COTA_lap_start_time_R2.csv"),
    ("cota", 1, "lap_end", "COTA/Race 1/COTA_lap_end_time_R1.csv"),
    ("cota", 2, "lap_end", "COTA/Race 2/COTA_lap_end_time_R2.csv"),
    ("cota", 1, "provisional_results", "COTA/Race 1/03_Provisional Results_Race 1_Anonymized.CSV"),
    ("cota", 2, "provisional_results", "COTA/Race 2/03_Provisional Results_Race 2_Anonymized.CSV"),
    ("cota", 1, "results_by_class", "COTA/Race 1/05_Provisional Results by Class_Race 1_Anonymized.CSV"),
    ("cota", 2, "results_by_class", "COTA/Race 2/05_Provisional Results by Class_Race 2_Anonymized.CSV"),
    ("cota", 1, "analysis_endurance", "COTA/Race 1/23_AnalysisEnduranceWithSections_Race 1_Anonymized.CSV"),
    ("cota", 2, "analysis_endurance", "COTA/Race 2/23_AnalysisEnduranceWithSections_Race 2_Anonymized.CSV"),
    ("cota", 1, "weather", "COTA/Race 1/26_Weather_Race 1_Anonymized.CSV"),
    ("cota", 2, "weather", "COTA/Race 2/26_Weather_Race 2_Anonymized.CSV"),
    ("cota", 1, "best_laps", "COTA/Race 1/99_Best 10 Laps By Driver_Race 1_Anonymized.CSV"),
    ("cota", 2, "best_laps", "COTA/Race 2/99_Best 10 Laps By Driver_Race 2_Anonymized.CSV"),
    ("cota", 1, "official_results", "COTA/Race 1/00_Results GR Cup Race 1 Official_Anonymized.CSV"),
    ("cota", 2, "official_results", "COTA/Race 2/00_Results GR Cup Race 2 Official_Anonymized.CSV"),
    ("indianapolis", 1, "telemetry_data", "indianapolis/R1_indianapolis_motor_speedway_telemetry.csv"),
    ("indianapolis", 2, "telemetry_data", "indianapolis/R2_indianapolis_motor_speedway_telemetry.csv"),
    ("indianapolis", 1, "lap_time", "indianapolis/R1_indianapolis_motor_speedway_lap_time.csv"),
    ("indianapolis", 2, "lap_time", "indianapolis/R2_indianapolis_motor_speedway_lap_time.csv"),
    ("indianapolis", 1, "lap_start", "indianapolis/R1_indianapolis_motor_speedway_lap_start.csv"),
    ("indianapolis", 2, "lap_start", "indianapolis/R2_indianapolis_motor_speedway_lap_start.csv"),
    ("indianapolis", 1, "lap_end", "indianapolis/R1_indianapolis_motor_speedway_lap_end.csv"),
    ("indianapolis", 2, "lap_end", "indianapolis/R2_indianapolis_motor_speedway_lap_end.csv"),
    ("indianapolis", 1, "provisional_results", "indianapolis/03_Provisional Results_Race 1.CSV"),
    ("indianapolis", 2, "provisional_results", "indianapolis/03_Provisional Results_Race 2.CSV"),
    ("indianapolis", 1, "results_by_class", "indianapolis/05_Provisional Results by Class_Race 1.CSV"),
    ("indianapolis", 2, "results_by_class", "indianapolis/05_Provisionals Results by Class_Race 2.CSV"),
    ("indianapolis", 1, "analysis_endurance", "indianapolis/23_AnalysisEnduranceWithSections_Race 1.CSV"),
    ("indianapolis", 2, "analysis_endurance", "indianapolis/23_AnalysisEnduranceWithSections_Race 2.CSV"),
    ("indianapolis", 1, "weather", "indianapolis/26_Weather_Race 1.CSV"),
    ("indianapolis", 2, "weather", "indianapolis/26_Weather_Race 2.CSV"),
    ("indianapolis", 1, "best_laps", "indianapolis/99_Best 10 Laps By Driver_Race 1.CSV"),
    ("indianapolis", 2, "best_laps", "indianapolis/99_Best 10 Laps By Driver_Race 2.CSV"),
    ("indianapolis", 1, "official_results", "indianapolis/03_GR Cup Race 1 Official Results.CSV"),
    ("indianapolis", 2, "official_results", "indianapolis/03_GR Cup Race 2 Official Results.CSV"),
    ("indianapolis", 1, "official_results_by_class", "indianapolis/05_GR Cup Race 1 Official Results by Class.CSV"),
    ("indianapolis", 2, "official_results_by_class", "indianapolis/05_GR Cup Race 2 Official Results by Class.CSV"),
    ("indianapolis", None, "drivers_championship", "indianapolis/GR Drivers Championship-1.csv"),
    ("road_america", 1, "telemetry_data", "road-america/Road America/Race 1/R1_road_america_telemetry_data.csv"),
    ("road_america", 2, "telemetry_data", "road-america/Road America/Race 2/R2_road_america_telemetry_data.csv"),
    ("road_america", 1, "lap_time", "road-america/Road America/Race 1/road_america_lap_time_R1.csv"),
    ("road_america", 2, "lap_time", "road-america/Road America/Race 2/road_america_lap_time_R2.csv"),
    ("road_america", 1, "lap_start", "road-america/Road America/Race 1/road_america_lap_start_R1.csv"),
    ("road_america", 2, "lap_start", "road-america/Road America/Race 2/road_america_lap_start_R2.csv"),
    ("road_america", 1, "lap_end", "road-america/Road America/Race 1/road_america_lap_end_R1.csv"),
    ("road_america", 2, "lap_end", "road-america/Road America/Race 2/road_america_lap_end_R2.csv"),
    ("road_america", 1, "provisional_results", "road-america/Road America/Race 1/03_Provisional Results_Race 1_Anonymized.CSV"),
    ("road_america", 2, "provisional_results", "road-america/Road America/Race 2/03_Provisional Results_Race 2_Anonymized.CSV"),
    ("road_america", 1, "results_by_class", "road-america/Road America/Race 1/05_Provisional Results by Class_Race 1_Anonymized.CSV"),
    ("road_america", 2, "results_by_class", "road-america/Road America/Race 2/05_Provisional Results by Class_Race 2_Anonymized.CSV"),
    ("road_america", 1, "analysis_endurance", "road-america/Road America/Race 1/23_AnalysisEnduranceWithSections_Race 1_Anonymized.CSV"),
    ("road_america", 2, "analysis_endurance", "road-america/Road America/Race 2/23_AnalysisEnduranceWithSections_Race 2_Anonymized.CSV"),
    ("road_america", 1, "weather", "road-america/Road America/Race 1/26_Weather_Race 1_Anonymized.CSV"),
    ("road_america", 2, "weather", "road-america/Road America/Race 2/26_Weather_Race 2_Anonymized.CSV"),
    ("road_america", 1, "best_laps", "road-america/Road America/Race 1/99_Best 10 Laps By Driver_Race 1_Anonymized.CSV"),
    ("road_america", 2, "best_laps", "road-america/Road America/Race 2/99_Best 10 Laps By Driver_Race 2_Anonymized.CSV"),
    ("road_america", 1, "official_results", "road-america/Road America/Race 1/03_Results GR Cup Race 1 Official1_Anonymized.CSV"),
    ("road_america", 2, "official_results", "road-america/Road America/Race 2/03_Results GR Cup Race 2 Official_Anonymized.CSV"),
    ("road_america", 1, "official_results_by_class", "road-america/Road America/Race 1/05_Results by Class GR Cup Race 1 Official_Anonymized.CSV"),
    ("road_america", 2, "official_results_by_class", "road-america/Road America/Race 2/05_Results by Class GR Cup Race 2 Official_Anonymized.CSV"),
    ("sebring", 1, "telemetry_data", "sebring/Sebring/Race 1/sebring_telemetry_R1.csv"),
    ("sebring", 2, "telemetry_data", "sebring/Sebring/Race 2/sebring_telemetry_R2.csv"),
    ("sebring", 1, "lap_time", "sebring/Sebring/Race 1/sebring_lap_time_R1.csv"),
    ("sebring", 2, "lap_time", "sebring/Sebring/Race 2/sebring_lap_time_R2.csv"),
    ("sebring", 1, "lap_start", "sebring/Sebring/Race 1/sebring_lap_start_time_R1.csv"),
    ("sebring", 2, "lap_start", "sebring/Sebring/Race 2/sebring_lap_start_time_R2.csv"),
    ("sebring", 1, "lap_end", "sebring/Sebring/Race 1/sebring_lap_end_time_R1.csv"),
    ("sebring", 2, "lap_end", "sebring/Sebring/Race 2/sebring_lap_end_time_R2.csv"),
    ("sebring", 1, "provisional_results", "sebring/Sebring/Race 1/03_Provisional Results_Race 1_Anonymized.CSV"),
    ("sebring", 2, "provisional_results", "sebring/Sebring/Race 2/03_Provisional Results_Race 2_Anonymized.CSV"),
    ("sebring", 1, "results_by_class", "sebring/Sebring/Race 1/05_Provisional Results by Class_Race 1_Anonymized.CSV"),
    ("sebring", 2, "results_by_class", "sebring/Sebring/Race 2/05_Provisional Results by Class_Race 2_Anonymized.CSV"),
    ("sebring", 1, "analysis_endurance", "sebring/Sebring/Race 1/23_AnalysisEnduranceWithSections_Race 1_Anonymized.CSV"),
    ("sebring", 2, "analysis_endurance", "sebring/Sebring/Race 2/23_AnalysisEnduranceWithSections_Race 2_Anonymized.CSV"),
    ("sebring", 1, "weather", "sebring/Sebring/Race 1/26_Weather_Race 1_Anonymized.CSV"),
    ("sebring", 2, "weather", "sebring/Sebring/Race 2/26_Weather_Race 2_Anonymized.CSV"),
    ("sebring", 1, "best_laps", "sebring/Sebring/Race 1/99_Best 10 Laps By Driver_Race 1_Anonymized.CSV"),
    ("sebring", 2, "best_laps", "sebring/Sebring/Race 2/99_Best 10 Laps By Driver_Race 2_Anonymized.CSV"),
    ("sebring", 1, "official_results", "sebring/Sebring/Race 1/00_Results GR Race 1 Official_Anonymized.CSV"),
    ("sebring", 2, "official_results", "sebring/Sebring/Race 2/00_Results GR Race 2 Official_Anonymized.CSV"),
    ("sonoma", 1, "telemetry_data", "Sonoma/Race 1/R1_sonoma_telemetry_data.csv"),
    ("sonoma", 2, "telemetry_data", "Sonoma/Race 2/R2_sonoma_telemetry_data.csv"),
    ("sonoma", 1, "lap_time", "Sonoma/Race 1/sonoma_lap_time_R1.csv"),
    ("sonoma", 2, "lap_time", "Sonoma/Race 2/sonoma_lap_time_R2.csv"),
    ("sonoma", 1, "lap_start", "Sonoma/Race 1/sonoma_lap_start_time_R1.csv"),
    ("sonoma", 2, "lap_start", "Sonoma/Race 2/sonoma_lap_start_time_R2.csv"),
    ("sonoma", 1, "lap_end", "Sonoma/Race 1/sonoma_lap_end_time_R1.csv"),
    ("sonoma", 2, "lap_end", "Sonoma/Race 2/sonoma_lap_end_time_R2.csv"),
    ("sonoma", 1, "provisional_results", "Sonoma/Race 1/03_Provisional Results_Race 1_Anonymized.CSV"),
    ("sonoma", 2, "provisional_results", "Sonoma/Race 2/03_Provisional Results_Race 2_Anonymized.CSV"),
    ("sonoma", 1, "results_by_class", "Sonoma/Race 1/05_Provisional Results by Class_Race 1_Anonymized.CSV"),
    ("sonoma", 2, "results_by_class", "Sonoma/Race 2/05_Provisional Results by Class_Race 2_Anonymized.CSV"),
    ("sonoma", 1, "analysis_endurance", "Sonoma/Race 1/23_AnalysisEnduranceWithSections_Race 1_Anonymized.CSV"),
    ("sonoma", 2, "analysis_endurance", "Sonoma/Race 2/23_AnalysisEnduranceWithSections_Race 2_Anonymized.CSV"),
    ("sonoma", 1, "weather", "Sonoma/Race 1/26_Weather_Race 1_Anonymized.CSV"),
    ("sonoma", 2, "weather", "Sonoma/Race 2/26_Weather_Race 2_Anonymized.CSV"),
    ("sonoma", 1, "best_laps", "Sonoma/Race 1/99_Best 10 Laps By Driver_Race 1_Anonymized.CSV"),
    ("sonoma", 2, "best_laps", "Sonoma/Race 2/99_Best 10 Laps By Driver_Race 2_Anonymized.CSV"),
    ("sonoma", 1, "official_results", "Sonoma/Race 1/00_Results GR Cup Race 1 Official_Anonymized.CSV"),
    ("sonoma", 2, "official_results", "Sonoma/Race 2/00_Results GR Cup Race 2 Official_Anonymized.CSV"),
)

WEATHER_TIME = "M/d/yyyy h:mm:ss a"
_DELIMITERS = (",", ";", "\t", "|")
#: Headers read at a time.
HEADER_THREADS = 16


def race_files(root: str = "data_files") -> list[RaceFile]:
    """Every known race file below ``root``."""
    return [RaceFile(circuit, race, kind, f"{root}/{path}") for circuit, race, kind, path in FILES]


def _one_slash(path: str) -> str:
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", path)


def select_files(
    files: list[RaceFile],
    kind: str,
    circuits: list[str] | None = None,
    races: list[int] | None = None,
) -> list[RaceFile]:
    return [
        f
        for f in files
        if f.kind == kind
        and (circuits is None or f.circuit in circuits)
        and (races is None or f.race_number in races)
    ]


def _located(spark: SparkSession, path: str) -> tuple[str, str, list[str]]:
    """The qualified path of a file or folder of part files, its first line, and its parts.

    Read through the file system itself: one line per file needs no Spark job.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = fs.makeQualified(place)
    parts = [place]
    if fs.getFileStatus(place).isDirectory():
        found = (s for s in fs.listStatus(place) if s.getPath().getName()[0] not in "_." and s.getLen())
        parts = sorted((s.getPath() for s in found), key=lambda p: p.getName())
    if not parts:
        return place.toString(), "", []
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(parts[0]), "UTF-8"))
    try:
        return place.toString(), (reader.readLine() or "").lstrip("\ufeff"), [p.toString() for p in parts]
    finally:
        reader.close()


def _plain(name: str) -> str:
    return name.lstrip("\ufeff").strip().strip('"').strip().lower()


def _delimiter(header: str) -> str:
    """The sign that divides a header, counted outside quotes."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(_DELIMITERS, key=bare.count)


def _typed(text: Column, kind: T.DataType) -> Column:
    """Text in the wanted type, NULL if it does not fit. Whole numbers may be written with decimals."""
    if isinstance(kind, T.StringType):
        return text
    value = text.try_cast(kind)
    if isinstance(kind, T.LongType):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast("bigint")))
    if isinstance(kind, T.TimestampType):
        value = F.coalesce(value, F.try_to_timestamp(F.trim(text), F.lit(WEATHER_TIME)))
    return value


def _read(spark: SparkSession, paths: list[str], header: str, schema: T.StructType | None) -> DataFrame:
    """Files with one header: typed columns, the ``_file`` of each row, and ``_unread`` columns of it."""
    raw = (
        spark.read.option("header", True)
        .option("sep", _delimiter(header))
        .option("nullValue", "")
        .csv(paths)
    )
    file = F.col("_metadata.file_path").alias("_file")
    if schema is None:
        names = [F.col(f"`{c}`").alias(c.strip()) for c in raw.columns]
        return raw.select(*names, file, F.array().cast("array<string>").alias("_unread"))
    present = {_plain(c): c for c in raw.columns}
    columns, unread = [], []
    for field in schema.fields:
        source = present.get(_plain(HEADERS.get(field.name, field.name)))
        if source is None:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{source}`")
        value = _typed(text, field.dataType)
        columns.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            bad = value.isNull() & (F.trim(text) != "")
            unread.append(F.when(bad, F.concat(F.lit(f"{field.name}="), text)))
    return raw.select(*columns, file, F.array_compact(F.array(*unread)).cast("array<string>").alias("_unread"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """Read one file by header name, whatever its column order, delimiter or header padding.

    Text is cast by ``schema`` with NULL for what does not fit; no type is guessed, and text values
    stay as they stand. Without a schema all columns stay text.
    """
    place, header, _ = _located(spark, path)
    return _read(spark, [place], header, schema).drop("_file", "_unread")


def read_kind(
    spark: SparkSession,
    kind: str,
    root: str = "data_files",
    circuits: list[str] | None = None,
    races: list[int] | None = None,
    strict: bool = False,
    report: bool = False,
) -> DataFrame:
    """All files of a kind as one table, with the circuit and race each row came from.

    Files with the same header are read together, and a join on the path of each row's file tells
    its race, so the plan grows with the number of different headers only. Headers are read by
    several threads at a time. Values that do not fit their column are NULL; ``report`` keeps a column ``_unread``
    that names them (``unread_values`` counts them), and ``strict`` fails on the first one.
    """
    schema = SCHEMAS.get(kind)
    files = select_files(race_files(root), kind, circuits, races)
    if not files:
        raise ValueError(f"no {kind} file for circuits {circuits}, races {races}")
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        located = list(pool.map(lambda file: _located(spark, file.path), files))
    groups: dict[str, list[str]] = {}
    origins = []
    for file, (place, header, found) in zip(files, located):
        groups.setdefault(header, []).append(place)
        origins += [(_one_slash(part), file.circuit, file.race_number) for part in found]
    origin = spark.createDataFrame(origins, "_path string, circuit string, race_number bigint")
    # Both paths in one form: decoded, and with one slash after the scheme.
    path = F.regexp_replace(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")
    parts = []
    for header, places in groups.items():
        rows = _read(spark, places, header, schema)
        columns = rows.drop("_file", "_unread").columns
        rows = rows.withColumn("_path", path).join(origin, "_path", "left")
        parts.append(rows.select(*columns, origin["circuit"], origin["race_number"], "_unread"))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"{kind}: "), F.array_join("_unread", ", ")))
        table = table.withColumn("_unread", F.when(F.size("_unread") > 0, wrong.cast("array<string>")).otherwise(F.col("_unread")))
        table = table.where(F.size("_unread") == 0)
    return table if report else table.drop("_unread")


def unread_values(table: DataFrame) -> DataFrame:
    """Number of values per file column that did not fit, from a table read with ``report``."""
    return (
        table.select("circuit", "race_number", F.explode("_unread").alias("value"))
        .groupBy("circuit", "race_number", F.substring_index("value", "=", 1).alias("column"))
        .agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("example"))
    )
