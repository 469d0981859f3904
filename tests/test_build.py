"""From race files to published tables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackline.plans import build
from trackline.sources.catalog import race_files, select_files
from trackline.sources.schemas import SCHEMAS
from trackline.sources.tables import Versions, read_table, write_table

T = datetime(2025, 9, 6, 17)


def stamp(seconds):
    return (T + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def put(root, kind, rows):
    from pathlib import Path

    (file,) = select_files(race_files(str(root)), kind, ["barber"], [1])
    names = SCHEMAS[kind].names
    lines = [",".join(names)] + [",".join(str(r.get(n, "")) for n in names) for r in rows]
    path = Path(file.path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_full_refresh(spark, tmp_path):
    root, out = tmp_path / "files", str(tmp_path / "tables")
    car = {"vehicle_id": "GR86-1", "vehicle_number": 13, "outing": 0, "meta_time": stamp(0)}
    signals = []
    for i in range(20):
        for name, value in (("speed", 100 + i // 4), ("gear", 3), ("Laptrigger_lapdist_dls", 300 * i),
                            ("accx_can", i // 2), ("accy_can", 1), ("VBOX_Lat_Min", 33 + i),
                            ("VBOX_Long_Minutes", -86)):
            signals.append({**car, "lap": 1 + i // 10, "timestamp": stamp(i),
                            "telemetry_name": name, "telemetry_value": value})
    put(root, "telemetry_data", signals)
    put(root, "lap_start", [{**car, "lap": n, "timestamp": stamp(10 * n)} for n in (1, 2)])
    put(root, "lap_end", [{**car, "lap": n, "timestamp": stamp(10 * n + 9)} for n in (1, 2)])
    put(root, "lap_time", [{**car, "lap": 1, "timestamp": stamp(19)}])
    put(root, "best_laps", [{"number": 13, "bestlap_1": "1:38.1"}])
    put(root, "weather", [{"time_utc_seconds": 1, "time_utc_str": "9/6/2025 5:00:12 PM",
                           "air_temp": 77, "humidity": 50, "wind_speed": 4, "wind_direction": 90}])
    for _ in range(2):
        build.refresh(spark, str(root), out, ["barber"], [1])
    names = build.publish(spark, out)
    assert len(names) == 11 + 12 + 8 + 6
    assert {"fact_speed", "fact_rear_brake_pressure", "int_telemetry_data_vbox_lat_minutes",
            "int_telemetry_data_laptrigger_lapdist_dls", "int_weather_pressure",
            "fact_telemetry_data"} <= set(names)
    count = {n: spark.table(n).count() for n in names}
    assert count["int_telemetry_data_speed"] == 20
    assert count["fact_speed"] == 5 and count["fact_gear"] == 1
    assert count["fact_acc"] == 10 and count["fact_position"] == 20
    assert count["fact_telemetry_data"] == 5 + 1 + 20 + 10 + 20
    assert count["dim_track_sectors"] == 3675
    row = spark.sql("SELECT * FROM fact_laps WHERE lap = 1").first()
    assert (row.lap_duration_seconds, row.lap_mean_air_temp_celsius) == (9, 25.0)
    assert spark.table("fact_wind").first().wind_direction_label == "East"
    signal = spark.table("int_telemetry_data_gear").where(F.col("circuit") == "barber")
    plan = signal._jdf.queryExecution().executedPlan().toString()
    assert "telemetry_name" in plan.split("PartitionFilters:")[1].split("]")[0]




def test_raw_views(spark, tmp_path):
    kinds = {f.kind for f in race_files("x") if f.circuit == "barber" and f.race_number == 1}
    for kind in kinds:
        put(tmp_path, kind, [{}])
    names = build.publish_raw(spark, str(tmp_path), ["barber"], [1])
    assert len(names) == 10 and "raw_barber_race_1_best_laps" in names
    assert spark.table("raw_barber_race_1_weather").columns == SCHEMAS["weather"].names


def test_readers_see_one_version(spark, tmp_path, monkeypatch):
    """Views stay as they are during and after a refresh, until they are published again."""
    out = str(tmp_path / "tables")
    versions = Versions(spark, out)
    with pytest.raises(FileNotFoundError):
        versions.current()
    seen = []

    def refresh(rows):
        version = versions.new()
        for name in ("fact_laps", "fact_wind"):
            write_table(spark.range(rows), version, name, ())
            seen.append(current())
        versions.publish(version)

    def current():
        try:
            return {name: read_table(spark, versions.current(), name).count() for name in ("fact_laps", "fact_wind")}
        except FileNotFoundError:
            return None

    monkeypatch.setattr(build, "STORED", ("fact_laps", "fact_wind"))
    monkeypatch.setattr(build.telemetry, "SIGNAL_TABLES", {})
    monkeypatch.setattr(build.telemetry, "SINGLE_SIGNALS", {})
    monkeypatch.setattr(build.weather, "QUANTITIES", {})
    refresh(3)
    assert build.publish(spark, out) == ["fact_laps", "fact_wind"]
    refresh(5)
    assert spark.table("fact_laps").count() == spark.table("fact_wind").count() == 3
    assert seen == [None, None, {"fact_laps": 3, "fact_wind": 3}, {"fact_laps": 3, "fact_wind": 3}]
    build.publish(spark, out)
    assert spark.table("fact_laps").count() == 5
    refresh(7)
    versions.remove_old(keep=2)
    assert spark.table("fact_laps").count() == 5 and current() == {"fact_laps": 7, "fact_wind": 7}
    assert len(os.listdir(f"{out}/_versions")) == 2
    unfinished = versions.new()
    write_table(spark.range(9), unfinished, "fact_laps", ())
    assert current() == {"fact_laps": 7, "fact_wind": 7}
