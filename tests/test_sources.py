"""File catalogue, CSV reading and table writing."""

import json
from datetime import datetime

import pytest

from trackline.sources import catalog, tables
from trackline.sources.schemas import SCHEMAS


def test_catalogue_is_complete():
    files = catalog.race_files("root")
    assert len(files) == 125
    assert len({f.path for f in files}) == 125
    per_circuit = {}
    for f in files:
        per_circuit[f.circuit] = per_circuit.get(f.circuit, 0) + 1
    assert per_circuit == {"barber": 20, "cota": 20, "indianapolis": 23, "road_america": 22,
                           "sebring": 20, "sonoma": 20}
    paths = {(f.circuit, f.race_number, f.kind): f.path for f in files}
    assert paths["barber", 1, "telemetry_data"] == "root/barber/R1_barber_telemetry_data.csv"
    assert paths["sonoma", 2, "lap_start"] == "root/Sonoma/Race 2/sonoma_lap_start_time_R2.csv"
    assert all("{r}" not in p for p in paths.values())


def write(root, circuit, race, kind, text):
    (entry,) = catalog.select_files(catalog.race_files(str(root)), kind, [circuit], [race])
    from pathlib import Path

    Path(entry.path).parent.mkdir(parents=True, exist_ok=True)
    Path(entry.path).write_text(text, encoding="utf-8")


def test_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path, "barber", 1, "telemetry_data",
          "vehicle_id,telemetry_value,telemetry_name,timestamp,lap,vehicle_number\n"
          "GR86-1,101.5,speed,2025-09-06T18:40:41.775Z,2,13\n"
          "GR86-1,not a number,speed,,x,13\n")
    write(tmp_path, "barber", 2, "telemetry_data",
          "timestamp,vehicle_id,lap,telemetry_name,telemetry_value,vehicle_number\n"
          "2025-09-07T18:40:41.775Z,GR86-2,5,gear,3,2\n")
    df = catalog.read_kind(spark, "telemetry_data", str(tmp_path), ["barber"])
    got = df.orderBy("race_number", "lap").collect()
    assert df.schema["lap"].dataType.simpleString() == "bigint"
    assert [(r.race_number, r.lap, r.telemetry_value, r.vehicle_id) for r in got] == [
        (1, None, None, "GR86-1"), (1, 2, 101.5, "GR86-1"), (2, 5, 3.0, "GR86-2"),
    ]
    assert got[1].timestamp == datetime(2025, 9, 6, 18, 40, 41, 775000)
    assert got[1].meta_event is None


def test_weather_times_and_semicolons(spark, tmp_path):
    write(tmp_path, "cota", 1, "weather",
          "TIME_UTC_SECONDS;TIME_UTC_STR;AIR_TEMP;TRACK_TEMP;HUMIDITY;PRESSURE;WIND_SPEED;"
          "WIND_DIRECTION;RAIN\n1757194400;9/6/2025 5:33:20 PM;85.1;110.2;55;29.1;4.5;360;0\n")
    row = catalog.read_kind(spark, "weather", str(tmp_path), ["cota"], [1]).first()
    assert row.time_utc_str == datetime(2025, 9, 6, 17, 33, 20)
    assert (row.air_temp, row.wind_direction, row.circuit) == (85.1, 360.0, "cota")


def test_odd_headers_are_renamed(spark, tmp_path):
    write(tmp_path, "sebring", 1, "provisional_results",
          "POSITION;NUMBER;GROUP;ECM Car Id;*Extra 7;DRIVER_*Extra 3;Sort Key\n1;13;A;c;e7;d3;k\n")
    row = catalog.read_kind(spark, "provisional_results", str(tmp_path), ["sebring"], [1]).first()
    assert (row.position, row.group, row.ecm_car_id, row.extra_7, row.driver_extra_3,
            row.sort_key) == (1, "A", "c", "e7", "d3", "k")


def test_unmodelled_table_is_read_as_text(spark, tmp_path):
    write(tmp_path, "indianapolis", None, "drivers_championship", "Pos,Driver,Points\n1,A,250\n")
    row = catalog.read_kind(spark, "drivers_championship", str(tmp_path)).first()
    assert (row.Pos, row.Driver, row.Points, row.race_number) == ("1", "A", "250", None)


def test_no_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        catalog.read_kind(spark, "official_results_by_class", str(tmp_path), ["cota"])


def test_table_round_trip_prunes_races(spark, tmp_path):
    rows = [("a", 1, 1.5), ("a", 2, 2.5), ("b", 1, None)]
    df = spark.createDataFrame(rows, "circuit string, race_number bigint, v double")
    for _ in range(2):
        tables.write_table(df, str(tmp_path), "facts")
    back = tables.read_table(spark, str(tmp_path), "facts")
    assert sorted((r.circuit, r.race_number, r.v) for r in back.collect()) == rows
    plan = back.where("circuit = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(circuit" in plan
    assert tables.publish_view(back, "facts_view").count() == 3
    assert spark.table("facts_view").count() == 3


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "circuit string, n int")
    tables.write_json(df, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part-*.json") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"circuit": "a", "n": 1}]


def test_plan_does_not_grow_with_files(spark, tmp_path):
    """The race of a row comes from a join on its file, so twelve files plan like two."""
    header = ",".join(SCHEMAS["lap_time"].names)
    races = [(f.circuit, f.race_number) for f in catalog.select_files(catalog.race_files(""), "lap_time")]
    for n, (circuit, race) in enumerate(races):
        write(tmp_path, circuit, race, "lap_time", f"{header}\n" + f"{'x,' * header.count(',')}x\n" * (n + 1))
    few = catalog.read_kind(spark, "lap_time", str(tmp_path), [races[0][0]])
    every = catalog.read_kind(spark, "lap_time", str(tmp_path))
    sizes = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, every)]
    assert len(races) == 12 and abs(sizes[0] - sizes[1]) < 40
    counts = {(r.circuit, r.race_number): r["count"] for r in every.groupBy("circuit", "race_number").count().collect()}
    assert counts == {race: n + 1 for n, race in enumerate(races)}
