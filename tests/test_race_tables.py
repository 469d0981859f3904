"""Hand fixtures for the race tables, one per trap."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackline.functions import weather as W
from trackline.functions.filters import apply_filters, ordered_range
from trackline.functions.times import local_time, seconds_between, utc_time
from trackline.operators.signals import pair_channels
from trackline.plans import consistency, laps, pages, telemetry, track, weather
from trackline.sources.schemas import SCHEMAS

T = datetime(2025, 9, 6, 17, 0, 0)
CONTEXT = {
    "circuit": "north", "race_number": 1, "vehicle_id": "V1", "vehicle_number": 7, "lap": 1,
    "outing": 0, "meta_event": "E", "meta_session": "R1", "meta_source": "s", "meta_time": T,
    "original_vehicle_id": "U1", "expire_at": T,
}
RACE = "circuit string, race_number bigint, "


def at(seconds):
    return T + timedelta(seconds=seconds)


def rows_of(spark, kind, rows, **defaults):
    schema = RACE + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[kind])
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(
        [tuple({**CONTEXT, **defaults, **r}.get(n) for n in names) for r in rows], schema
    )


def signal(spark, rows, name="speed", **defaults):
    return rows_of(
        spark, "telemetry_data",
        [{"timestamp": at(t), "telemetry_value": v, **(x[0] if x else {})} for t, v, *x in rows],
        telemetry_name=name, **defaults,
    )


def test_value_change_around_null(spark):
    df = signal(spark, [(1, 10.0), (2, 10.0), (3, None), (4, 10.0), (5, 20.0)])
    for slots in (telemetry.TIME_SLOTS, (1_000_000,), (2_000_000,)):
        got = telemetry.signal_periods(df, ["speed"], slots).orderBy("start_timestamp").collect()
        assert [r.value for r in got] == [10.0, None, 10.0, 20.0]
        assert [r.start_timestamp for r in got] == [at(1), at(3), at(4), at(5)]
        assert [r.end_timestamp for r in got] == [at(3), at(4), at(5), None]
        assert [r.value_change for r in got] == [10.0, None, 10.0, 10.0]


def test_paired_null(spark):
    x = signal(spark, [(1, None), (2, 1.0)], "accx_can")
    y = signal(spark, [(1, None), (3, 5.0)], "accy_can")
    got = telemetry.acc_periods(x.unionByName(y)).orderBy("acc_start_timestamp").collect()
    assert [(r.accx_can, r.accy_can) for r in got] == [(None, None), (1.0, None), (1.0, 5.0)]
    assert [r.acc_end_timestamp for r in got] == [at(2), at(3), None]
    assert [r.accx_change for r in got] == [None, 1.0, 0.0]
    assert [r.vehicle_number for r in got] == [7, 7, None]


def test_pairing_takes_the_latest_metadata(spark):
    x = signal(spark, [(1, 3.0, {"meta_time": at(9)}), (1, 2.0, {"meta_time": at(8)}),
                       (1, 8.0, {"meta_time": None})], "accx_can")
    got = telemetry.acc_pairs(x).collect()
    assert [(r.accx_can, r.accy_can, r.meta_time) for r in got] == [(3.0, None, at(9))]


def test_pairing_keeps_unmatchable_keys_apart(spark):
    x = signal(spark, [(1, 1.0)], "accx_can", circuit=None)
    y = signal(spark, [(1, 2.0)], "accy_can", circuit=None)
    got = pair_channels(
        x.unionByName(y), ("accx_can", "accx_can", {}), ("accy_can", "accy_can", {})
    )
    assert sorted([(r.accx_can, r.accy_can) for r in got.collect()], key=str) == [
        (1.0, None), (None, 2.0),
    ]


def test_position_periods_merge_repeats(spark):
    lon = signal(spark, [(1, 5.0), (2, 5.0), (3, 6.0)], "VBOX_Long_Minutes")
    lat = signal(spark, [(1, 9.0), (4, 9.0)], "VBOX_Lat_Min")
    got = telemetry.position_periods(lon.unionByName(lat)).orderBy("position_start_timestamp")
    got = [(r.vbox_long_minutes, r.vbox_lat_minutes, r.position_start_timestamp,
            r.position_end_timestamp) for r in got.collect()]
    assert got == [(5.0, 9.0, at(1), at(3)), (6.0, 9.0, at(3), None)]


def single_tie(spark):
    return signal(spark, [(1, 4.0, {"meta_time": at(2)}), (1, 3.0, {"meta_time": at(1)}),
                          (2, 4.0)])


def test_single_signal_tie_keeps_both_rows(spark):
    got = telemetry.signal_periods(single_tie(spark), ["speed"]).collect()
    got = {r.value: (r.start_timestamp, r.end_timestamp) for r in got}
    assert got == {3.0: (at(1), at(1)), 4.0: (at(1), None)}


def timeline_of(spark, df, slots=telemetry.TIME_SLOTS):
    return telemetry.timeline(
        telemetry.signal_periods(df, slots=slots), telemetry.position_periods(df, slots),
        telemetry.acc_periods(df, slots), slots,
    )


def test_open_end_is_carried_from_the_period_before(spark):
    df = signal(spark, [(1, 10.0), (5, 20.0)])
    got = timeline_of(spark, df).orderBy("event_timestamp").collect()
    assert [r.speed_end_timestamp for r in got] == [at(5), at(5)]


@pytest.mark.parametrize("slots", [telemetry.TIME_SLOTS, (1_000_000,)])
def test_ties_on_the_timeline_follow_the_source_name(spark, slots):
    df = signal(spark, [(1, 10.0), (9, 11.0)]).unionByName(
        signal(spark, [(1, 3.0), (9, 4.0)], "gear")
    )
    got = timeline_of(spark, df, slots).orderBy("event_timestamp", "event_source").collect()
    assert [(r.event_source, r.gear, r.speed) for r in got] == [
        ("gear", 3.0, None), ("speed", 3.0, 10.0), ("gear", 4.0, 10.0), ("speed", 4.0, 11.0),
    ]


def test_period_invariants_hold_for_any_partitioning(spark):
    rows = [(i * 7 % 50, float(i * i % 3)) for i in range(50)]
    df = signal(spark, rows)
    results = []
    for n, slots in ((1, telemetry.TIME_SLOTS), (7, (5_000_000,)), (64, (1_000_000,))):
        got = telemetry.signal_periods(df.repartition(n), ["speed"], slots)
        results.append(sorted((r.start_timestamp, r.end_timestamp, r.value)
                              for r in got.collect() if r.end_timestamp))
        for a, b in zip(results[-1], results[-1][1:]):
            assert a[1] == b[0] and a[2] != b[2]
    assert results[0] == results[1] == results[2]


# Laps


def lap_rows(spark, kind, rows):
    return rows_of(spark, kind, [{"lap": lap, "timestamp": t, **extra} for lap, t, extra in rows])


def reading(spark, rows):
    return rows_of(
        spark, "weather",
        [{"time_utc_str": t, "humidity": h, "air_temp": 68.0} for t, h in rows],
    )


def test_lap_dedup(spark):
    starts = lap_rows(spark, "lap_start", [(1, at(5), {}), (1, at(3), {}), (2, None, {})])
    ends = lap_rows(spark, "lap_end", [(1, at(90), {}), (1, at(95), {}), (2, None, {})])
    assert [r.lap_start_timestamp_utc for r in laps.lap_starts(starts).collect()] == [at(3)]
    got = {r.lap: r.lap_end_timestamp_utc for r in laps.lap_ends(ends).collect()}
    assert got == {1: at(95), 2: None}
    assert laps.lap_starts(starts).first().lap_start_timestamp == T - timedelta(hours=5) + timedelta(
        seconds=3
    )


def facts(spark, starts, ends, readings=()):
    return laps.lap_facts(
        lap_rows(spark, "lap_start", starts), lap_rows(spark, "lap_end", ends),
        reading(spark, readings),
    )


def test_missing_start_is_imputed_without_a_duration(spark):
    got = facts(spark, [(1, at(0), {})], [(1, at(90), {}), (2, at(180), {})])
    got = {r.lap: r for r in got.collect()}
    assert got[1].lap_duration_seconds == 90
    assert got[1].lap_duration_minutes == timedelta(seconds=90)
    assert got[2].lap_start_timestamp_utc == at(90)
    assert got[2].lap_duration_seconds is None


def test_missing_end_takes_the_next_start(spark):
    got = facts(spark, [(1, at(0), {}), (2, at(100), {})], [])
    got = {r.lap: r for r in got.collect()}
    assert got[1].lap_end_timestamp_utc == at(100)
    assert got[2].lap_end_timestamp_utc is None


def test_laps_without_outing_do_not_match(spark):
    none = {"outing": None}
    got = facts(spark, [(1, at(0), none)], [(1, at(90), none)], [(at(10), 50.0)]).collect()
    assert len(got) == 2
    assert all(r.lap_mean_humidity_percentage is None for r in got)


def test_reading_on_the_border_counts_in_both_laps(spark):
    got = facts(
        spark, [(1, at(0), {}), (2, at(90), {})], [(1, at(90), {}), (2, at(180), {})],
        [(at(90), 50.0), (at(100), None), (at(150), 40.0)],
    )
    got = {r.lap: r for r in got.collect()}
    assert got[1].lap_mean_humidity_percentage == 50.0
    assert got[2].lap_mean_humidity_percentage == 45.0
    assert got[2].lap_median_air_temp_celsius == 20.0


def test_seconds_count_boundaries(spark):
    df = spark.createDataFrame(
        [(T.replace(microsecond=900_000), at(2).replace(microsecond=100_000))],
        "a timestamp, b timestamp",
    )
    assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 2


def test_zone_conversion_is_reversible(spark):
    df = spark.createDataFrame([(T,)], "a timestamp")
    back = df.select(local_time(F.col("a")).alias("l"), utc_time(local_time(F.col("a"))).alias("u"))
    assert tuple(back.first()) == (T - timedelta(hours=5), T)


def test_best_lap_tie_takes_the_lower_lap(spark):
    starts = [(lap, at(lap * 1000), {}) for lap in (4, 7, 9)]
    ends = [(4, at(4090), {}), (7, at(7090), {}), (9, at(9099), {})]
    got = pages.best_lap_per_driver(facts(spark, starts, ends)).collect()
    assert [(r.best_lap, r.best_lap_duration_seconds) for r in got] == [(4, 90)]


def test_best_laps_stay_wide(spark):
    raw = rows_of(spark, "best_laps", [{"number": 3, "bestlap_1": "1:38.1", "average": "1:39"},
                                       {"number": None}])
    got = laps.best_laps(raw).collect()
    assert [(r.vehicle_number, r.bestlap_1_elapsed_time, r.average_best_lap) for r in got] == [
        (3, "1:38.1", "1:39")
    ]


# Weather


def column_of(spark, values, build, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_compass(spark):
    got = column_of(spark, [0.0, 22.4, 22.5, 337.4, 337.5, 360.0, None],
                    lambda v: W.compass_label(W.normal_degrees(v)))
    assert got == ["North", "North", "North East", "North West", "North", "North", None]


def test_speed_bands(spark):
    assert column_of(spark, [None, 4.9, 5.0, 19.9, 20.0], W.speed_band) == [
        None, "00-05 mph", "05-10 mph", "15-20 mph", "20+ mph",
    ]


def test_rose_index_and_label(spark):
    values = [0.0, 22.4, 22.5, 359.0, 360.0]
    assert column_of(spark, values, W.rose_index) == [0, 0, 1, 15, 0]
    assert column_of(spark, values, lambda v: W.rose_label(W.rose_index(v)))[2] == "North-Northeast"
    assert column_of(spark, [-1, 16, 3], W.rose_label, "bigint") == [None, None, "East-Northeast"]


def test_units(spark):
    assert column_of(spark, [212.0], W.celsius) == [100.0]
    assert column_of(spark, [10.0], W.kph) == [16.09]
    assert column_of(spark, [30.0], W.millibar) == [pytest.approx(1105.8)]


def test_wind_vector_points_downwind(spark):
    df = spark.createDataFrame([(0.0, 10.0), (90.0, 10.0)], "d double, s double")
    got = df.select(*[c.alias(n) for n, c in W.wind_vector(F.col("d"), F.col("s")).items()])
    north, east = got.collect()
    assert (north.flow_direction_degrees, north.arrow_rotation) == (180.0, -90.0)
    assert north.v_component_mph == pytest.approx(-10) and east.u_component_mph == pytest.approx(-10)


def wind_table(spark):
    rows = [{"time_utc_seconds": i, "time_utc_str": at(i), "wind_speed": s, "wind_direction": d}
            for i, (s, d) in enumerate([(3.0, 360.0), (7.0, 10.0), (None, 200.0), (21.0, None)])]
    return weather.wind_facts(rows_of(spark, "weather", rows))


def test_wind_facts_keep_either_side(spark):
    got = sorted(wind_table(spark).collect(), key=lambda r: r.time_utc)
    assert [r.wind_direction_label for r in got] == ["North", "North", "South", None]
    assert [r.wind_speed_band_mph for r in got] == ["00-05 mph", "05-10 mph", None, "20+ mph"]


def test_readings_without_a_second_do_not_match(spark):
    rows = [{"time_utc_seconds": None, "wind_speed": 3.0, "wind_direction": 90.0}]
    got = weather.wind_facts(rows_of(spark, "weather", rows)).collect()
    assert sorted([(r.wind_speed_mph, r.wind_direction_degrees) for r in got], key=str) == [
        (3.0, None), (None, 90.0),
    ]


def test_wind_rose_without_band_column(spark):
    table = wind_table(spark)
    with_band = sorted(map(tuple, pages.wind_rose(table).collect()))
    assert with_band == sorted(
        map(tuple, pages.wind_rose(table.drop("wind_speed_band_mph")).collect())
    )
    stack = pages.wind_rose_stack(pages.wind_rose(table)).collect()
    assert sum(r.percentage for r in stack) == pytest.approx(100)
    assert [(r.inner_value, r.outer_value) for r in stack] == [(0, 50), (50, 100)]
    assert stack[0].radial_max == pytest.approx(110)


# Track


def test_sector_spine(spark):
    spine = track.sector_spine(track.sector_lengths(spark))
    counts = {r.sector_number: r["count"] for r in spine.groupBy("sector_number").count().collect()}
    assert counts == {1: 1030, 2: 1580, 3: 1065}
    first = spine.where("meter_position_m = 1029").first()
    assert first.sector_name == "Sector 1" and float(first.sector_length_m) == 1029.0048
    edge = {r.meter_position_m: r.sector_number
            for r in spine.where("meter_position_m in (1029, 1030, 3674, 3675)").collect()}
    assert edge == {1029: 1, 1030: 2, 3674: 3}


def driven(spark, distances):
    """Timeline rows of one lap at the given distances, two events per distance."""
    rows = [
        ("north", 1, "V1", 7, at(i + j / 2), source, 1, 0, d, 1.0)
        for i, d in enumerate(distances)
        for j, source in enumerate(("laptrigger", "gear"))
    ]
    df = spark.createDataFrame(
        rows, RACE + "vehicle_id string, vehicle_number bigint, event_timestamp timestamp,"
        " event_source string, lap bigint, outing bigint, laptrigger_lapdist_dls double,"
        " speed double")
    measures = ("gear", "aps", "steering_angle", "front_brake_pressure", "rear_brake_pressure")
    return df.withColumns({m: F.lit(None).cast("double") for m in measures})


def placed_fixture(spark):
    rows = driven(spark, [10.0 * i for i in range(5)])
    return track.on_track(rows, track.sector_spine(track.sector_lengths(spark)))


def test_distance_beyond_the_spine_keeps_its_row(spark):
    spine = track.sector_spine(track.sector_lengths(spark))
    for limit in (track.MAX_BROADCAST_ROWS, 10):
        got = track.on_track(driven(spark, [3675.0, 12.9]), spine, limit)
        got = got.orderBy("event_timestamp").collect()
        assert [(r.meter_position_m, r.sector_number) for r in got] == [
            (None, None), (None, None), (12, 1), (12, 1),
        ]


def test_sectors_of_several_circuits_stay_apart(spark):
    lengths = spark.createDataFrame(
        [("north", 1, "A", 5.0), ("south", 1, "B", 20.0)],
        "circuit string, sector_number int, sector_name string, length_m double",
    ).withColumn("length_m", F.col("length_m").cast("decimal(18,4)"))
    got = track.on_track(driven(spark, [4.0]), track.sector_spine(lengths)).collect()
    assert [r.sector_name for r in got] == ["A", "A"]


@pytest.mark.parametrize("slots,limit", [((1000.0,), 10**6), ((1.0,), 3), ((5.0,), 1)])
def test_event_order_in_lap(spark, slots, limit):
    placed = placed_fixture(spark)
    got = consistency.event_order(placed, slots, limit)
    got = sorted((r.event_order, r.laptrigger_lapdist_dls, r.event_timestamp, r.events_per_lap)
                 for r in got.collect())
    assert [g[0] for g in got] == list(range(1, 11))
    assert [g[1:3] for g in got] == sorted(g[1:3] for g in got)
    assert {g[3] for g in got} == {10}


# Track map


def points(spark, speeds):
    rows = [("V1", at(i), "speed", 0.0 + i, 0.0, s) for i, s in enumerate(speeds)]
    return spark.createDataFrame(
        rows, "vehicle_id string, event_timestamp timestamp, event_source string,"
        " vbox_long_minutes double, vbox_lat_minutes double, speed double")


@pytest.mark.parametrize("slots", [telemetry.TIME_SLOTS, (4_000_000,)])
def test_lookback(spark, slots):
    df = points(spark, [100.0 - i / 3 for i in range(31)])
    got = pages.braking_points(df, slots=slots).collect()
    assert len(got) == 1
    assert got[0].speed_drop == pytest.approx(10)
    assert got[0].deceleration_rate == pytest.approx(10 / 30)


@pytest.mark.parametrize("slots", [telemetry.TIME_SLOTS, (3_000_000,)])
def test_cumulative_distance_restarts_per_vehicle(spark, slots):
    one = points(spark, [1.0] * 8)
    two = one.withColumn("vehicle_id", F.lit("V2"))
    got = pages.cumulative_distance(one.unionByName(two), slots)
    got = sorted((r.vehicle_id, r.distance) for r in got.collect())
    assert got == [(v, 60.0 * i) for v in ("V1", "V2") for i in range(8)]


def test_drives_of_two_races_are_two_tracks(spark):
    one = points(spark, [1.0] * 4).withColumns({"circuit": F.lit("c"), "race_number": F.lit(1), "lap": F.lit(3)})
    two = one.withColumn("race_number", F.lit(2))
    got = pages.cumulative_distance(one.unionByName(two)).collect()
    assert sorted((r.race_number, r.distance) for r in got) == [(n, 60.0 * i) for n in (1, 2) for i in range(4)]


def test_vehicle_statistics_ignore_missing_speed(spark):
    row = pages.vehicle_statistics(points(spark, [10.0, None, 20.0])).first()
    assert (row.avg_speed, row.min_speed, row.data_points) == (15.0, 10.0, 3)


def test_braking_bands(spark):
    df = spark.createDataFrame([(9.0,), (20.0,), (39.9,), (40.0,)], "speed_drop double")
    row = pages.braking_bands(df).first()
    assert (row.light, row.medium, row.heavy, row.color_scale) == (1, 2, 1, "linear")


# Filters


def test_filters_and_ranges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("o'c", 3)], "circuit string, lap int")
    assert apply_filters(df, {"circuit": "All", "lap": None}).count() == 3
    assert apply_filters(df, {"circuit": "o'c"}).count() == 1
    assert apply_filters(df, {"circuit": ["a", "b"], "lap": 2}).count() == 1
    assert ordered_range(90, -5, 10, 50) == (10, 50)
    assert ordered_range(None, 20, 10, 50) == (10, 20)
    assert ordered_range(None, None, 0, 0) == (0, 1)
