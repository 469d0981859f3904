"""Quantiles, interval joins, histograms and modes against brute force on small fixtures."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.operators import stats
from trackline.operators.intervals import join_points_in_intervals
from trackline.functions.numbers import ordered_bits
from trackline.operators import quantiles
from trackline.operators.quantiles import percentiles_by_group

T0 = datetime(2025, 9, 6, 17)


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_both_ways(spark, limit, keys):
    rnd = random.Random(4)
    rows = [
        (rnd.choices(["hot", "cold", None], [9, 2, 1])[0],
         None if rnd.random() < 0.1 else round(rnd.gauss(0, 5), 1), rnd.random())
        for _ in range(300)
    ] + [("empty", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    outputs = {"v10": ("v", 0.1), "v50": ("v", 0.5), "v90": ("v", 0.9), "w25": ("w", 0.25)}
    got = percentiles_by_group(
        df, keys, outputs, [F.count(F.lit(1)).alias("n")], max_rows=limit
    ).select(*keys, *outputs, "n")
    con = duckdb.connect()
    con.execute("create table t(k varchar, v double, w double)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    group = "group by k" if keys else ""
    want = con.execute(
        f"select {'k,' if keys else ''} quantile_cont(v, 0.1), quantile_cont(v, 0.5),"
        f" quantile_cont(v, 0.9), quantile_cont(w, 0.25), count(*) from t {group}"
    ).fetchall()

    def rounded(rows):
        return sorted(
            (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str
        )

    assert rounded(got.collect()) == rounded(want)


def test_points_in_intervals(spark):
    rnd = random.Random(5)
    spans = []
    for i in range(80):
        start = T0 + timedelta(seconds=rnd.randrange(0, 40_000))
        length = rnd.choice([0, 5, 119, 120, 121, 1_800, 5_000, 90_000, -50])
        spans.append((rnd.choice(["a", "b"]), i, start, start + timedelta(seconds=length)))
    spans += [("a", 98, None, T0), ("a", 99, T0, None)]
    points = [(rnd.choice("aab"), j, T0 + timedelta(seconds=rnd.randrange(0, 60_000)))
              for j in range(300)]
    points += [("a", 900 + s[1], s[3]) for s in spans if s[0] == "a" and s[3]]
    points += [("b", 999, None)]
    got = join_points_in_intervals(
        spark.createDataFrame(spans, "race string, i int, s timestamp, e timestamp"),
        spark.createDataFrame(points, "race string, j int, t timestamp"),
        ["race"], "s", "e", "t",
    )
    want = [
        (i, j)
        for race, i, s, e in spans
        for r, j, t in points
        if r == race and s and e and t and s <= t <= e
    ]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4, 10)] + [(None,)], "v double")
    got = {r.bin: (r.lower, r.upper, r["count"]) for r in stats.histogram(df, "v", 5).collect()}
    assert got == {0: (0, 2, 2), 1: (2, 4, 2), 2: (4, 6, 2), 4: (8, 10, 1)}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r.bin, r["count"]) for r in stats.histogram(df, "v", 5).collect()] == [(0, 2)]


def test_mode_tie_takes_the_lower_name(spark):
    rows = [(1, "speed")] * 3 + [(1, "gear")] * 3 + [(2, "aps")]
    df = spark.createDataFrame(rows, "m int, source string")
    got = {r.m: (r.source, r.share) for r in stats.modal_value(df, ["m"], "source").collect()}
    assert got == {1: ("gear", 0.5), 2: ("aps", 1.0)}


def test_tukey_box_and_outliers(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 5, 30)], "lap int, v double")
    boxes, outliers = stats.tukey_box(df, ["lap"], "v")
    row = boxes.first()
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 5.0, 1)
    assert [r.v for r in outliers.collect()] == [30.0]


def test_quantile_class(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    got = {r.v: r.quantile_class for r in stats.quantile_class(df, "v").collect()}
    assert [got[float(v)] for v in range(11)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_unpivot_drops_missing(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "lap int, a double, b double")
    got = stats.unpivot(df, {"a": "A", "b": "B"}, "metric", "value", ["lap"]).collect()
    assert [tuple(r) for r in got] == [(1, "A", 2.0)]


def test_percentile_paths_give_the_same_doubles(spark, monkeypatch):
    """Narrowing finds what the built-in aggregate finds, also at the ends of the range of doubles."""
    rng = random.Random(11)
    odd = [None, 0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, math.inf, -math.inf, 1.7976931348623157e308, 2.0, math.nextafter(2, 0)]
    rows = [
        (rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(-1, 1), round(rng.uniform(0, 3), 1)]), rng.choice(odd))
        for _ in range(700)
    ]
    df = spark.createDataFrame(rows + [("c", 0.1, None), ("c", 0.7, None)], "k string, v double, w double")
    outputs = {f"p{int(p * 100)}": ("v", p) for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.333)}
    outputs |= {f"w{int(p * 100)}": ("w", p) for p in (0.0, 0.2, 0.5, 1.0)}
    plans = []
    store = quantiles.write_shared

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(quantiles, "write_shared", seen)
    built_in = quantiles.percentiles_by_group(df, ["k"], outputs, group_rows=1)
    narrowed = quantiles.percentiles_by_group(df, ["k"], outputs, group_rows=10**9, max_rows=100)
    want = {r.k: tuple(r) for r in built_in.select("k", *outputs).collect()}
    assert {r.k: tuple(r) for r in narrowed.select("k", *outputs).collect()} == want
    whole = quantiles.percentiles_by_group(df.select("v"), [], {"m": ("v", 0.3)}, group_rows=10**9, max_rows=100)
    assert whole.first().m == df.select(F.percentile("v", 0.3)).first()[0]
    # Rows are counted before they are shuffled, and never sorted by value.
    assert len(plans) == 10
    for plan in plans[1:5]:
        assert "partial_count(1)" in plan and "Sort [_value" not in plan and "rangepartitioning" not in plan


def test_ordered_bits(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 64, 4000, dtype=np.uint64).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    values = np.concatenate([values, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), -powers, [0.0, np.inf, -np.inf]])
    values = values[~np.isnan(values)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    size = np.abs(values).view(np.int64)
    want = np.where(values < 0, -size, size).tolist()
    assert [r[0] for r in df.select(ordered_bits(F.col("v"))).collect()] == want
    nan = spark.createDataFrame([(math.nan,), (-0.0,), (None,)], "v double").select(ordered_bits(F.col("v"))).collect()
    assert [r[0] for r in nan] == [(2047 << 52) + 1, 0, None]
