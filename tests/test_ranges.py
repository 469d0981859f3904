"""Statistics of the points in each interval against a plain loop."""

import math
import random
import tracemalloc
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.functions.exact import exact_mean, exact_sum
from trackline.operators import ranges
from trackline.operators.intervals import MINUTE

START = datetime(2024, 5, 1)
LEVELS = (2 * MINUTE, 30 * MINUTE)
ON = ["circuit", "race"]


def made(seed, n_points=160, n_spans=25):
    rng = random.Random(seed)

    def moment(minutes):
        return START + timedelta(microseconds=rng.randrange(minutes * MINUTE))

    points = []
    for _ in range(n_points):
        a = rng.choice([None, 0.0, -0.0, rng.gauss(0, 5), round(rng.uniform(-3, 3), 1), 1e300, -1e-300])
        a = a if a is None or abs(a) < 1e9 else a / 1e295
        points.append((rng.choice(["x", "y", None]), 1, rng.choice([moment(240), moment(5), None]), a, rng.choice([None, float("nan"), rng.random()])))
    spans = []
    for i in range(n_spans):
        a = moment(240)
        b = rng.choice([a, a + timedelta(seconds=rng.randrange(90)), a + timedelta(minutes=rng.randrange(200)), None, a - timedelta(1)])
        spans.append((rng.choice(["x", "y", None]), 1, i, a, b))
    spans.append(("x", 1, n_spans, START - timedelta(1), START + timedelta(3)))
    return points, spans


def expected(points, spans):
    found = {}
    for c, r, i, a, b in spans:
        if c is None or b is None or b < a:
            continue
        row = []
        for m in (3, 4):
            v = sorted(p[m] + 0.0 for p in points if p[0] == c and p[2] and a <= p[2] <= b and p[m] is not None and not math.isnan(p[m]))
            if not v:
                row += [None] * 3
                continue
            row += [v[-1], float(sum(map(Fraction, v)) / len(v)), v[(len(v) - 1) // 2] * 0.5 + v[len(v) // 2] * 0.5]
        found[i] = row
    return found


@pytest.fixture(scope="module")
def tables(spark):
    points, spans = made(1)
    p = spark.createDataFrame(points, "circuit string, race int, t timestamp_ntz, a double, b double").repartition(3)
    s = spark.createDataFrame(spans, "circuit string, race int, lap int, first timestamp_ntz, last timestamp_ntz")
    return p, s, expected(points, spans)


def statistics(p, s, **more):
    return ranges.range_statistics(s, p, ON, [*ON, "lap"], "first", "last", "t", ["a", "b"], LEVELS, **more)


def near(got, want):
    assert set(got) == set(want)
    for i, row in want.items():
        for x, y in zip(got[i], row):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-14, abs_tol=1e-18)), (i, got[i], row)


def test_windows_and_spans_over_several_windows(tables):
    p, s, want = tables
    got = {r[2]: list(r[3:]) for r in statistics(p, s).collect()}
    near(got, want)


def test_full_windows_are_cut(tables, spark):
    """Parts of points and groups of spans give the very doubles of whole windows."""
    p, s, want = tables
    whole = sorted(map(str, statistics(p, s).collect()))
    assert sorted(map(str, statistics(p, s, max_rows=15).collect())) == whole


def test_no_row_per_span_and_point(spark):
    """One span over everything: rows that leave an exchange grow with points and spans, not with their product."""
    n = 3000
    p = spark.range(n).select(F.lit("x").alias("circuit"), F.lit(1).alias("race"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("a"), F.lit(0.5).alias("b"))
    s = spark.range(200).select(F.lit("x").alias("circuit"), F.lit(1).alias("race"), F.col("id").alias("lap"), F.timestamp_seconds(F.lit(0)).alias("first"), F.timestamp_seconds(F.lit(n)).alias("last"))
    rows = statistics(p, s)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert {tuple(r[3:]) for r in rows.collect()} == {(n - 1.0, (n - 1) / 2, (n - 1) / 2, 0.5, 0.5, 0.5)}


def test_sorted_window():
    rng = np.random.default_rng(2)
    values = np.where(rng.random(500) < 0.1, np.nan, rng.integers(-9, 9, 500) / 4)
    window = ranges.SortedWindow(values)
    kept = values[~np.isnan(values)]
    first = rng.integers(0, len(kept), 200)
    stop = np.minimum(first + rng.integers(1, 300, 200), len(kept))
    rank = (rng.random(200) * (stop - first)).astype(int)
    bound = rng.integers(-40, 40, 200) / 8
    assert window.ranked(first, stop, rank).tolist() == [sorted(kept[a:b])[r] for a, b, r in zip(first, stop, rank)]
    assert window.below(first, stop, bound).tolist() == [(kept[a:b] < x).sum() for a, b, x in zip(first, stop, bound)]
    assert window.greatest(first, stop).tolist() == [kept[a:b].max() for a, b in zip(first, stop)]


def test_exact_sums(spark):
    """The same double for every order and partition count, and the right one."""
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1e6), rng.gauss(0, 1e-6), 0.1, -0.1, 1e15]) for _ in range(3000)] + [None]
    want = float(sum(Fraction(v) for v in values if v is not None))
    rows = [(i % 3, v) for i, v in enumerate(values)]
    found = set()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        found.add(tuple(df.agg(exact_sum(F.col("v")), exact_mean(F.col("v"))).first()))
    assert len(found) == 1
    total, mean = found.pop()
    assert math.isclose(total, want, rel_tol=1e-15) and math.isclose(mean, want / 3000, rel_tol=1e-15)
    odd = spark.createDataFrame([(None,), (float("inf"),), (1.0,)], "v double")
    assert odd.agg(exact_sum(F.col("v"))).first()[0] == math.inf
    assert odd.where("v is null").agg(exact_sum(F.col("v"))).first()[0] is None


def test_ranks_hold_one_level_at_a_time():
    """Besides the points, ranks of a window need memory for one bit of the wavelet matrix, not for all."""
    values = np.random.default_rng(5).random(50_000)
    window = ranges.SortedWindow(values)
    first, stop = np.array([0, 10]), np.array([50_000, 20_000])
    tracemalloc.start()
    try:
        got = window.ranked(first, stop, (stop - first) // 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == [np.sort(values[a:b])[(b - a) // 2] for a, b in zip(first, stop)]
    assert "zeros" not in vars(window) and peak < 5 * values.nbytes
