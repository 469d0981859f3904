"""Split series against brute force: slots, ranges, ties, NULL keys, empty and hot chunks."""

import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trackline.operators import series as S
from trackline.operators.runs import collapse_runs

SCHEMA = "k string, t bigint, tie bigint, v double, w double, ctx bigint"
SERIES = S.Series(("k",), ("t", "tie"))


def sample(seed, rows=400, distinct=4, nulls=0.15):
    """One series holds most rows, times repeat, one key is NULL."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        key = rnd.choices(["hot", "cold", None], [8, 2, 1])[0]
        value = None if rnd.random() < nulls else float(rnd.randrange(distinct))
        other = None if rnd.random() < nulls else float(rnd.randrange(2))
        out.append((key, rnd.randrange(60), i, value, other, rnd.randrange(1000)))
    return out


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


def plain(row):
    return tuple((v is not None, v) if not isinstance(v, str) else (True, v) for v in row)


def same(actual, expected):
    assert sorted(map(plain, actual)) == sorted(map(plain, expected))


def cut(df, how):
    if how == "whole":
        return S.fixed_chunk(df, SERIES, F.lit(0))
    if how == "fine":
        return S.fixed_chunk(df, SERIES, F.col("t"))
    if how == "slots":
        return S.split(df, SERIES, (1000, 7), 120)
    return S.split_by_range(df, SERIES, 17)


CUTS = ["whole", "fine", "slots", "range"]


@pytest.mark.parametrize("how", CUTS)
@pytest.mark.parametrize("offset", [1, -1, 5, -3])
def test_shift(spark, how, offset):
    rows = sample(1)
    df = cut(spark.createDataFrame(rows, SCHEMA), how)
    got = S.shift(df, SERIES, {"before": "v"}, offset).select("k", "tie", "before").collect()
    want = []
    for k, group in by_key(rows).items():
        for i, row in enumerate(group):
            j = i - offset
            want.append((k, row[2], group[j][3] if 0 <= j < len(group) else None))
    same(got, want)


@pytest.mark.parametrize("how", CUTS)
def test_fill_forward(spark, how):
    rows = sample(2, nulls=0.7)
    df = cut(spark.createDataFrame(rows, SCHEMA), how)
    got = S.fill_forward(df, SERIES, ["v", "w"]).select("k", "tie", "v", "w").collect()
    want = []
    for k, group in by_key(rows).items():
        last = [None, None]
        for row in group:
            last = [row[3] if row[3] is not None else last[0],
                    row[4] if row[4] is not None else last[1]]
            want.append((k, row[2], *last))
    same(got, want)


@pytest.mark.parametrize("how", CUTS)
def test_running_sum_and_numbers(spark, how):
    rows = sample(3)
    df = cut(spark.createDataFrame(rows, SCHEMA), how)
    df = S.number_rows(S.running_sum(df, SERIES, {"total": "v"}), SERIES, "n", "size")
    got = df.select("k", "tie", "total", "n", "size").collect()
    want = []
    for k, group in by_key(rows).items():
        total = None
        for i, row in enumerate(group):
            if row[3] is not None:
                total = (total or 0.0) + row[3]
            want.append((k, row[2], total, i + 1, len(group)))
    same(got, want)


def brute_runs(group, null_safe):
    """Periods as their definition reads: change flags, group numbers, then grouping by value."""
    runs, number, before = {}, 0, None
    for i, row in enumerate(group):
        value = (row[3], row[4]) if null_safe else (row[3],)
        prev = before if before is not None else tuple(None for _ in value)
        if null_safe:
            changed = prev != value
        else:
            changed = prev[0] is None or (value[0] is not None and value[0] != prev[0])
        number += changed
        runs.setdefault((number, value), []).append((i, row))
        before = value
    ordered = sorted(runs.items(), key=lambda r: r[1][0][0])
    out = []
    for i, ((_, value), members) in enumerate(ordered):
        out.append(
            (
                group[0][0],
                members[0][1][1],
                ordered[i + 1][1][0][1][1] if i + 1 < len(ordered) else None,
                *value,
                *(ordered[i - 1][0][1] if i else tuple(None for _ in value)),
                min(m[5] for _, m in members),
                max(m[2] for _, m in members),
            )
        )
    return out


@pytest.mark.parametrize("how", CUTS)
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("distinct", [1, 2, 5])
def test_runs(spark, how, null_safe, distinct):
    rows = sample(10 + distinct, distinct=distinct, nulls=0.2)
    df = cut(spark.createDataFrame(rows, SCHEMA), how).withColumn("top", F.col("tie"))
    values = ["v", "w"] if null_safe else ["v"]
    got = collapse_runs(
        df,
        SERIES,
        values,
        start="start",
        end="end",
        previous={v: f"before_{v}" for v in values},
        lowest=["ctx"],
        highest=["top"],
        null_safe=null_safe,
    )
    got = got.select(
        "k", "start", "end", *values, *[f"before_{v}" for v in values], "ctx", "top"
    ).collect()
    want = [p for group in by_key(rows).values() for p in brute_runs(group, null_safe)]
    same(got, want)


def test_constant_series_is_one_run_over_many_chunks(spark):
    rows = [("a", i, i, 7.0, None, 100 - i) for i in range(50)]
    df = cut(spark.createDataFrame(rows, SCHEMA), "fine")
    got = collapse_runs(df, SERIES, ["v"], start="s", end="e", previous={"v": "p"}, lowest=["ctx"])
    assert [(r.s, r.e, r.v, r.p, r.ctx) for r in got.collect()] == [(0, None, 7.0, None, 51)]


def test_split_takes_the_widest_slot_that_is_not_too_full(spark):
    start = datetime(2025, 9, 6, 12)
    rows = [("a", start + timedelta(seconds=i), i) for i in range(7200)]
    df = spark.createDataFrame(rows, "k string, t timestamp, tie bigint")
    series = S.Series(("k",), ("t", "tie"))
    for limit, chunks in ((10_000, 1), (3_600, 2), (100, 120)):
        got = S.split(df, series, max_rows=limit)
        assert got.select(S.CHUNK).distinct().count() == chunks


def test_split_divides_rows_of_one_instant(spark):
    rows = [("a", 1, i, 1.0, None, i) for i in range(1000)] + [("b", 2, 0, 1.0, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.split(df, SERIES, (100, 1), 200)
    sizes = [r["count"] for r in got.groupBy(S.CHUNK).count().collect()]
    assert sum(sizes) == 1001 and len(sizes) >= 5 and max(sizes) < 500


def test_missing_times_come_last(spark):
    rows = [("a", None, 0, 9.0, None, 0), ("a", 5, 1, 1.0, None, 0), ("a", 90, 2, 2.0, None, 0)]
    for how in ("slots", "range"):
        df = cut(spark.createDataFrame(rows, SCHEMA), how)
        got = S.shift(df, SERIES, {"before": "v"}).select("tie", "before").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == [(0, 2.0), (1, None), (2, 1.0)]


def test_running_sums_of_doubles_are_exact(spark):
    """The same doubles wherever the series is cut and whatever the partitions, and the right ones."""
    rng = random.Random(8)
    steps = [rng.choice([1e9, -1e9, 0.1, 1e-9]) * rng.random() for _ in range(400)]
    found = set()
    for chunks, parts in ((1, 1), (7, 3), (400, 5)):
        df = spark.createDataFrame([("v", i, x) for i, x in enumerate(steps)], "k string, t long, x double").repartition(parts)
        series = S.Series(("k",), ("t",))
        cut = S.fixed_chunk(df, series, F.floor(F.col("t") * chunks / 400))
        done = S.unsplit(S.running_sum(cut, series, {"upto": "x"}, totals={"all": "x"}))
        assert done.columns == ["k", "t", "x", "upto", "all"]
        found.add(tuple((r.upto, r.all) for r in done.orderBy("t").collect()))
    assert len(found) == 1
    total = Fraction(0)
    whole = float(sum(map(Fraction, steps)))
    for x, (upto, everything) in zip(steps, found.pop()):
        total += Fraction(x)
        assert math.isclose(upto, float(total), rel_tol=1e-15, abs_tol=1e-15) and math.isclose(everything, whole, rel_tol=1e-15)


def test_ranges_keep_their_bound(spark):
    """With a sample of one row a partition, bounds of ranges are bad; chunks are not."""
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "1")
    try:
        rows = [("k" if i % 3 else None, i % 5, i, float(i), None, i) for i in range(600)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        cut = S.split_by_range(df, SERIES, 50)
        sizes = sorted(r["count"] for r in cut.groupBy(S.CHUNK).count().collect())
        assert sizes[-1] == 50 and sum(sizes) == 600 and len(sizes) >= 12
        numbered = S.unsplit(S.number_rows(cut, SERIES, "n")).collect()
        for key in ("k", None):
            mine = sorted((r.n, r.t, r.tie) for r in numbered if r.k == key)
            assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
            assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
