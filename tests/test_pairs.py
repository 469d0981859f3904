"""Full outer joins within one table against DuckDB, with keys of very many rows."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackline.operators.pairs import grouped_sides, pairs_of, self_full_join


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    found = []
    for i in range(260):
        key = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, None, *range(6, 40)])
        a = rng.choice([None, i]) if key != 3 else None
        b = rng.choice([None, -i]) if key != 4 else None
        found.append((rng.choice(["x", "x", "y"]), key, a, b))
    return [*found, *[("y", 77, i, None) for i in range(50)], *[("y", 78, None, i) for i in range(50)]]


@pytest.mark.parametrize("max_rows", [1000, 7, 1])
def test_pairs_equal_a_full_join(spark, rows, max_rows):
    df = spark.createDataFrame(rows, "circuit string, second int, a int, b int").repartition(3)
    done = self_full_join(
        df,
        ["circuit", "second"],
        F.when(F.col("a").isNotNull(), F.struct("a")),
        F.when(F.col("b").isNotNull(), F.struct("b")),
        max_rows,
    )
    t = pd.DataFrame(rows, columns=["circuit", "second", "a", "b"]).astype({"second": "Int64", "a": "Int64", "b": "Int64"})
    want = duckdb.sql(
        """SELECT circuit, second, a, b FROM (SELECT circuit, second, a FROM t WHERE a IS NOT NULL) x
        FULL JOIN (SELECT circuit, second, b FROM t WHERE b IS NOT NULL) y USING (circuit, second)"""
    ).fetchall()
    got = [tuple(r) for r in done.select("circuit", "second", "left.a", "right.b").collect()]
    assert len(want) > 300 and t is not None
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rows_are_read_once(spark, rows, tmp_path):
    spark.createDataFrame(rows, "circuit string, second int, a int, b int").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for max_rows in (1000, 7):
        done = self_full_join(df, ["circuit", "second"], F.struct("a"), F.struct("b"), max_rows)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet \[circuit#\d+,second#\d+,a#", plan)) == 1
        assert plan.count("FileScan") == (1 if max_rows == 1000 else 2)  # the list of full keys is the other one


def test_a_full_key_is_spread(spark):
    df = spark.range(900).select(F.lit("x").alias("k"), F.col("id").alias("a"))
    done = self_full_join(df, ["k"], F.when(F.col("a") < 600, F.struct("a")), F.when(F.col("a") >= 600, F.struct("a")), 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[1] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 600 * 300 and len(sizes) == 4


@pytest.mark.parametrize("max_rows", [1000, 7, 1])
def test_stored_sides_hold_every_part_once(spark, rows, tmp_path, max_rows):
    """What is stored grows with the rows, not with the pairs, and gives the pairs of the join."""
    df = spark.createDataFrame(rows, "circuit string, second int, a int, b int").repartition(3)
    sides = [F.when(F.col(c).isNotNull(), F.struct(c)) for c in ("a", "b")]
    grouped_sides(df, ["circuit", "second"], *sides, max_rows).write.parquet(str(tmp_path / "sides"))
    stored = spark.read.parquet(str(tmp_path / "sides"))
    parts = stored.agg(F.sum(F.size("_left")), F.sum(F.size("_right"))).first()
    assert tuple(parts) == (sum(r[2] is not None for r in rows), sum(r[3] is not None for r in rows))
    assert max_rows > 1 or stored.agg(F.max("_pieces")).first()[0] > 5
    got, want = (
        sorted(map(str, d.select("circuit", "second", "left.a", "right.b").collect()))
        for d in (pairs_of(stored, ["circuit", "second"]), self_full_join(df, ["circuit", "second"], *sides))
    )
    assert got == want and len(got) > 300
