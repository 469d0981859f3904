"""Collapse of consecutive equal values into validity periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators.series import CHUNK, KEY, Series, _chunks, _before_here


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def collapse_runs(
    df: DataFrame,
    series: Series,
    values: Sequence[str],
    *,
    start: str,
    end: str,
    previous: dict[str, str],
    lowest: Sequence[str] = (),
    highest: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """One row per run of equal ``values`` in a split series (see ``series.split``).

    ``start`` is the first time of the run, ``end`` the start of the next run (NULL for the last
    one), ``previous`` maps each value to the column that gets the value of the run before.
    ``lowest`` and ``highest`` are context columns reduced over the run by MIN or MAX.

    A row opens a run if it is the first of its series or differs from the row before. With
    ``null_safe`` two NULLs are equal; without it a NULL equals nothing, so every NULL row is a
    run of its own and so is the value after it.

    Runs are first collapsed inside each chunk. A run that crosses chunk borders is then put
    together from the chunk summaries: the piece at the head of a chunk is dropped if it continues
    the run before, and its context goes to the chunk where that run began.
    """
    time = series.order[0]
    reducers = {**{c: F.min for c in lowest}, **{c: F.max for c in highest}}

    def same(before: dict[str, Column], now: dict[str, Column]) -> Column:
        if null_safe:
            return _all([before[v].eqNullSafe(now[v]) for v in values])
        return _all([F.coalesce(before[v] == now[v], F.lit(False)) for v in values])

    # Both branches below read exactly these columns, so Spark exchanges the rows once for both.
    df = df.select(CHUNK, KEY, *dict.fromkeys([*series.order, *values, *reducers]))
    rows = series.rows()
    prev = {v: f"_prev_{v}" for v in values}
    marked = df.withColumns(
        {
            "_pos": F.row_number().over(rows),
            "_last_row": F.lead(F.lit(1)).over(rows).isNull(),
            **{prev[v]: F.lag(v).over(rows) for v in values},
        }
    )
    opens = (F.col("_pos") == 1) | ~same(
        {v: F.col(prev[v]) for v in values}, {v: F.col(v) for v in values}
    )
    marked = marked.withColumn("_opens", opens).withColumn(
        "_run",
        F.sum(F.col("_opens").cast("bigint")).over(
            rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    # The first row of a run stands for it: its time is the least, its values are those of all.
    # Reducing text by a window costs less than by an aggregate, which would have to sort twice.
    run = Window.partitionBy(CHUNK, KEY, "_run")
    pieces = (
        marked.withColumns({c: f(c).over(run) for c, f in reducers.items()})
        .where("_opens")
        .withColumnRenamed(time, "_start")
    )

    # A summary needs the first run, the start of the second and the last row of a chunk, so most
    # rows are dropped before it is built.
    first_run = F.col("_run") == 1
    heads = (
        marked.where(first_run | (F.col("_opens") & (F.col("_run") == 2)) | F.col("_last_row"))
        .groupBy(CHUNK, KEY)
        .agg(
            F.max("_run").alias("_runs"),
            F.min(F.when(first_run, F.col(time))).alias("_first_start"),
            F.min_by(F.struct(*values), "_pos").alias("_head"),
            F.max_by(F.struct(*values), "_pos").alias("_tail"),
            F.min(F.when(F.col("_run") == 2, F.col(time))).alias("_second"),
            *[f(F.when(first_run, F.col(c))).alias(f"_head_{c}") for c, f in reducers.items()],
        )
    )
    along = _chunks()
    heads = heads.withColumn("_last", F.lag("_tail").over(along))
    continues = F.col("_last").isNotNull() & same(
        {v: F.col("_last")[v] for v in values}, {v: F.col("_head")[v] for v in values}
    )
    heads = heads.withColumn("_continues", continues).withColumn(
        "_first", F.when(F.col("_continues"), F.col("_second")).otherwise(F.col("_first_start"))
    )
    begins = ((F.col("_runs") > 1) | ~F.col("_continues")).cast("bigint")
    heads = heads.withColumn(
        "_open_run", F.coalesce(F.sum(begins).over(along.rowsBetween(*_before_here)), F.lit(0))
    )
    # Context of all head pieces that continue one run, read from the chunk after its beginning.
    same_run = Window.partitionBy(KEY, "_open_run")
    heads = heads.withColumns(
        {
            f"_rest_{c}": f(F.when(F.col("_continues"), F.col(f"_head_{c}"))).over(same_run)
            for c, f in reducers.items()
        }
    )
    later = _chunks(reverse=True).rowsBetween(*_before_here)
    heads = heads.select(
        CHUNK,
        KEY,
        "_runs",
        "_last",
        "_continues",
        F.last("_first", ignorenulls=True).over(later).alias("_next"),
        *[F.lead(f"_rest_{c}").over(along).alias(f"_rest_{c}") for c in reducers],
    )

    at_head, at_tail = F.col("_run") == 1, F.col("_run") == F.col("_runs")
    in_chunk = Window.partitionBy(CHUNK, KEY).orderBy("_run")
    joined = pieces.withColumn("_after", F.lead("_start").over(in_chunk)).join(
        heads, [CHUNK, KEY], "left"
    )
    pick = {c: F.least if c in lowest else F.greatest for c in reducers}
    kept = joined.where(~(at_head & F.col("_continues")))
    return kept.select(
        CHUNK,
        KEY,
        *[F.col(KEY)[k].alias(k) for k in series.keys],
        F.col("_start").alias(start),
        F.coalesce("_after", "_next").alias(end),
        *values,
        *[
            F.when(at_head, F.col("_last")[v]).otherwise(F.col(prev[v])).alias(out)
            for v, out in previous.items()
        ],
        *[
            F.when(at_tail, pick[c](F.col(c), F.col(f"_rest_{c}"))).otherwise(F.col(c)).alias(c)
            for c in reducers
        ],
    )
