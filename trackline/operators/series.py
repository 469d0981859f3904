"""Ordered-series operators that do not need a whole series in one task.

A telemetry series (one vehicle, or one vehicle and signal) can hold a large part of all rows,
so ``Window.partitionBy(series)`` alone would put it into a single task. Here every series is
first cut along its own order into chunks. Each operator then works in three steps:

1. a window inside (chunk, series), the only shuffle of the rows;
2. one summary row per chunk, combined along the series by a window over summaries alone;
3. a join of the summaries back on (chunk, series), for which the rows stay where they are.

``split`` chooses the cut: fixed slots of the order column when a count shows that no slot is
too full, else counted ranges of the complete sort key, frozen with a reliable checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.functions.exact import limbs, total
from trackline.session import shared_dir

KEY = "_series"
CHUNK = "_chunk"
MAX_CHUNK_ROWS = 2_000_000
MAX_CHUNKS = 1_000_000

SECOND = 1_000_000
TIME_SLOTS = (86_400 * SECOND, 3_600 * SECOND, 60 * SECOND, SECOND)

_LAST_SLOT = 2**63 - 1


@dataclass(frozen=True)
class Series:
    """Identity columns of a series and the columns that order its rows, first one first."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def ordering(self, reverse: bool = False) -> list[Column]:
        if reverse:
            return [F.col(c).desc_nulls_first() for c in self.order]
        return [F.col(c).asc_nulls_last() for c in self.order]

    def rows(self, reverse: bool = False):
        """Window over the rows of one chunk of one series."""
        return Window.partitionBy(CHUNK, KEY).orderBy(*self.ordering(reverse))


_up_to_here = (Window.unboundedPreceding, Window.currentRow)
_before_here = (Window.unboundedPreceding, -1)


def _chunks(reverse: bool = False):
    """Window over the chunk summaries of one series."""
    order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    return Window.partitionBy(KEY).orderBy(order)


def slot_of(df: DataFrame, column: str, width: float) -> Column:
    """Slot number of a time (width in microseconds) or number; NULL falls in the last slot."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    return F.coalesce(F.floor(value / F.lit(width)).cast("bigint"), F.lit(_LAST_SLOT))


def largest_group(df: DataFrame, by: Iterable[str | Column]) -> int:
    """Row count of the fullest group: one aggregate with map-side combine, one number back."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def _fullness(keyed: DataFrame, column: str, widths: Sequence[float]) -> tuple[list[tuple[int, int]], int]:
    """Per width the rows of the fullest slot of any series and the most slots any series has; all rows.

    The rows are counted once per combination of slots; the widths share that count.
    """
    slots = {f"_slot{i}": slot_of(keyed, column, width) for i, width in enumerate(widths)}
    counts = keyed.groupBy(KEY, *[slot.alias(name) for name, slot in slots.items()]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    levels = []
    for i, name in enumerate(slots):
        per_slot = counts.groupBy(KEY, name).agg(F.sum("_n").alias("_n"))
        per_series = per_slot.groupBy(KEY).agg(
            F.max("_n").alias("_most"), F.count("_n").alias("_slots"), F.sum("_n").alias("_rows")
        )
        levels.append(
            per_series.agg(F.lit(i).alias("level"), F.max("_most"), F.max("_slots"), F.sum("_rows"))
        )
    found = sorted(tuple(row) for row in reduce(lambda a, b: a.union(b), levels).collect())  # one row a width
    return [(rows or 0, count or 0) for _, rows, count, _ in found], found[0][3] or 0


def split(
    df: DataFrame,
    series: Series,
    slots: Sequence[float] = TIME_SLOTS,
    max_rows: int = MAX_CHUNK_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add the series key and the chunk number, with at most ``max_rows`` rows per chunk.

    The widest slot that passes the count is taken. If none passes (many rows in one instant), or
    only one so narrow that a series would have more than ``MAX_CHUNKS`` summaries, the rows are
    range-partitioned on the full sort key, which also divides equal times.

    All widths but the narrowest are judged by one counting job, the narrowest by another if it is
    needed. ``probe`` is a cheaper table that has at least as many rows in every slot.
    """
    keyed = df.withColumn(KEY, F.struct(*series.keys))
    counted = keyed if probe is None else probe.withColumn(KEY, F.struct(*series.keys))
    total = None
    for widths in (tuple(slots[:-1]), tuple(slots[-1:])):
        if not widths:
            continue
        levels, total = _fullness(counted, series.order[0], widths)
        for width, (rows, chunks) in zip(widths, levels):
            if chunks > MAX_CHUNKS:
                return split_by_range(df, series, max_rows, total)
            if rows <= max_rows:
                return keyed.withColumn(CHUNK, slot_of(keyed, series.order[0], width))
    if not slots and largest_group(keyed, [KEY]) <= max_rows:
        return keyed.withColumn(CHUNK, F.lit(0).cast("bigint"))
    return split_by_range(df, series, max_rows, total)


def split_by_range(
    df: DataFrame, series: Series, max_rows: int = MAX_CHUNK_ROWS, total: int | None = None
) -> DataFrame:
    """Cut into ranges of (series, order) of at most ``max_rows`` rows; ``total`` is the row count where it is known.

    Bounds of partitions come from a sample and can be uneven, so each partition is sorted, which
    may spill, and its rows are numbered in that order; a chunk is the next ``max_rows`` of them.
    Chunk numbers are only fixed once the rows are stored: the reliable checkpoint makes them
    survive a lost executor.
    """
    shared_dir(df.sparkSession)
    n = max(1, math.ceil((df.count() if total is None else total) / max_rows))
    keyed = df.withColumn(KEY, F.struct(*series.keys))
    ranged = keyed.repartitionByRange(n, F.col(KEY), *series.ordering())
    ordered = ranged.sortWithinPartitions(F.col(KEY), *series.ordering())
    # The number of a row: its partition in the upper bits, its place there in the lower ones.
    number = F.monotonically_increasing_id()
    place = number.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.shiftleft(F.shiftright(number, 33), 33) + F.floor(place / max_rows).cast("bigint")
    return ordered.withColumn(CHUNK, chunk).checkpoint()


def fixed_chunk(df: DataFrame, series: Series, chunk: Column) -> DataFrame:
    """Use a chunk expression whose row count per series is bounded by construction."""
    return df.withColumn(KEY, F.struct(*series.keys)).withColumn(CHUNK, chunk.cast("bigint"))


def unsplit(df: DataFrame) -> DataFrame:
    return df.drop(KEY, CHUNK)


def shift(df: DataFrame, series: Series, columns: dict[str, str], offset: int = 1) -> DataFrame:
    """LAG (offset > 0) or LEAD (offset < 0) of ``{output: input}`` within the series."""
    reverse, k = offset < 0, abs(offset)
    rows = series.rows(reverse)
    local = df.withColumns(
        {
            "_pos": F.row_number().over(rows),
            "_at_end": F.lead(F.lit(1), k).over(rows).isNull(),
            **{out: F.lag(src, k).over(rows) for out, src in columns.items()},
        }
    )
    # The last k rows of every chunk, then the last k rows of all chunks before it: each chunk
    # holds at least one row, so k chunks are enough, and of their rows only the last k are kept.
    item = F.struct("_pos", *[F.col(src).alias(f"_v{i}") for i, src in enumerate(columns.values())])
    tails = (
        local.where("_at_end")
        .groupBy(CHUNK, KEY)
        .agg(F.sort_array(F.collect_list(item)).alias("_tail"))
    )
    earlier = F.flatten(F.collect_list("_tail").over(_chunks(reverse).rowsBetween(-k, -1)))
    carry = tails.select(CHUNK, KEY, earlier.alias("_all")).select(
        CHUNK,
        KEY,
        F.when(F.size("_all") > k, F.slice("_all", F.size("_all") - k + 1, k)).otherwise(F.col("_all")).alias("_carry"),
    )
    joined = local.join(carry, [CHUNK, KEY], "left")
    at = F.size("_carry") - F.lit(k) + F.col("_pos") - 1
    from_before = F.when(at >= 0, F.get(F.col("_carry"), at))
    return joined.withColumns(
        {
            out: F.when(F.col("_pos") > k, F.col(out)).otherwise(from_before[f"_v{i}"])
            for i, out in enumerate(columns)
        }
    ).drop("_pos", "_at_end", "_carry")


def fill_forward(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its last non-null value up to the row, in place."""
    rows = series.rows()
    local = df.withColumns(
        {
            "_at_end": F.lead(F.lit(1)).over(rows).isNull(),
            **{c: F.last(c, ignorenulls=True).over(rows.rowsBetween(*_up_to_here)) for c in columns},
        }
    )
    before = _chunks().rowsBetween(*_before_here)
    carry = local.where("_at_end").select(
        CHUNK,
        KEY,
        *[F.last(c, ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns],
    )
    joined = local.join(carry, [CHUNK, KEY], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns}
    ).drop("_at_end", *[f"_carry_{c}" for c in columns])


def running_sum(
    df: DataFrame,
    series: Series,
    columns: dict[str, str],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Running total of ``{output: input}`` from the start of the series to the row.

    ``totals`` adds sums over the whole series. Doubles are summed exactly, by limbs, so a total is
    the same double wherever the series is cut.
    """
    totals = totals or {}
    doubles = [
        c for c in dict.fromkeys((*columns.values(), *totals.values())) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    ]
    if doubles:
        parts = {f"_limb{i}_{c}": limb for c in doubles for i, limb in enumerate(limbs(F.col(c)))}

        def spread(wanted: dict[str, str]) -> dict[str, str]:
            return {
                name: src
                for out, c in wanted.items()
                for name, src in ([(f"_{out}_{i}", f"_limb{i}_{c}") for i in range(4)] if c in doubles else [(out, c)])
            }

        summed = running_sum_parts(df.withColumns(parts), series, spread(columns), spread(totals))
        made = [out for out, c in {**columns, **totals}.items() if c in doubles]
        found = summed.withColumns({out: total(*[F.col(f"_{out}_{i}") for i in range(4)]) for out in made})
        return found.drop(*parts, *[f"_{out}_{i}" for out in made for i in range(4)])
    return running_sum_parts(df, series, columns, totals)


def running_sum_parts(
    df: DataFrame, series: Series, columns: dict[str, str], totals: dict[str, str]
) -> DataFrame:
    """Running totals of columns whose sums do not depend on their order."""
    rows = series.rows().rowsBetween(*_up_to_here)
    local = df.withColumns({out: F.sum(src).over(rows) for out, src in columns.items()})
    sums = df.groupBy(CHUNK, KEY).agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in {**columns, **totals}.items()]
    )
    before = _chunks().rowsBetween(*_before_here)
    whole = Window.partitionBy(KEY)
    carry = sums.select(
        CHUNK,
        KEY,
        *[F.sum(f"_sum_{out}").over(before).alias(f"_carry_{out}") for out in columns],
        *[F.sum(f"_sum_{out}").over(whole).alias(out) for out in totals],
    )
    joined = local.join(carry, [CHUNK, KEY], "left")
    zero = F.lit(0)
    return joined.withColumns(
        {
            out: F.when(
                F.col(out).isNotNull() | F.col(f"_carry_{out}").isNotNull(),
                F.coalesce(F.col(out), zero) + F.coalesce(F.col(f"_carry_{out}"), zero),
            )
            for out in columns
        }
    ).drop(*[f"_carry_{out}" for out in columns])


def number_rows(
    df: DataFrame, series: Series, out: str, total: str | None = None
) -> DataFrame:
    """Row number within the series, and the row count of the series if ``total`` is given."""
    local = df.withColumn(out, F.row_number().over(series.rows()).cast("bigint"))
    sizes = df.groupBy(CHUNK, KEY).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(_chunks().rowsBetween(*_before_here))
    carry = sizes.select(
        CHUNK,
        KEY,
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(KEY)).alias(total or "_total"),
    )
    joined = local.join(carry, [CHUNK, KEY], "left").withColumn(out, F.col(out) + F.col("_before"))
    return joined.drop("_before", "_total")
