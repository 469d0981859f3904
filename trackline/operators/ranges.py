"""Statistics of the points inside each of many intervals, without a row per interval and point."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.functions.exact import total
from trackline.operators.intervals import LEVELS
from trackline.session import write_shared

#: Points, and intervals, that one task holds at a time.
MAX_WINDOW_ROWS = 500_000
#: Bits by which a round narrows a median that lies in several parts of a window.
STEP_BITS = 12


class SortedWindow:
    """The values of one measure in order of time, with a structure for each kind of question.

    Sums come from prefix sums of integer limbs, maxima from a sparse table of blocks of powers of
    two, and order statistics from a wavelet matrix: the ranks of the values, divided bit by bit
    with a prefix count for each bit, so all intervals are answered together in a few array steps.
    Ranks go through the bits once, so one bit is held at a time; counts below bounds keep them all.
    """

    def __init__(self, values: np.ndarray) -> None:
        keep = ~np.isnan(values)
        self.before = np.append(0, np.cumsum(keep))
        self.values = values[keep]
        self.sorted = np.unique(self.values)
        self.bits = max(int(len(self.sorted) - 1).bit_length(), 1)

    def levels(self) -> Iterator[np.ndarray]:
        """Zeros before every place, bit by bit from the highest; a level is made when it is asked for."""
        codes = np.searchsorted(self.sorted, self.values).astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            low = codes >> bit & 1 == 0
            zeros = np.zeros(len(codes) + 1, dtype=np.int32)
            np.cumsum(low, out=zeros[1:])
            yield zeros
            codes = np.concatenate([codes[low], codes[~low]])

    @cached_property
    def zeros(self) -> list[np.ndarray]:
        return list(self.levels())

    def span(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the points that have a value, of places among all points."""
        return self.before[first], self.before[stop]

    def sums(self, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Sums of whole units and of two limbs of 32 bits, as in ``functions.exact``."""
        whole = np.floor(self.values)
        rest = (self.values - whole) * 2.0**32
        upper = np.floor(rest)
        lower = np.floor((rest - upper) * 2.0**32)
        parts = [np.append(0, np.cumsum(x.astype(np.int64))) for x in (whole, upper, lower)]
        return [p[stop] - p[first] for p in parts]

    def greatest(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Greatest value of each interval, as the greater of two blocks that cover it; NaN for none."""
        found = np.full(len(first), np.nan)
        size = stop - first
        if not size.any():
            return found
        power = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        table = self.values
        for p in range(int(power.max()) + 1):
            at = np.flatnonzero(power == p)
            found[at] = np.maximum(table[first[at]], table[stop[at] - (1 << p)])
            table = np.maximum(table[: -(1 << p) or None], table[1 << p :]) if len(table) > 1 << p else table
        return found

    def ranked(self, first: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of each rank from 0 among those of its interval; ranks must exist."""
        lo, hi, rank = first.copy(), stop.copy(), rank.copy()
        code = np.zeros(len(rank), dtype=np.int64)
        for zeros in self.levels():
            before, upto = zeros[lo], zeros[hi]
            small = rank < upto - before
            n = zeros[-1]
            code = code * 2 + ~small
            rank = np.where(small, rank, rank - (upto - before))
            lo, hi = np.where(small, before, n + lo - before), np.where(small, upto, n + hi - upto)
        return self.sorted[code]

    def below(self, first: np.ndarray, stop: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than its bound."""
        code = np.searchsorted(self.sorted, bound)
        everything = code >= len(self.sorted)
        lo, hi = first.copy(), stop.copy()
        count = np.zeros(len(code), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            before, upto = zeros[lo], zeros[hi]
            one = code >> (self.bits - 1 - level) & 1 == 1
            count += np.where(one, upto - before, 0)
            n = zeros[-1]
            lo, hi = np.where(one, n + lo - before, before), np.where(one, n + hi - upto, upto)
        return np.where(everything, stop - first, count)


#: Numbers below it stand for no double that is a number.
LEAST_BITS = ~np.float64(-np.inf).view(np.uint64)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    """Doubles of numbers that are ordered as the doubles are; NaN beyond infinity."""
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, bits ^ sign, ~bits).view(np.float64)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _full(rows: DataFrame, cell: Sequence[str], max_rows: int, name: str) -> DataFrame:
    """Windows that hold more than ``max_rows`` rows, with the number of parts each is cut into."""
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    return write_shared(sizes.select(*cell, F.ceil(F.col("_n") / max_rows).cast("bigint").alias(name)), "full-windows")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list for every span, of one number for every measure; NaN becomes NULL."""
    flat = np.array(values).T.ravel()
    mask = np.isnan(flat) if flat.dtype.kind == "f" else None
    offsets = np.arange(0, len(flat) + 1, len(values), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind, mask=mask))


class _Window:
    """The spans and the points of one window, as tables, with the places each span reaches."""

    def __init__(self, spans: pa.Table, points: pa.Table) -> None:
        times = points.column("_at").to_numpy()
        self.order = np.argsort(times, kind="stable")
        self.points = points
        times = times[self.order]
        self.first = np.searchsorted(times, spans.column("_from").to_numpy(), side="left")
        self.stop = np.searchsorted(times, spans.column("_to").to_numpy(), side="right")

    def measure(self, name: str) -> SortedWindow:
        values = self.points.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        return SortedWindow(values[self.order] + 0.0)


def range_statistics(
    spans: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    keys: Sequence[str],
    start: str,
    end: str,
    at: str,
    measures: Sequence[str],
    levels: Sequence[int] = LEVELS,
    max_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Maximum, mean and median of each measure over the points from start to end of each span.

    Points and spans meet on ``on`` and on a window of time. A span belongs to the window in which
    it starts; a window is two widths long, so a span lies in one window and a point in two.
    Windows are of the widest level unless a count shows more than ``max_rows`` points in one;
    then a span belongs to the narrowest level whose width is not less than its length. Spans
    longer than the last level are cut into its windows. A task holds one window: its points are
    sorted once, and every span is answered from prefix sums, a sparse table and a wavelet matrix.
    No row for a pair of span and point is made, however long the spans are.

    Windows that are still too full are cut into parts by row, those of more than
    ``max_rows`` spans into groups of spans. Counts, sums and maxima of parts are added up. The
    median of a span in several parts is found by narrowing: every part counts its values between
    4,096 bounds of the bits of a double, the counts are added up, and the bounds close in on the
    interval that holds the rank, until it is one value. Counts are shuffled there, never values.

    ``keys`` name a span, are unique, and hold ``on``. Returns the keys with ``max_``, ``mean_``
    and ``median_`` of each measure. Sums are exact (``functions.exact``), so neither the order of
    the points nor the cut matters. NULL and NaN measures are left out; a span without values has
    NULLs, one with a missing or reversed end no row. Measures are less than 2**62 in size.
    ``spans`` and ``points`` are read several times and should be stored.
    """
    measures, on, keys = list(measures), list(on), list(keys)
    cell = [*on, "_level", "_window"]
    key_fields = [spans.schema[k] for k in keys]
    readings = points.where(F.col(at).isNotNull()).dropna(subset=on)
    readings = readings.select(*on, _micros(at).alias("_at"), *[F.col(m).cast("double").alias(m) for m in measures])

    def windows(used: Sequence[int]) -> tuple[DataFrame, int]:
        """Points in both windows of every level, and the number of points in the fullest window."""
        wanted = [
            F.struct(F.lit(i).alias("_level"), F.lit(levels[i]).cast("bigint").alias("_width")) for i in used
        ]
        slot = F.floor(F.col("_at") / F.col("_width")).cast("bigint")
        found = readings.select("*", F.inline(F.array(*wanted)))
        found = found.withColumn("_window", F.explode(F.array(slot, slot - 1))).drop("_width")
        sizes = found.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        return found, sizes.agg(F.max("_n")).first()[0] or 0

    widest = len(levels) - 1
    marks, fullest = windows([widest])
    length = _micros(end) - _micros(start)
    level = F.lit(widest)
    if fullest > max_rows:
        # Too many points for wide windows: short spans take narrow ones.
        for i in range(widest - 1, -1, -1):
            level = F.when(length <= levels[i], F.lit(i)).otherwise(level)
    placed = spans.where(F.col(start) <= F.col(end)).dropna(subset=on)
    placed = placed.select(*keys, _micros(start).alias("_from"), _micros(end).alias("_to"), level.alias("_level"))
    width = F.get(F.array(*[F.lit(w).cast("bigint") for w in levels]), F.col("_level"))
    first, last = (F.floor(F.col(c) / width).cast("bigint") for c in ("_from", "_to"))
    steps = F.when(last - first < 2, F.array(first)).otherwise(F.sequence(first, last, F.lit(2).cast("bigint")))
    placed = placed.withColumn("_windows", steps).withColumn("_window", F.explode("_windows"))
    counted = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_windows")).alias("_several"))
    used = counted.groupBy("_level").agg(F.max("_n").alias("_n"), F.max("_several").alias("_several")).collect()
    placed = placed.drop("_windows")
    if fullest > max_rows:
        marks, fullest = windows(sorted(row["_level"] for row in used) or [widest])
        marks = marks.join(placed.select(*cell).distinct(), cell, "left_semi")
    whole = fullest <= max_rows and all(row["_n"] <= max_rows and row["_several"] <= 1 for row in used)
    one = F.lit(1).cast("bigint")
    if fullest > max_rows:
        full = _full(marks, cell, max_rows, "_parts")
        marks, placed = (df.join(full, cell, "left").withColumn("_parts", F.coalesce("_parts", one)) for df in (marks, placed))
    else:
        marks, placed = (df.withColumn("_parts", one) for df in (marks, placed))
    if any(row["_n"] > max_rows for row in used):
        full = _full(placed, cell, max_rows, "_copies")
        marks, placed = (df.join(full, cell, "left").withColumn("_copies", F.coalesce("_copies", one)) for df in (marks, placed))
    else:
        marks, placed = (df.withColumn("_copies", one) for df in (marks, placed))
    row_part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))
    marks = marks.withColumn("_part", row_part).withColumn("_copy", F.explode(F.sequence(one * 0, F.col("_copies") - 1)))
    placed = placed.withColumn("_part", F.explode(F.sequence(one * 0, F.col("_parts") - 1))).withColumn(
        "_copy", F.pmod(F.xxhash64(*keys), F.col("_copies"))
    )
    marks, placed = (df.drop("_parts", "_copies") for df in (marks, placed))
    group = [*cell, "_part", "_copy"]

    def answers(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        window = _Window(mine, theirs)
        found: dict[str, list[np.ndarray]] = {c: [] for c in ("n", "whole", "upper", "lower", "top", "low", "high")}
        for name in measures:
            values = window.measure(name)
            lo, hi = values.span(window.first, window.stop)
            n = hi - lo
            some = np.flatnonzero(n)
            found["n"].append(n)
            for part, sums in zip(("whole", "upper", "lower"), values.sums(lo, hi)):
                found[part].append(sums)
            found["top"].append(values.greatest(lo, hi))
            ranks = np.concatenate([((n - 1) // 2)[some], (n // 2)[some]])
            ranked = values.ranked(np.tile(lo[some], 2), np.tile(hi[some], 2), ranks)
            for part, chosen in zip(("low", "high"), np.split(ranked, 2)):
                middle = np.full(len(n), np.nan)
                middle[some] = chosen
                found[part].append(middle)
            del values, ranks, ranked
        kinds = {c: pa.float64() if c in ("top", "low", "high") else pa.int64() for c in found}
        columns = [mine.column(k) for k in keys] + [_lists(v, kinds[c]) for c, v in found.items()]
        return pa.table(columns, names=[*keys, *found])

    numbers = ["n array<bigint>", "whole array<bigint>", "upper array<bigint>", "lower array<bigint>"]
    numbers += ["top array<double>", "low array<double>", "high array<double>"]
    answer = T.StructType([*key_fields, *T._parse_datatype_string(", ".join(numbers)).fields])
    found = placed.groupBy(*group).cogroup(marks.groupBy(*group)).applyInArrow(answers, answer)
    if whole:
        return found.select(*keys, *_statistics(measures, lambda c, i: F.get(c, F.lit(i))))
    found = write_shared(found, "range-parts")
    parts = [
        (F.max if c in ("top", "low", "high") else F.sum)(F.get(c, F.lit(i))).alias(f"{c}{i}")
        for i in range(len(measures))
        for c in ("n", "whole", "upper", "lower", "top", "low", "high")
    ]
    merged = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pieces"), *parts)
    ranks = [
        F.struct(F.lit(i).alias("_measure"), F.lit(side).alias("_side"), rank.cast("bigint").alias("_rank"))
        for i in range(len(measures))
        for side, rank in (("low", F.floor((F.col(f"n{i}") - 1) / 2)), ("high", F.floor(F.col(f"n{i}") / 2)))
    ]
    wanted = merged.where("_pieces > 1").select(*keys, F.inline(F.array(*ranks))).where(F.col("_rank") >= 0)
    targets = write_shared(wanted.withColumn("_prefix", one * 0), "range-targets")
    middles = _narrow(targets, placed, marks, measures, keys, group, spans.schema)
    match = [merged[k].eqNullSafe(middles[k]) for k in keys]
    pick = {
        f"{side}{i}": F.when(F.col("_pieces") > 1, F.col(f"_{side}{i}")).otherwise(F.col(f"{side}{i}"))
        for i in range(len(measures))
        for side in ("low", "high")
    }
    joined = merged.join(middles, match, "left").select(merged["*"], *[F.col(f"_{c}") for c in pick])
    return joined.withColumns(pick).select(*keys, *_statistics(measures, lambda c, i: F.col(f"{c}{i}")))


def _statistics(measures: Sequence[str], part: Callable[[str, int], Column]) -> list[Column]:
    columns = []
    for i, name in enumerate(measures):
        sums = total(*[part(c, i) for c in ("whole", "upper", "lower")], F.lit(None).cast("double"))
        columns += [
            part("top", i).alias(f"max_{name}"),
            (sums / F.nullif(part("n", i), F.lit(0))).alias(f"mean_{name}"),
            (part("low", i) * 0.5 + part("high", i) * 0.5).alias(f"median_{name}"),
        ]
    return columns


def _narrow(
    targets: DataFrame,
    placed: DataFrame,
    marks: DataFrame,
    measures: Sequence[str],
    keys: Sequence[str],
    group: Sequence[str],
    schema: T.StructType,
) -> DataFrame:
    """The value of each rank of spans that lie in several parts, six rounds of counts each.

    ``_prefix`` holds the leading bits of the value so far, ``_rank`` its rank among the values
    that begin with them. The last round has one double for each bound, and names it.
    """
    fields = [*[schema[k] for k in keys], *T._parse_datatype_string(
        "_measure int, _side string, _child int, _count bigint, _value double").fields]
    same = [*keys, "_measure", "_side"]

    def counter(step: int, rest: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def counts(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            window = _Window(mine, theirs)
            number = mine.column("_measure").to_numpy()
            prefix = mine.column("_prefix").to_numpy().view(np.uint64)
            child = np.arange(1 << step, dtype=np.uint64)
            found: list[list[np.ndarray]] = [[], [], [], []]
            for i in np.unique(number).tolist():
                values = window.measure(measures[i])
                for row in np.flatnonzero(number == i).tolist():
                    lo, hi = values.span(window.first[[row]], window.stop[[row]])
                    least = ((prefix[row] << np.uint64(step)) + child) << np.uint64(rest)
                    bounds = from_ordered_bits(least)
                    bounds[least < LEAST_BITS] = -np.inf
                    behind = (int(least[-1]) + (1 << rest)) % (1 << 64)  # 0: nothing lies behind the last bound
                    bounds = np.append(bounds, from_ordered_bits(np.array([behind], dtype=np.uint64)) if behind else np.nan)
                    under = values.below(np.repeat(lo, len(bounds)), np.repeat(hi, len(bounds)), bounds)
                    size = np.diff(under)
                    some = np.flatnonzero(size)
                    for part, x in zip(found, (np.full(len(some), row), some, size[some], bounds[some])):
                        part.append(x)
            row, *rest_of = (np.concatenate(x) if x else np.zeros(0) for x in found)
            chosen = mine.take(pa.array(row.astype(np.int64)))
            columns = [chosen.column(c) for c in same]
            columns += [pa.array(x.astype(t)) for x, t in zip(rest_of, (np.int32, np.int64, np.float64))]
            return pa.table(columns, names=[f.name for f in fields])

        return counts

    left = 64
    while left:
        step = min(STEP_BITS, left)
        rest = left - step
        match = [placed[k].eqNullSafe(targets[k]) for k in keys]
        asked = placed.join(targets, match).select(placed["*"], "_measure", "_side", "_prefix")
        cells = asked.select(*group).distinct()
        given = marks.join(cells, list(group), "left_semi")
        found = asked.groupBy(*group).cogroup(given.groupBy(*group)).applyInArrow(counter(step, rest), T.StructType(fields))
        summed = found.groupBy(*same, "_child").agg(F.sum("_count").alias("_count"), F.first("_value").alias("_value"))
        upto = F.sum("_count").over(Window.partitionBy(*same).orderBy("_child"))
        summed = summed.withColumn("_upto", upto)
        match = [targets[k].eqNullSafe(summed[k]) for k in same]
        hit = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_count") <= F.col("_rank"))
        chosen = targets.join(summed, match).where(hit)
        targets = write_shared(
            chosen.select(
                *[targets[k] for k in same],
                (F.col("_rank") - F.col("_upto") + F.col("_count")).alias("_rank"),
                F.shiftleft("_prefix", step).bitwiseOR(F.col("_child").cast("bigint")).alias("_prefix"),
                summed["_value"],
            ),
            "range-targets",
        )
        left = rest
    pick = [
        F.max(F.when((F.col("_measure") == i) & (F.col("_side") == side), F.col("_value"))).alias(f"_{side}{i}")
        for i in range(len(measures))
        for side in ("low", "high")
    ]
    return targets.groupBy(*keys).agg(*pick)
