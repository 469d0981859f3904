"""Exact interpolated percentiles per group, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions.numbers import ordered_bits
from trackline.operators.series import largest_group
from trackline.session import write_shared

MAX_GROUP_ROWS = 500_000
#: Bits of a value that a round of narrowing learns.
STEP_BITS = 16


def percentiles_by_group(
    df: DataFrame,
    keys: Sequence[str],
    outputs: Mapping[str, tuple[str, float]],
    extra: Sequence[Column] = (),
    group_rows: int | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``outputs`` maps a new column to (input column, fraction); ``extra`` are other aggregates.

    Linear interpolation between neighbouring values, NULLs left out. The built-in aggregate keeps
    all distinct values of a group in one buffer, which is fine while the fullest group stays below
    ``max_rows``; ``group_rows`` passes a known bound and saves the count. Beyond it the values at
    the ranks are found by narrowing, with counts of buckets only.
    """
    if group_rows is None:
        group_rows = largest_group(df, keys)
    if group_rows <= max_rows:
        # One aggregate, and so one buffer, for all fractions of a column.
        fractions: dict[str, list[float]] = {}
        for column, fraction in outputs.values():
            fractions.setdefault(column, []).append(fraction)
        built_in = [
            F.percentile(F.col(c), [float(p) for p in found]).alias(f"_all_{c}")
            for c, found in fractions.items()
        ]
        at = {
            out: F.get(f"_all_{c}", fractions[c].index(p)) for out, (c, p) in outputs.items()
        }
        found = df.groupBy(*keys).agg(*extra, *built_in)
        return found.withColumns(at).drop(*[f"_all_{c}" for c in fractions])
    ranked = _percentiles_by_narrowing(df, keys, outputs)
    if not keys:
        row = ranked.select(F.struct(*outputs)).scalar()
        found = df.agg(*(extra or [F.count(F.lit(1)).alias("_n")]))
        return found.withColumns({out: row[out] for out in outputs}).drop("_n")
    groups = df.groupBy(*keys).agg(*extra) if extra else df.select(*keys).distinct()
    match = [groups[k].eqNullSafe(ranked[k]) for k in keys]
    return groups.join(ranked, match, "left").select(groups["*"], *outputs)


def _percentiles_by_narrowing(
    df: DataFrame, keys: Sequence[str], outputs: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Values at given ranks of large groups, found by histograms of the leading bits of the values.

    Each round counts, per group and column, the values that begin with the bits known so far by
    their next 16 bits, and so learns 16 more bits of the value at each rank. Rows are counted
    where they are, so only counts of buckets are shuffled, at most 65,536 for a rank; values are
    never sorted or gathered. Four rounds read ``df``, which should be stored.
    """
    columns = sorted({c for c, _ in outputs.values()})
    group = F.struct(*keys) if keys else F.lit(0)
    entries = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    values = (
        df.select(group.alias("_group"), F.inline(F.array(*entries)))
        .where(F.col("_value").isNotNull())
        .withColumn("_bits", ordered_bits(F.col("_value")))
    )
    ranks = []
    for out, (column, fraction) in outputs.items():
        position = (F.col("_size") - 1) * F.lit(float(fraction))
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            named = F.struct(
                F.lit(out).alias("_out"),
                F.lit(side).alias("_side"),
                position.alias("_position"),
                rank.cast("bigint").alias("_rank"),
            )
            ranks.append(F.when(F.col("_column") == column, named))
    sizes = values.groupBy("_group", "_column").agg(F.count(F.lit(1)).alias("_size"))
    targets = sizes.select("_group", "_column", F.explode(F.array_compact(F.array(*ranks))).alias("_t"))
    targets = write_shared(
        targets.select("_group", "_column", "_t.*", F.lit(0).cast("bigint").alias("_prefix")), "rank-targets"
    )
    cell = ["_group", "_column", "_prefix"]
    for known in range(0, 64, STEP_BITS):
        rest = 64 - known - STEP_BITS
        begins = F.shiftright("_bits", 64 - known) if known else F.lit(0).cast("bigint")
        # The first bits are signed, the others are not.
        following = F.shiftright("_bits", rest)
        if known:
            following = following.bitwiseAND(F.lit((1 << STEP_BITS) - 1))
        wanted = targets.select(*cell).distinct()
        buckets = (
            values.withColumn("_prefix", begins)
            .withColumn("_next", following)
            .join(wanted, cell, "left_semi")
            .groupBy(*cell, "_next")
            .agg(F.count(F.lit(1)).alias("_count"), F.min("_value").alias("_found"))
        )
        upto = F.sum("_count").over(Window.partitionBy(*cell).orderBy("_next"))
        counted = buckets.withColumn("_upto", upto)
        before = F.col("_upto") - F.col("_count")
        hit = (before <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
        targets = write_shared(
            targets.drop("_found").join(counted, cell).where(hit).select(
                "_group",
                "_column",
                "_out",
                "_side",
                "_position",
                (F.col("_rank") - before).alias("_rank"),
                (F.shiftleft("_prefix", STEP_BITS) + F.col("_next")).alias("_prefix"),
                "_found",
            ),
            "rank-targets",
        )
    picks = []
    for out in outputs:
        mine = F.col("_out") == out
        lower, upper = (F.max(F.when(mine & (F.col("_side") == side), F.col("_found"))) for side in ("low", "high"))
        position = F.max(F.when(mine, F.col("_position")))
        above, below = F.ceil(position) - position, position - F.floor(position)
        # Term by term as the built-in aggregate computes it, so both paths give the same double.
        picks.append(F.when(lower == upper, lower).otherwise(above * lower + below * upper).alias(out))
    found = targets.groupBy("_group").agg(*picks)
    return found.select(*[F.col(f"_group.{k}").alias(k) for k in keys], *outputs)
