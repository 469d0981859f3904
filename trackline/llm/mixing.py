"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.llm.common import SPACE, cut, word_count

#: Ranges of the sampling rank in which words are counted before rows are ordered.
SLOTS = 4096
#: Up to so many sources their figures (under 100 bytes each) are sent to every task.
SMALL_SOURCES = 10_000


def source_targets(
    totals: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of sources: their weighted shares, none above ``most`` times its size.

    ``totals`` has ``source`` and ``source_size``. Weights are dealt in order of the source's code
    points, null last. Sources are ordered by size per unit of weight; those that cannot take
    their share come first in that order, so one running sum decides who is full, and the rest
    share what is left by weight. One row per source is ordered, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighted = totals.select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), pick.cast("int")).alias("weight")
    ).withColumn("ratio", F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))
    ) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn(
        "full", F.col("source_size") * F.lit(float(most)) <= F.col("level") * F.col("weight")
    )
    open_level = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(everything)["level"]
    return leveled.withColumn("open_level", open_level).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("source_size") * F.lit(float(most)))
        .otherwise(F.col("open_level") * F.col("weight"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    name: str | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    Every document of a source is expected target / size times. The whole part of that number is
    allocated as certain copies; the fraction p is the inclusion probability of one more copy, and
    differs between sources. Pareto order sampling ranks documents by u / (1 - u) over p / (1 - p),
    u being a uniform number from the key, and takes the lowest ranks up to the words still
    wanted. The sample has a fixed size, as the document at the edge is taken in part.

    The edge is found without ordering a source: words are summed per source and range of the rank
    (``SLOTS`` ranges), the range that crosses the target is found by a running sum over ranges,
    and rows are ordered inside their range only. A source with a third of all rows is spread over
    its ranges.

    ``name`` is the column that u comes from, the key by default. Returns the key, ``size``, ``source_size``, ``target`` (double) and ``taken``. A null or empty
    text has size 0 and gives 0. A null source is a source, the last. Rows that repeat are
    documents of their own. A null key ranks as an empty one. An empty table gives no rows; if
    there are no words at all, every target is 0. Other columns are not read.
    """
    sized = cut(
        docs.select(
            F.col(key).alias("key"),
            F.col(name or key).alias("name"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, share, most).toDF("of", "source_size", "target"))
    small = targets.count() <= SMALL_SOURCES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    times = F.col("target") / F.col("source_size")
    planned = targets.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(times)).otherwise(0).cast("long")
    ).withColumn("p", F.when(F.col("source_size") > 0, times - F.col("copies")).otherwise(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("name").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))
    ranked = (
        sized.join(side(planned), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rank", F.when(F.col("p") > 0, odds).otherwise(u / (1.0 - u)))
        .withColumn("slot", F.floor(F.col("rank") / (F.col("rank") + 1.0) * SLOTS))
        .drop("source")
    )
    slots = ranked.where("p > 0").groupBy("of", "slot").agg(
        F.sum("size").alias("words"),
        F.first("target").alias("target"),
        F.first("copies").alias("copies"),
        F.first("source_size").alias("source_size"),
    )
    before = Window.partitionBy("of").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.col("target") - F.col("copies") * F.col("source_size")
    edges = (
        slots.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("wanted", wanted)
        .where("words_before < wanted")
        .groupBy(F.col("of").alias("edge_of"))
        .agg(
            F.max("slot").alias("edge"),
            F.max("words_before").alias("words_before"),
            F.first("wanted").alias("wanted"),
        )
    )
    inside = (
        Window.partitionBy("of", "slot").orderBy("rank", "name", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        side(edges), F.col("of").eqNullSafe(F.col("edge_of")), "left"
    )
    left = F.floor(F.col("wanted") - (F.col("words_before") + F.col("inside")) + 0.5)
    more = (
        F.when(F.col("p") <= 0, 0)
        .when(F.col("slot") < F.col("edge"), F.col("size"))
        .when(F.col("slot") == F.col("edge"), F.least(F.greatest(left, F.lit(0)), "size"))
        .otherwise(0)
    )
    return placed.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + more).cast("long").alias("taken"),
    )


def take(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns.

    A document taken in part has a last copy with its first words only. Documents are found again by their number in the table, which has to be read in the same
    order twice, as stored tables are.
    """
    numbered = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.col(source).alias("source"),
        F.col(key).alias("name"), F.monotonically_increasing_id().alias("number"),
    )
    taken = mix(numbered, "number", "text", "source", weights, share, most, name="name")
    copies = taken.where("taken > 0").select(
        "number", "taken", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy")
    )
    found = numbered.join(copies, "number")
    # Pieces of one word and the white space after it.
    pieces = F.split(F.btrim("text", F.lit(SPACE)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    rest = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    whole = F.col("copy") * F.col("size") <= F.col("taken")
    words = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest(rest, F.lit(1))), ""))
    return found.select(*(words.alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
