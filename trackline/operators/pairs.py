"""Full outer join of two parts of the same rows, from one read and one exchange of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.session import write_shared

#: Rows of one side that one cell holds.
MAX_CELL_ROWS = 1000


def self_full_join(
    rows: DataFrame, on: Sequence[str], left: Column, right: Column, max_rows: int = MAX_CELL_ROWS
) -> DataFrame:
    """Every pair of a left and a right part of rows with equal ``on``, and parts without a partner.

    ``left`` and ``right`` are structs made of columns of a row, NULL where the row has no such
    part. The rows of a key meet in a grid of cells: with n left and m right parts it has
    ceil(n / max_rows) by ceil(m / max_rows) cells, each left part goes to one line of the grid and
    each right part to one column. Almost every key has one cell. Keys with more are counted
    before, so a key of a third of all rows is spread over as many tasks as it has cells, and no
    cell grows. Pairs leave a cell one by one; a part whose key the other side lacks leaves alone.
    NULL in a key matches nothing.

    Returns ``on``, ``left`` and ``right``. Numbers of cells follow from row numbers, so ``rows``
    has to come in the same order when a task runs again, as a stored table does.
    """
    on = list(on)
    sided = rows.select(*on, left.alias("left"), right.alias("right"))
    sided = sided.where(F.col("left").isNotNull() | F.col("right").isNotNull())
    sizes = [F.count("left").alias("_lefts"), F.count("right").alias("_rights")]
    counted = sided.groupBy(*on).agg(*sizes)
    fullest = counted.agg(F.max(F.greatest("_lefts", "_rights"))).first()[0] or 0
    if fullest <= max_rows:
        cells = sided.groupBy(*on).agg(
            F.collect_list("left").alias("_left"), F.collect_list("right").alias("_right"), *sizes
        )
    else:
        full = write_shared(counted.where(F.greatest("_lefts", "_rights") > max_rows), "full-keys")
        one = F.lit(1).cast("bigint")
        known = sided.join(full.dropna(subset=on), on, "left")
        known = known.withColumns(
            {c: F.greatest(F.ceil(F.col(n) / max_rows).cast("bigint"), one) for c, n in (("_lines", "_lefts"), ("_columns", "_rights"))}
        ).fillna(1, ["_lines", "_columns"])
        # Parts of a key of NULL meet nobody, so they may lie in any cell.
        null = F.lit(False)
        for c in on:
            null = null | F.col(c).isNull()
        spread = F.xxhash64(F.monotonically_increasing_id(), F.lit("line"))
        known = known.withColumns(
            {
                "_line": F.when(null, F.pmod(spread, one * 1024)).otherwise(F.pmod(spread, F.col("_lines"))),
                "_column": F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("column")), F.col("_columns")),
            }
        )

        def cell(line: Column, column: Column, first: Column, second: Column) -> Column:
            return F.struct(line.alias("_i"), column.alias("_j"), first.alias("left"), second.alias("right"))

        nothing_left, nothing_right = (F.lit(None).cast(sided.schema[c].dataType) for c in ("left", "right"))
        none = F.array().cast(f"array<struct<_i:bigint,_j:bigint,left:{sided.schema['left'].dataType.simpleString()},right:{sided.schema['right'].dataType.simpleString()}>>")
        lines, columns = (F.sequence(one * 0, F.col(c) - 1) for c in ("_lines", "_columns"))
        to_cells = F.concat(
            F.when(
                F.col("left").isNotNull(),
                F.transform(columns, lambda j: cell(F.col("_line"), j, F.col("left"), nothing_right)),
            ).otherwise(none),
            F.when(
                F.col("right").isNotNull(),
                F.transform(lines, lambda i: cell(F.when(null, F.col("_line")).otherwise(i), F.col("_column"), nothing_left, F.col("right"))),
            ).otherwise(none),
        )
        cells = (
            known.select(*on, "_lefts", "_rights", F.inline(to_cells))
            .groupBy(*on, "_i", "_j")
            .agg(
                F.collect_list("left").alias("_left"),
                F.collect_list("right").alias("_right"),
                F.coalesce(F.max("_lefts"), F.count("left")).alias("_lefts"),
                F.coalesce(F.max("_rights"), F.count("right")).alias("_rights"),
            )
        )
    meets = (F.col("_lefts") > 0) & (F.col("_rights") > 0)
    for c in on:
        meets &= F.col(c).isNotNull()
    return _pairs(cells.withColumn("_meets", meets), on)


def _pairs(cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every pair of the lists ``_left`` and ``_right`` of a row that ``_meets``, else each part alone."""
    nothing_left, nothing_right = (F.lit(None).cast(cells.schema[c].dataType.elementType) for c in ("_left", "_right"))
    alone = F.concat(
        F.transform("_left", lambda x: F.struct(x.alias("left"), nothing_right.alias("right"))),
        F.transform("_right", lambda x: F.struct(nothing_left.alias("left"), x.alias("right"))),
    )
    first = F.when(
        F.col("_meets"), F.transform("_left", lambda x: F.struct(x.alias("left"), nothing_right.alias("right")))
    ).otherwise(alone)
    found = cells.select(*on, "_meets", "_right", F.explode(first).alias("_first"))
    partners = F.when(F.col("_meets"), F.col("_right")).otherwise(F.array(nothing_right))
    return found.select(*on, "_meets", "_first", F.explode(partners).alias("_second")).select(
        *on,
        F.col("_first.left").alias("left"),
        F.when(F.col("_meets"), F.col("_second")).otherwise(F.col("_first.right")).alias("right"),
    )


def grouped_sides(
    rows: DataFrame, on: Sequence[str], left: Column, right: Column, max_rows: int = MAX_CELL_ROWS
) -> DataFrame:
    """The parts of ``self_full_join`` in one list a key and side, from which ``pairs_of`` makes the pairs.

    A table of pairs grows with the square of the rows of a key; this one holds every part once, so
    it is what to store. A key with more than ``max_rows`` parts on a side has several rows, over
    which its parts are spread, also where the key is NULL.

    Returns ``on``, ``_left``, ``_right``, the number of rows of the key and the number of this one
    (``_pieces``, ``_piece``), and whether the key has both sides (``_meets``).
    """
    on = list(on)
    sided = rows.select(*on, left.alias("left"), right.alias("right"))
    sided = sided.where(F.col("left").isNotNull() | F.col("right").isNotNull())
    sizes = [F.count("left").alias("_lefts"), F.count("right").alias("_rights")]
    counted = sided.groupBy(*on).agg(*sizes)
    fullest = counted.agg(F.max(F.greatest("_lefts", "_rights"))).first()[0] or 0
    one = F.lit(1).cast("bigint")
    known = sided.withColumn("_pieces", one)
    both = (F.count("left") > 0) & (F.count("right") > 0)
    if fullest > max_rows:
        most = F.greatest("_lefts", "_rights")
        full = counted.where(most > max_rows).select(
            *on,
            F.ceil(most / max_rows).cast("bigint").alias("_pieces"),
            ((F.col("_lefts") > 0) & (F.col("_rights") > 0)).alias("_both"),
        )
        full = write_shared(full, "full-keys")
        match = [sided[c].eqNullSafe(full[c]) for c in on]
        known = sided.join(full, match, "left").select(sided["*"], F.coalesce("_pieces", one).alias("_pieces"), "_both")
        both = F.coalesce(F.max("_both"), both)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_pieces"))
    groups = known.withColumn("_piece", place).groupBy(*on, "_pieces", "_piece").agg(
        F.collect_list("left").alias("_left"), F.collect_list("right").alias("_right"), both.alias("_both")
    )
    meets = F.col("_both")
    for c in on:
        meets &= F.col(c).isNotNull()
    return groups.withColumn("_meets", meets).drop("_both")


def pairs_of(groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """What ``self_full_join`` returns, from a stored table of ``grouped_sides``.

    A key in one row is paired inside the row. The lists of a key in several rows meet in a grid of
    cells, so its pairs are made by as many tasks as it has cells.
    """
    on = list(on)
    spread = (F.col("_pieces") > 1) & F.col("_meets")
    full = groups.where(spread)
    others = F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)
    lefts = full.select(*on, "_left", F.col("_piece").alias("_i"), F.explode(others).alias("_j"))
    rights = full.select(*on, "_right", F.col("_piece").alias("_j"), F.explode(others).alias("_i"))
    cells = lefts.join(rights, [*on, "_i", "_j"]).withColumn("_meets", F.lit(True))
    return _pairs(groups.where(~spread), on).union(_pairs(cells, on))
