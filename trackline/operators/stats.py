"""Statistics of page charts: histograms, boxes, modes, shares, quantile classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.operators.quantiles import percentiles_by_group


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the greatest value; the last one is closed.

    Only bins that hold a value are returned. All values are counted, none are sampled.
    """
    return histograms(df, [column], bins).drop("metric")


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Histograms of several columns: one pass for all extents, one for all counts."""
    extent = df.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"{c}_low") for c in columns],
            *[F.max(F.col(c).cast("double")).alias(f"{c}_high") for c in columns],
        )
    ).scalar()
    entries = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(c).cast("double").alias("_v"),
            extent[f"{c}_low"].alias("_low"),
            extent[f"{c}_high"].alias("_high"),
        )
        for c in columns
    ]
    long = df.select(F.inline(F.array(*entries))).where(F.col("_v").isNotNull())
    width = (F.col("_high") - F.col("_low")) / F.lit(bins)
    index = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1))
    )
    return (
        long.groupBy("metric", index.cast("bigint").alias("bin"), "_low", width.alias("_width"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "metric",
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("lower"),
            (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("upper"),
            "count",
        )
    )


def unpivot(
    df: DataFrame, columns: dict[str, str], name: str, value: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Wide to long: one row per (row, column) with the label of the column; NULLs are dropped."""
    entries = [
        F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries))).where(F.col(value).isNotNull())


def five_numbers(prefix: str) -> Column:
    """[min, q1, median, q3, max] of the columns made by ``box_columns``."""
    return F.array(*[F.col(f"{prefix}_{s}") for s in ("min", "q1", "median", "q3", "max")])


def box_statistics(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    group_rows: int | None = None,
) -> DataFrame:
    """Five-number summary of ``{prefix: column}`` per group, in one aggregation."""
    outputs, extra = {}, []
    for prefix, column in columns.items():
        extra += [F.min(column).alias(f"{prefix}_min"), F.max(column).alias(f"{prefix}_max")]
        for label, fraction in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            outputs[f"{prefix}_{label}"] = (column, fraction)
    return percentiles_by_group(df, keys, outputs, extra, group_rows)


def tukey_box(
    df: DataFrame, keys: Sequence[str], column: str, reach: float = 1.5
) -> tuple[DataFrame, DataFrame]:
    """Quartiles, whiskers (farthest values within ``reach`` IQR of the box), and the outliers."""
    values = df.where(F.col(column).isNotNull())
    quartiles = percentiles_by_group(
        values,
        keys,
        {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)},
        [F.count(F.lit(1)).alias("n")],
    )
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(column).between(
        F.col("q1") - F.lit(reach) * iqr, F.col("q3") + F.lit(reach) * iqr
    )
    joined = values.join(quartiles, list(keys)).withColumn("_inside", inside)
    value = F.col(column)
    boxes = joined.groupBy(*keys, "q1", "median", "q3", "n").agg(
        F.min(F.when(F.col("_inside"), value)).alias("whisker_low"),
        F.max(F.when(F.col("_inside"), value)).alias("whisker_high"),
        F.count_if(~F.col("_inside")).alias("outliers"),
    )
    outliers = joined.where(~F.col("_inside")).select(*df.columns)
    return boxes, outliers


def modal_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counted: Sequence[Column] = (),
    also_by: Sequence[str] = (),
    instances: Column | None = None,
) -> DataFrame:
    """The most frequent value per key, the lowest one on a tie, and its share of the key's rows.

    ``counted`` names further aggregates per (key, value); ``also_by`` columns are counted apart
    and break ties after the value; ``instances`` is the number of rows where ``df`` holds counts
    of them. Rows are combined to counts before the first shuffle and counts to one row per key
    before the second, so no key is gathered as a whole.
    """
    instances = F.count(F.lit(1)) if instances is None else instances
    counts = df.groupBy(*keys, *also_by, value).agg(instances.alias("instances"), *counted)
    found = [c for c in counts.columns if c not in keys]
    order = [-F.col("instances")]
    for c in (value, *also_by):
        order += [F.col(c).isNull(), F.col(c)]
    best = counts.groupBy(*keys).agg(
        F.min_by(F.struct(*found), F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias(
            "_best"
        ),
        F.sum("instances").alias("_total"),
    )
    return best.select(
        *keys,
        "_best.*",
        (F.col("_best.instances") / F.nullif(F.col("_total"), F.lit(0))).alias("share"),
    )


def quantile_class(df: DataFrame, column: str, classes: int = 5) -> DataFrame:
    """Class 0 .. classes-1 by the quantiles of the whole column: thresholds not above the value."""
    names = [f"_t{i}" for i in range(1, classes)]
    thresholds = percentiles_by_group(
        df, [], {n: (column, i / classes) for i, n in enumerate(names, start=1)}
    )
    row = thresholds.select(F.struct(*names)).scalar()
    above = sum((F.col(column) >= row[n]).cast("int") for n in names)
    return df.withColumn("quantile_class", above)
