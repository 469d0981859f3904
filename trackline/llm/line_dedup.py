"""Lines spread over many sites are boilerplate and go; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import cut
from trackline.session import write_shared

MIN_SITES = 5
#: Sketches of 2**12 registers: a relative error of 1.6 %.
SKETCH = 12
#: Estimates within this share of the limit are counted exactly; 15 standard errors.
NEAR = 0.25
#: Up to so many line hashes (8 bytes each) are sent to every task.
SMALL_LINES = 200_000


def lines_of(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: F.Column) -> F.Column:
    """Lines are equal if they are after white space at both ends is cut."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def not_blank(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def spread_lines(pairs: DataFrame, min_sites: int = MIN_SITES, several_texts: bool = False) -> DataFrame:
    """Hashes ``line`` that occur at ``min_sites`` distinct sites or more.

    ``pairs`` has one row per line, ``text_key`` and ``site``. Lines of fewer than ``min_sites``
    such rows cannot qualify and are left out by a count; so are lines of a single text if
    ``several_texts`` are asked for. A HyperLogLog sketch of the sites is built per line where the
    rows are and merged by the aggregation; estimates clear of the limit decide, and lines near
    it get an exact count of distinct sites.
    """
    counted = pairs.groupBy("line").agg(
        F.count("site").alias("rows"), F.min("text_key").alias("first"), F.max("text_key").alias("last")
    )
    enough = F.col("rows") >= min_sites
    if several_texts:
        enough &= F.col("first") < F.col("last")
    often = cut(counted.where(enough).select("line"))
    if often.count() <= SMALL_LINES:
        often = F.broadcast(often)
    candidates = pairs.join(often, "line")
    sketched = cut(
        candidates.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR)).select("line")
    near = sketched.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("line")
    if near.count() <= SMALL_LINES:
        near = F.broadcast(near)
    exact = (
        candidates.join(near, "line")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line")
    )
    return cut(sure.union(exact))


def find_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    several_texts: bool = False,
) -> DataFrame:
    """Per text (its hash ``text_key``) the hashes of its lines that are boilerplate, as ``bad``.

    Every site of every row counts, so the lines of a text that is copied between enough sites are
    boilerplate as well, unless ``several_texts`` are asked for. Only hashes are shuffled. A line
    in a third of all texts is spread by (line, text, site) first, and reaches later steps as one
    row per task.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.xxhash64(whole).alias("text_key"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.explode(lines_of(whole)).alias("raw"),
    )
    pairs = write_shared(
        rows.where(not_blank(F.col("raw")))
        .select(line_hash(F.col("raw")).alias("line"), "text_key", "site")
        .distinct(),
        "line-pairs",
    )
    bad = spread_lines(pairs, min_sites, several_texts)
    if bad.count() <= SMALL_LINES:
        bad = F.broadcast(bad)
    return pairs.join(bad, "line").groupBy("text_key").agg(F.collect_set("line").alias("bad"))


def clean(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    several_texts: bool = False,
) -> DataFrame:
    """Every row as struct ``row``, with ``n_lines``, ``n_removed`` and the ``cleaned`` text.

    Lines that stand on ``min_sites`` distinct sites go; with ``several_texts``, only if they
    stand in more than one text.

    Lines are split at line feeds and compared without white space at their ends; blank lines stay
    and are not counted. Null and empty texts have no lines and stay as they are. A null site is
    a site of its own. Repeated rows are cleaned alike. Rows travel as one struct, so other columns
    may have any names. An empty table gives no rows.
    """
    bad = cut(find_boilerplate(docs, text, site, min_sites, several_texts))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    )
    lines = lines_of(F.col("text"))
    left = F.filter(lines, lambda x: ~(not_blank(x) & F.array_contains(F.col("bad"), line_hash(x))))
    words = F.size(F.filter(lines, not_blank)).cast("long")
    return keyed.join(bad, "text_key", "left").select(
        "row",
        words.alias("n_lines"),
        F.when(F.col("bad").isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long").alias("n_removed"),
        F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("cleaned"),
    )


def remove_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    several_texts: bool = False,
) -> DataFrame:
    """The documents with cleaned texts, all other columns as they were."""
    done = clean(docs, text, site, min_sites, several_texts)
    return done.select(*(F.col("cleaned").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
