"""Helpers shared by the operators: table access, shared checkpoints, connected components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackline.session import shared_dir, write_shared

#: A word, in the regular expressions of Java, Python and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Tasks of a local session find this package where the driver found it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint: computed once, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: F.Column) -> F.Column:
    """Number of words (null text: 0), inside generated code."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "a")
    return F.regexp_count(marks, F.lit("a")).cast("long")


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Connected components of undirected links between long keys.

    Returns ``node``, ``root`` for every key that occurs in a link; root is the smallest key of
    the component. In each round a node takes the smallest of its neighbours' labels and of the
    label of its label, and passes it on to the node that it is labelled with, so long chains
    shrink by powers of two. A round is one job over narrow rows, written to the shared folder; a
    node with very many links is reduced on the map side, and its joins can be split.
    """
    a, b = F.col(src), F.col(dst)
    pairs = links.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    edges = write_shared(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = write_shared(
        edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels"
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        found = labels.join(near, "node").join(up, "root").select("node", "root", F.least("near", "up").alias("label"))
        told = found.groupBy(F.col("root").alias("node")).agg(F.min("label").alias("told"))
        step = found.join(told, "node", "left").select(
            "node", F.least("label", F.coalesce("told", "label")).alias("label"), "root"
        )
        changed = Observation()
        step = step.observe(changed, F.count_if(F.col("label") != F.col("root")).alias("n"))
        labels = write_shared(step.select("node", F.col("label").alias("root")), "labels")
        if not changed.get["n"]:
            return labels
