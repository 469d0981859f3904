"""A corpus pipeline over ``documents``: clean, deduplicate, mix and pack, one written table per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackline.llm import bagminhash, line_dedup, mixing, packing, quality_rules
from trackline.llm.common import table
from trackline.llm.queries import TOKENIZER
from trackline.session import remove_at_end, shared_dir


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that they remove."""
    return quality_rules.keep_clean(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate across sources.

    Lines of a single text stay: a text that is copied between sources would lose every line, and
    the next stage could not keep one of the copies.
    """
    return line_dedup.remove_boilerplate(docs, several_texts=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Signatures and token ids have no SQL form; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """All stages; every stage's rows are written to the shared folder and read again by the next.

    ``work`` names a folder for the stages of one run over one set of tables. A stage that is
    finished there is read instead of computed, so a run that was cut off goes on where it
    stopped. Without it the stages go to a folder of their own that is removed when the driver ends.
    """
    base = work or remove_at_end(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base.rstrip('/')}/{number}-{name}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
