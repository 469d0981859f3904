"""Documents in numbered blocks of bounded size, so that no later step has a group without a bound."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes after which a block is closed; a longer document is a block by itself.
BLOCK_BYTES = 1 << 21
#: Blocks of one task.
TASK_BLOCKS = 1 << 33


def in_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``block``, ``key``, ``text`` (null: empty): consecutive rows of a task share a block.

    A task that runs again numbers alike, as long as its rows come in the same order: ``docs`` has
    to be a stored table or derived from one without an exchange.
    """
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("text", T.StringType()),
        ]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() * TASK_BLOCKS, 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(1)).to_pylist():
                if held and held + size > block_bytes:
                    block, held = block + 1, 0
                held += size
                numbers.append(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, type=pa.int64()), *batch.columns], names=["block", "key", "text"]
            )

    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return chosen.mapInArrow(number, schema)


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
