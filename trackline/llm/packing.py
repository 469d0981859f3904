"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.words import WordTokenizer

WINDOW = 4096
END_ID = 2
#: Rests that wait for a window before windows are filled from them.
POOL = 256
#: Texts tokenised at a time.
TEXTS = 256
#: Sequence numbers of one task.
TASK_SEQUENCES = 1 << 40


def best_fill(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The multiset of the given (length, count) that fills ``room`` closest, as length -> copies.

    Bit s of a state is set where some choice sums to s. Copies of a length join in doubling
    steps; each step keeps the state before it, so the way back yields the copies taken.
    """
    mask, state = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in lengths:
        taken = 1
        while count and length <= room and not state >> room & 1:
            taken = min(taken, count)
            steps.append((length, taken, state))
            state |= state << length * taken & mask
            count -= taken
            taken *= 2
    total, chosen = state.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + taken
            total -= length * taken
    return chosen


class Packer:
    """Fills windows of one task; documents come in, (document, start, length, sequence, offset) go out."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.rests: dict[int, list[tuple[object, int]]] = {}
        self.count = 0
        self.total = 0

    def add(self, doc: object, size: int) -> Iterator[tuple]:
        """Whole windows of a long document are sequences by themselves; its rest waits."""
        start = 0
        while size - start >= self.window:
            yield from self._close([(doc, start, self.window)])
            start += self.window
        if start < size:
            self._wait(doc, start, size - start)
        if self.count >= POOL:
            while self.count > POOL // 2 and self.total >= self.window:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        """Full windows as long as tokens last, then sequences of powers of two."""
        while self.total >= self.window:
            yield from self._fill()
        size = 1 << self.window.bit_length()
        while self.total:
            while size > self.total:
                size //= 2
            pieces, room = [], size
            while room:
                doc, start, length = self._take(max(self.rests))
                pieces.append((doc, start, min(length, room)))
                if length > room:
                    self._wait(doc, start + room, length - room)
                room -= pieces[-1][2]
            yield from self._close(pieces)

    def _wait(self, doc: object, start: int, length: int) -> None:
        self.rests.setdefault(length, []).append((doc, start))
        self.count += 1
        self.total += length

    def _take(self, length: int) -> tuple[object, int, int]:
        waiting = self.rests[length]
        doc, start = waiting.pop(0)
        if not waiting:
            del self.rests[length]
        self.count -= 1
        self.total -= length
        return doc, start, length

    def _fill(self) -> Iterator[tuple]:
        """The longest rest, the choice of others with the least slack, and a cut for that slack."""
        pieces = [self._take(max(self.rests))]
        room = self.window - pieces[0][2]
        lengths = sorted(((n, len(w)) for n, w in self.rests.items()), reverse=True)
        for length, copies in best_fill(lengths, room).items():
            for _ in range(copies):
                pieces.append(self._take(length))
                room -= length
        while room and self.rests:
            doc, start, length = self._take(max(self.rests))
            pieces.append((doc, start, min(length, room)))
            if length > room:
                self._wait(doc, start + room, length - room)
            room -= pieces[-1][2]
        yield from self._close(pieces)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.sequence, offset
            offset += length
        self.sequence += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A document is its token ids and then ``end_id``. Whole windows of long documents stand alone;
    the rests of each task wait in a pool, and every window takes the longest rest and the
    multiset of other rests whose sum comes closest to the room left (a subset sum over bitsets,
    with the copies of each length found on the way back). A window that no choice fills is
    completed by cutting one more rest; the last tokens of a task form sequences whose lengths
    are powers of two, so nothing is padded. Tasks pack what they read: there is no shuffle, and
    a task holds the ids of its pool only. A task that runs again gives the same rows.

    Returns one row per piece: the key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and ``ids`` (array of int) if ``with_ids``. A null text is empty
    and has one token. Rows that repeat are packed each by itself, also with a null key. An empty
    table gives no rows. Other columns are not carried, so their names do not matter.
    """
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [
        T.StructField(key, docs.schema[key].dataType),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() * TASK_SEQUENCES)
        kind = None

        def rows(pieces: Iterator[tuple]) -> pa.RecordBatch | None:
            made = [
                (doc[0], start, length, zlib.crc32(part.tobytes()), len(doc[1]), sequence, offset, *([part] if with_ids else ()))
                for doc, start, length, sequence, offset in pieces
                for part in [doc[1][start : start + length]]
            ]
            if not made:
                return None
            columns = list(zip(*made))
            arrays = [pa.array(columns[0], type=kind), *(pa.array(c, type=pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([c.astype("int32") for c in columns[7]], type=pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = coder.encode(part.column(1).to_pylist())
                pieces: list[tuple] = []
                for doc, found in zip(part.column(0).to_pylist(), ids):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    pieces.extend(packer.add((doc, whole), len(whole)))
                if (out := rows(pieces)) is not None:
                    yield out
        if kind is not None and (out := rows(packer.finish())) is not None:
            yield out

    return chosen.mapInArrow(run, T.StructType(fields))
