"""Removal of word windows that an earlier document holds, with a count-min sketch as prefilter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.blocks import in_blocks, text_bytes
from trackline.llm.suffix_dedup import BASES, Hashes

#: Words of a window.
WINDOW = 50
#: Text bytes whose windows meet in one merged sketch.
SHARD_BYTES = 1 << 22
#: Rows of the sketch, as odd multipliers of 32 bits.
ROWS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Cells of a row for every code that it counts, at least.
CELLS = 4
#: Distinct words the memo holds before it starts anew; about 150 bytes each.
MEMO_WORDS = 1_000_000
#: A null key counts as the largest.
NULL_KEY = np.iinfo(np.int64).max


class WordHashes(dict):
    """Hash of every distinct word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


MEMO = WordHashes()


class Groups:
    """Equal pairs of hashes of a list, ordered by hash, with the least key of each group."""

    def __init__(self, high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> None:
        self.order = np.argsort(high)
        high_sorted, low_sorted = high[self.order], low[self.order]
        new = high_sorted[1:] != high_sorted[:-1]
        other = low_sorted[1:] != low_sorted[:-1]
        if (other & ~new).any():
            self.order = np.lexsort((low, high))
            high_sorted, low_sorted = high[self.order], low[self.order]
            new = (high_sorted[1:] != high_sorted[:-1]) | (low_sorted[1:] != low_sorted[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(high) else np.zeros(0, dtype=np.int64)
        self.keys = keys[self.order]
        self.high, self.low = high_sorted[starts], low_sorted[starts]
        self.first = np.minimum.reduceat(self.keys, starts) if len(high) else keys[:0]
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(high))))


class Windows:
    """All windows of a block of documents: where they start, and their groups."""

    def __init__(self, docs: pa.Table, window: int) -> None:
        self.words = [text.encode().split() for text in docs.column("text").to_pylist()]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        hashes = MEMO.of([w for words in self.words for w in words])
        keys = docs.column("key").combine_chunks().cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
        left = np.repeat(self.ends, sizes) - np.arange(len(hashes))
        self.starts = np.flatnonzero(left >= window)
        high, low = (Hashes(hashes, base).at(self.starts, window) for base in BASES)
        self.groups = Groups(high, low, np.repeat(keys, sizes)[self.starts])

    def shards(self, bits: int) -> np.ndarray:
        """First group of each shard, and the number of groups; a shard is a range of hashes."""
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, dtype=np.uint64)
        return np.append(np.searchsorted(self.groups.high, edges), len(self.groups.high))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def longs(values: list[int]) -> pa.Array:
    return pa.array(values, type=pa.int64())


def bits_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def estimates(codes: np.ndarray) -> np.ndarray:
    """Count-min estimate of every code: never less than how often the code is in the list."""
    width = max(10, int(CELLS * max(len(codes), 1) - 1).bit_length())
    found = None
    for odd in ROWS:
        mixed = (codes ^ (codes >> np.uint32(15))) * np.uint32(odd)
        cell = (mixed >> np.uint32(max(32 - width, 0))).astype(np.int64)
        counts = np.bincount(cell)[cell]
        found = counts if found is None else np.minimum(found, counts)
    return found


def drop_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove the words of every window that also starts in a document with a smaller key.

    A window is ``window`` consecutive words of one document; words are runs of other characters
    than ASCII white space, compared unchanged. All windows are judged on the input.

    1. Documents lie in blocks of bounded size. The sketch of a block holds one count for each of
       its distinct windows. Almost all its cells are empty, so it travels as a list of codes of
       32 bits that name its cells, cut into shards by ranges of the window's hash. The number of
       shards follows from the bytes of the table.
    2. A shard adds the sketches of all blocks (three rows, at least four cells a code) and
       answers one bit for each code: whether the estimate is two or more. An estimate is never
       less than the count, so no window that stands in two blocks is lost.
    3. Only windows estimated repeated send their hash of 128 bits and their least key, and each
       shard groups them exactly. It answers one bit: whether another block holds a smaller key.
       Windows that repeat inside a block need no message.

    A window of a third of all documents sends one code a block, so no group is hot; blocks are
    exchanged once and read three times. Returns the key, ``n_words``, ``n_removed`` and the
    ``kept`` words joined by one space, one row for each row of ``docs``.

    Keys are integers; a null key counts as larger than all others, and rows of equal keys do not
    remove each other's words. A null text has no words. Texts shorter than a window stay. An
    empty table gives no rows. Other columns are not carried, so their names do not matter.
    """
    bits = max(text_bytes(docs, text) // SHARD_BYTES, 1).bit_length() - 1
    blocks = in_blocks(docs, key, text)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )

    def block_codes(table: pa.Table) -> pa.Table:
        found = Windows(table, window)
        at = found.shards(bits)
        codes = ((found.groups.high << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        full = np.flatnonzero(np.diff(at))
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": longs([block] * len(full)),
                "shard": longs(full.tolist()),
                "codes": binaries([codes[at[s] : at[s + 1]].tobytes() for s in full]),
            }
        )

    def merge_sketches(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c, dtype="<u4") for c in table.column("codes").to_pylist()]
        often = estimates(np.concatenate(codes)) >= 2
        parts = np.split(often, np.cumsum([len(c) for c in codes])[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "often": binaries([np.packbits(p).tobytes() for p in parts]),
            }
        )

    def block_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and answers.num_rows:
            found = Windows(table, window)
            at, g = found.shards(bits), found.groups
            block = table.column("block")[0].as_py()
            for shard, often in zip(answers.column("shard").to_pylist(), answers.column("often").to_pylist()):
                part = np.flatnonzero(bits_of(often, at[shard + 1] - at[shard])) + at[shard]
                if len(part):
                    rows.append(
                        (block, shard, often, g.high[part].tobytes(), g.low[part].tobytes(), g.first[part].tobytes())
                    )
        columns = list(zip(*rows)) or [()] * 6
        names = ["block", "shard", "often", "high", "low", "first"]
        return pa.table([*map(longs, columns[:2]), *map(binaries, columns[2:])], names=names)

    def group_exactly(table: pa.Table) -> pa.Table:
        high, low, first = (
            [np.frombuffer(c, dtype=kind) for c in table.column(name).to_pylist()]
            for name, kind in (("high", np.uint64), ("low", np.uint64), ("first", np.int64))
        )
        groups = Groups(np.concatenate(high), np.concatenate(low), np.concatenate(first))
        late = np.zeros(len(groups.order), dtype=bool)
        late[groups.order] = groups.keys > groups.first[groups.group]
        parts = np.split(late, np.cumsum([len(c) for c in high])[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "often": table.column("often"),
                "late": binaries([np.packbits(p).tobytes() for p in parts]),
            }
        )

    def block_texts(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = Windows(table, window)
        at, g = found.shards(bits), found.groups
        late = np.zeros(len(g.high), dtype=bool)
        for shard, often, bad in zip(*(answers.column(c).to_pylist() for c in ("shard", "often", "late"))):
            part = np.flatnonzero(bits_of(often, at[shard + 1] - at[shard])) + at[shard]
            late[part] = bits_of(bad, len(part))
        gone = found.starts[g.order[(g.keys > g.first[g.group]) | late[g.group]]]
        n = int(found.ends[-1])
        cover = np.bincount(gone, minlength=n + 1) - np.bincount(gone + window, minlength=n + 1)
        keep = np.cumsum(cover)[:n] == 0
        removed, kept = [], []
        for words, stop in zip(found.words, found.ends.tolist()):
            mine = keep[stop - len(words) : stop]
            n_kept = int(mine.sum())
            removed.append(len(words) - n_kept)
            kept.append(b" ".join(words if n_kept == len(words) else compress(words, mine.tolist())).decode())
        return pa.table(
            [
                table.column("key"),
                longs([len(w) for w in found.words]),
                longs(removed),
                pa.array(kept, type=pa.string()),
            ],
            names=schema.names,
        )

    codes = blocks.groupBy("block").applyInArrow(block_codes, "block long, shard long, codes binary")
    often = codes.groupBy("shard").applyInArrow(merge_sketches, "block long, shard long, often binary")
    sent = (
        blocks.groupBy("block")
        .cogroup(often.groupBy("block"))
        .applyInArrow(
            block_windows, "block long, shard long, often binary, high binary, low binary, first binary"
        )
    )
    late = sent.groupBy("shard").applyInArrow(group_exactly, "block long, shard long, often binary, late binary")
    return blocks.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(block_texts, schema)
