"""Alignment of the tokens of two tokenizers by pointer jumping, with corpus counts of id pairs."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trackline.llm.blocks import TASK_BLOCKS
from trackline.llm.words import PLAIN, byte_letters
from trackline.session import write_shared

#: How byte-level files of this kind split texts, written so that no match is taken back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts encoded at a time.
TEXTS = 128
#: Text bytes after which a block is closed; a longer text is a block by itself. Their tokens are
#: held as arrays, about a hundred bytes for each byte of text.
BLOCK_BYTES = 1 << 19


class ByteTokenizer:
    """Ids of a byte-level vocabulary file without special tokens, and the bytes of every id.

    Where the file ranks its merges by id and changes no text, plain texts (``words.PLAIN``) are
    encoded by ranks, which gives the same ids several times as fast; other texts are encoded by
    the file's own library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        vocab = spec["model"]["vocab"] | added
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.fast = None
        if self._ranks_merges(spec):
            ranks = {self.bytes[i]: i for i in vocab.values() if i not in added.values()}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self) -> Tokenizer:
        """The file's own library, loaded when a text first needs it."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library

    @staticmethod
    def _ranks_merges(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return False
        if not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
            return False
        if model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))

    def encode(self, text: str) -> list[int]:
        if self.fast and PLAIN.match(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """Ids of a piece model, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)])
            if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def label_type(labels: int) -> str:
    return "<u2" if labels <= 1 << 16 else "<u4"


_LOADED: dict[tuple[str, str], tuple[ByteTokenizer, PieceTokenizer]] = {}


def load(byte_file: str, piece_file: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    """Both tokenizers, read once per Python worker."""
    found = _LOADED.get((byte_file, piece_file))
    if found is None:
        found = _LOADED[byte_file, piece_file] = ByteTokenizer(byte_file), PieceTokenizer(piece_file)
    return found


def id_type(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


class Alignment:
    """Tokens a and b of the same bytes: the pairs that overlap, in order, and their groups.

    ``pair_a`` and ``pair_b`` are the places of the two tokens of every link, ``ends_a`` marks the
    last link of every token a, ``last`` the last link of every group. A link ends a token b if it
    ends a group or no token a.
    """

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray) -> None:
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        n = len(end_a)
        marks = np.zeros((2, int(end_a[-1]) + 1), dtype=bool)
        marks[0, end_a] = marks[1, end_b] = True
        ends = np.flatnonzero(marks[0] | marks[1])
        self.ends_a, ends_b = marks[0, ends], marks[1, ends]
        # A link ends where a token of either side ends, and holds the tokens that are open there.
        self.pair_a, self.pair_b = np.cumsum(self.ends_a) - self.ends_a, np.cumsum(ends_b) - ends_b
        # Every token points to the one that overlaps it and ends last. Where none ends behind it,
        # a points to itself, and b to the a that ends with it.
        points = np.concatenate([np.arange(n), self.pair_a[ends_b]])
        points[:n] = np.where(ends_b[self.ends_a], points[:n], self.pair_b[self.ends_a] + n)
        while True:
            further = points[points]
            if np.array_equal(further, points):
                break
            points = further
        group = points[self.pair_a]
        self.last = np.append(group[1:] != group[:-1], True)


def packed(values: np.ndarray) -> bytes:
    """Numbers, or bits, in few bytes: all first bytes, then all second bytes, compressed."""
    if values.dtype == bool:
        return zstandard.compress(np.packbits(values).tobytes(), 1)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes(), 1)


def unpacked_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(raw), dtype=np.uint8), count=n).astype(bool)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class GroupText:
    """Groups as text: ids of a, a bar, ids of b, groups parted by semicolons."""

    def __init__(self, ids: int) -> None:
        self.ids = ids
        self.shown = np.array([sign + str(i) for sign in ",;|" for i in range(ids)], dtype=object)

    def parts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """One part for each token, in order of groups; the first one begins with a semicolon."""
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        first = np.append(True, side[1:] != side[:-1])
        sign = np.where(first, 1 + (side & 1), 0)
        return self.shown[np.concatenate([a, b]).astype(np.int64)[order] + sign * self.ids].tolist()


def align(
    docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Align the tokens that two tokenizers give for every text.

    The byte-level tokenizer encodes a space and the text, the piece tokenizer the text, to
    which it adds the space itself; neither sees special tokens. Byte offsets at which tokens of
    both end cut the tokens into groups. Every token points to its farthest-right overlapping
    token, and doubling of the pointers leads all tokens of a group to its terminal token.

    Texts are encoded once, in blocks of bounded size. A block is kept as the list of its distinct
    id pairs, how many links hold each, and the number of the pair of every link, compressed. Sums over the corpus are plain
    aggregations of those; each block then gets back the sums of its own pairs by a join, so no
    table of all pairs goes through the driver or one task, and a pair that stands in every block
    brings one row a block.

    Returns the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (overlapping pairs), ``n_best``
    (links whose pair is the most frequent one of its piece id in the corpus, or ties with it),
    ``count_sum`` (corpus counts of the pairs of all links) and ``groups`` as text. A null or
    empty text, and one that the tokens of either tokenizer do not spell byte for byte, has no
    tokens: zeros and an empty string. Rows that repeat, also with a null key, are aligned each
    by itself and count each. An empty table gives no rows. Other columns are not carried, so
    their names do not matter.
    """
    sizes = [np.array([len(t) for t in x.bytes]) for x in load(byte_file, piece_file)]
    size_a, size_b = sizes
    kinds = [id_type(len(size)) for size in sizes]
    kind = docs.schema[key].dataType
    by_block = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("n_a", T.ArrayType(T.LongType())),
            T.StructField("n_b", T.ArrayType(T.LongType())),
            T.StructField("codes", T.ArrayType(T.LongType())),
            T.StructField("links", T.ArrayType(T.LongType())),
            T.StructField("labels", T.BinaryType()),
            T.StructField("ends_a", T.BinaryType()),
            T.StructField("last", T.BinaryType()),
        ]
    )
    result = T.StructType(
        [
            T.StructField(key, kind),
            *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
            T.StructField("groups", T.StringType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = load(byte_file, piece_file)
        spell_a, spell_b = first.bytes.__getitem__, second.bytes.__getitem__
        block = TaskContext.get().partitionId() * TASK_BLOCKS
        keys: list[pa.Array] = []
        ids_a: list[np.ndarray] = []
        ids_b: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            a, b = np.concatenate(ids_a), np.concatenate(ids_b)
            codes = links = np.zeros(0, dtype=np.int64)
            labels, ends_a, last = np.zeros(0, dtype=label_type(0)), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
            if len(a):
                found = Alignment(size_a[a], size_b[b])
                pairs = a[found.pair_a].astype(np.int64) * len(size_b) + b[found.pair_b]
                codes, place, links = np.unique(pairs, return_inverse=True, return_counts=True)
                # Frequent pairs get small numbers, which take few bytes.
                order = np.argsort(-links, kind="stable")
                number = np.empty(len(order), dtype=label_type(len(codes)))
                number[order] = np.arange(len(order))
                codes, links, labels = codes[order], links[order], number[place]
                ends_a, last = found.ends_a, found.last
            row = [pa.array([block]), one_list(pa.concat_arrays(keys))]
            row += [one_list(pa.array([len(i) for i in x], type=pa.int64())) for x in (ids_a, ids_b)]
            row += [one_list(pa.array(x, type=pa.int64())) for x in (codes, links)]
            row += [pa.array([packed(x)], type=pa.binary()) for x in (labels, ends_a, last)]
            return pa.RecordBatch.from_arrays(row, names=by_block.names)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = part.column(1).to_pylist()
                for i, (t, b) in enumerate(zip(texts, second.encode(texts))):
                    want = (" " + t).encode()
                    a = first.encode(" " + t) if t and b"".join(map(spell_b, b)) == want else []
                    if a and b"".join(map(spell_a, a)) != want:
                        a = []
                    keys.append(part.column(0).slice(i, 1))
                    ids_a.append(np.array(a, dtype=kinds[0]))
                    ids_b.append(np.array(b if a else [], dtype=kinds[1]))
                    held += len(want)
                    if held >= BLOCK_BYTES:
                        yield close()
                        block, held = block + 1, 0
                        keys, ids_a, ids_b = [], [], []
        if keys:
            yield close()

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0] for c in table.column_names}
        n_a, n_b, codes, links = (
            row[c].values.to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "codes", "links")
        )
        zeros = [0] * len(n_a)
        columns, texts = [n_a, n_b, zeros, zeros, zeros, zeros], [""] * len(n_a)
        if len(codes):
            label = unpacked(row["labels"].as_py(), label_type(len(codes)))
            ends_a, last = (unpacked_bits(row[c].as_py(), len(label)) for c in ("ends_a", "last"))
            code, total, best = (
                answers.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("code", "total", "best")
            )
            order = np.argsort(code)
            at = order[np.searchsorted(code, codes, sorter=order)]
            total, best = total[at][label], best[at][label]
            stops = np.append(0, np.flatnonzero(ends_a) + 1)
            edges = stops[np.append(0, np.cumsum(n_a))]
            sums = [np.append(0, np.cumsum(x, dtype=np.int64))[edges] for x in (last, best, total)]
            groups, n_best, counts = map(np.diff, sums)
            columns = [n_a, n_b, groups, np.diff(edges), n_best, counts]
            group = np.cumsum(last) - last
            of_a, of_b = np.flatnonzero(ends_a), np.flatnonzero(last | ~ends_a)
            ids_a, ids_b = codes[label[of_a]] // len(size_b), codes[label[of_b]] % len(size_b)
            shown = group_text(max(len(size_a), len(size_b))).parts(ids_a, ids_b, group[of_a], group[of_b])
            stops = np.cumsum(n_a + n_b).tolist()
            texts = ["".join(shown[lo:hi])[1:] for lo, hi in zip([0, *stops], stops)]
        return pa.table(
            [row["keys"].values, *(pa.array(c, type=pa.int64()) for c in columns), pa.array(texts, type=pa.string())],
            names=result.names,
        )

    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = write_shared(chosen.mapInArrow(encode, by_block), "tokens")
    pairs = tokens.select(F.col("block").alias("at"), F.explode(F.arrays_zip("codes", "links")).alias("x"))
    pairs = pairs.select("at", F.col("x.codes").alias("code"), F.col("x.links").alias("links"))
    counts = pairs.groupBy("code").agg(F.sum("links").alias("total"))
    counts = write_shared(counts.withColumn("second", F.col("code") % len(size_b)), "pair-counts")
    most = counts.groupBy("second").agg(F.max("total").alias("most"))
    ranked = counts.join(most, "second").select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = pairs.select("at", "code").join(ranked, "code")
    return (
        tokens.groupBy("block")
        .cogroup(answers.groupBy("at"))
        .applyInArrow(finish, result)
    )


_SHOWN: dict[int, GroupText] = {}


def group_text(ids: int) -> GroupText:
    if ids not in _SHOWN:
        _SHOWN[ids] = GroupText(ids)
    return _SHOWN[ids]


def one_list(values: pa.Array) -> pa.Array:
    """The values as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)
