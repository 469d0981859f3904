"""Line-first quality rules: bad lines go, and documents that lose too much go with them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
GRAM = 5

#: Lines with one of these are no prose of the document.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "licensed under the",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
)
#: Words with a symbol or a double exclamation mark at their end.
MARKED = re.compile(rb"[#*$%&|<>]|!!$")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict on what they leave."""

    marked_percent: int = 30  #: punctuation: this share of words with symbols or a double exclamation mark
    separators: int = 3  #: navigation: so many separators, and at least one for every ``separated`` words
    separated: int = 4
    lost_percent: int = 40  #: a document that loses more of its words is rejected
    min_words: int = 10
    repeat_percent: int = 20


SEPARATOR_WORDS = frozenset((b"|", b">", b"/", b"\xc2\xbb", b"\xc2\xb7", b"\xe2\x80\xa2"))


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n <= GRAM:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    kinds = len(number)
    if kinds == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    if kinds**GRAM < 1 << 63:
        codes = ids[: n - GRAM + 1].copy()
        for k in range(1, GRAM):
            codes *= kinds
            codes += ids[k : n - GRAM + 1 + k]
    else:
        codes = ids
        for k in range(1, GRAM):
            _, dense = np.unique(codes, return_inverse=True)
            codes = dense[: n - k].astype(np.int64) * kinds + ids[k:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, codes)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == codes)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + GRAM, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def line_fails(words: list[bytes], lowered: str, rules: Rules) -> bool:
    """Whether a line with words breaks the punctuation, navigation or boilerplate rule."""
    separators = sum(w in SEPARATOR_WORDS for w in words)
    if separators >= rules.separators and separators * rules.separated >= len(words):
        return True
    marked = sum(1 for w in words if MARKED.search(w))
    if marked * 100 >= rules.marked_percent * len(words):
        return True
    return any(p in lowered for p in BOILERPLATE)


SUSPECT = re.compile(r"[#*$%&|<>/»·•]|!!|" + "|".join(map(re.escape, BOILERPLATE)))


def judge(text: str, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, str | None, int]:
    """Counts, verdicts, the cleaned text if kept, and the lines removed."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    duplicates = 0
    if len(lines) > 1:
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                duplicates += bool(line.strip(SPACE))
            else:
                seen.add(line)
    repeats = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    if base_failed:
        return n, chars, symbols, duplicates, repeats, True, False, None, 0
    if not SUSPECT.search(text.lower()):
        return n, chars, symbols, duplicates, repeats, False, True, text, 0
    left, lost = [], 0
    for line in lines:
        lowered = line.lower()
        if SUSPECT.search(lowered):
            of_line = line.encode("utf-8", "surrogatepass").split()
            if of_line and line_fails(of_line, lowered, rules):
                lost += len(of_line)
                continue
        left.append(line)
    kept = lost * 100 <= rules.lost_percent * n
    return n, chars, symbols, duplicates, repeats, False, kept, "\n".join(left) if kept else None, len(lines) - len(left)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of every whole text.

    Lines are split at line feeds. A line with words is removed if too many of its words carry
    symbols or double exclamation marks (punctuation), if it is a row of short items between
    separators (navigation), or if it holds a boilerplate phrase. A document is kept unless the
    base rules fail or more than ``lost_percent`` of its words went with removed lines.

    Returns the key, the five counts, ``base_failed``, ``kept``, ``n_lines_removed`` and
    ``cleaned`` (null if rejected). Null and empty texts have no words and fail. Rows stay as they
    are: repeated rows and null keys are judged one by one. Nothing is shuffled; memory is bounded
    by the largest batch. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            *(T.StructField(c, T.LongType()) for c in COUNTS),
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("n_lines_removed", T.LongType()),
            T.StructField("cleaned", T.StringType()),
        ]
    )
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = list(zip(*(judge(t, rules) for t in part.column(1).to_pylist())))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
                arrays = [part.column(0), *(pa.array(c, type=k) for c, k in zip(got[:7], kinds))]
                arrays += [pa.array(got[8], type=pa.int64()), pa.array(got[7], type=pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their cleaned texts, all other columns as they were.

    The whole row travels beside the text as one struct, so columns may have any names.
    """
    judged = assess(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), "row", "text", rules)
    cleaned = judged.where("kept")
    return cleaned.select(*(F.col("cleaned").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
