"""Periodic runs of words by maximal pairs in the tree of LCP intervals."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words whose suffixes are sorted together; a longer document is sorted by itself.
BATCH_WORDS = 1 << 17
#: Distinct words the memo holds before it starts anew.
MEMO_WORDS = 1_000_000

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
)


class WordNumbers(dict):
    """Number of every distinct word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every key among all, as the place of its first equal, and whether another is equal."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(keys)))
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.repeat(starts, sizes)
    shared = np.empty(len(keys), dtype=bool)
    shared[order] = np.repeat(sizes > 1, sizes)
    return rank, shared


class SuffixRanks:
    """Suffixes of several documents, ranked by ever longer beginnings; documents share none.

    ``words`` holds the documents' word numbers one after another, ``doc`` the document of each
    word. Only suffixes whose first words, at most ``shallow``, occur again in their document are
    ranked further: no other suffix belongs to an interval of so many common words.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, shallow: int) -> None:
        n = len(words)
        bits = max(int(words.max()).bit_length(), 1)
        own, _ = dense((doc << bits) | words)
        # Behind the last word of a document stands a sign of its own, so no suffix goes beyond it.
        last = np.append(doc[1:] != doc[:-1], True)
        gap = np.cumsum(last) - last
        self.place = np.arange(n) + gap
        self.total = n + int(last.sum()) + 2
        first = np.full(self.total, -1, dtype=np.int64)
        first[self.place] = own + int(last.sum()) + 2
        empty = first < 0
        first[empty] = np.arange(int(empty.sum()))
        self.levels: list[tuple[int, np.ndarray]] = [(1, first)]
        size = int(first.max()).bit_length()
        step = min(3 if size * 3 <= 63 else 2, shallow)
        key = first.copy()
        for k in range(1, step):
            key = (key << size) | np.append(first[k:], np.zeros(k, dtype=np.int64))
        rank, shared = dense(key)
        self.levels.append((step, rank))
        self.active = self.repeated = np.flatnonzero(shared)
        length = step
        while len(self.active):
            # A group keeps its place among all; inside it, the part behind the known beginning decides.
            i = self.active
            key = rank[i] * self.total + rank[np.minimum(i + length, self.total - 1)]
            order = np.argsort(key)
            i, key = i[order], key[order]
            group = key // self.total
            at = np.arange(len(i))
            fresh = np.concatenate([[True], group[1:] != group[:-1]])
            offset = at - np.maximum.accumulate(np.where(fresh, at, 0))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(i)))
            rank = rank.copy()
            rank[i] = group + np.repeat(offset[starts], sizes)
            length *= 2
            self.levels.append((length, rank))
            self.active = i[np.repeat(sizes > 1, sizes)]
        self.rank = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at i and j share, by descent through the levels."""
        far = np.zeros(len(i), dtype=np.int64)
        for length, rank in reversed(self.levels):
            for _ in range(2 if length == 1 else 1):
                a, b = np.minimum(i + far, self.total - 1), np.minimum(j + far, self.total - 1)
                far += length * (rank[a] == rank[b])
        return far


def maximal_pairs(
    places: list[int], shared: list[int], left: list[int], least: int, periods: int
) -> list[tuple[int, int, int]]:
    """Maximal pairs (i, j, common words) that are close enough to be runs.

    ``places`` are suffixes in order, ``shared`` the words that each has in common with the one
    before it, ``left`` the class of the word before each. Intervals are closed from the deepest
    up. An interval holds its places as one ascending list, whose members carry their left
    classes, and takes in the shorter lists of its children, so a place moves at most a logarithm
    of times. A pair belongs to the interval in which its two places first meet: it is maximal to
    the right there, and to the left if the classes differ. Only neighbours are compared: with a
    third place between i and j, at a distance of at most a third of the common words, the words
    would have a smaller period, so pairs further apart repeat a stretch found before.
    """
    found: list[tuple[int, int, int]] = []
    close = periods - 1

    def join(depth: int, held: list[int], more: list[int]) -> list[int]:
        if len(held) < len(more):
            held, more = more, held
        for p in more:
            at = bisect_left(held, p)
            for i, j in ((held[at - 1], p) if at else (p, p), (p, held[at]) if at < len(held) else (p, p)):
                gap = j - i
                if gap and depth >= close * gap and depth + gap >= least and left[i] != left[j]:
                    found.append((i, j, depth))
        if len(more) * 16 > len(held):
            held += more
            held.sort()
        else:
            for p in more:
                insort(held, p)
        return held

    depths: list[int] = []  # open intervals, deeper and deeper
    members: list[list[int]] = []
    child: list[int] = []
    for place, depth in zip([*places, -1], [*shared, 0]):
        while depths and depths[-1] > depth:
            child = join(depths.pop(), members.pop(), child)
        if depth and depths and depths[-1] == depth:
            members[-1] = join(depth, members[-1], child)
        elif depth:
            depths.append(depth)
            members.append(child)
        child = [place]
    return found


def runs_of(
    words: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of every run, by document, start, period.

    ``words`` holds word numbers of all documents, one after another, ``sizes`` the words of each.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none, none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # No run has fewer words in common with itself, one period on.
    shallow = min(max((periods - 1) * gap, least - gap) for gap in range(1, least + 1))
    ranks = SuffixRanks(words, doc, shallow)
    order = ranks.repeated[np.argsort(ranks.rank[ranks.repeated])]
    if not len(order):
        return none, none, none, none
    shared = np.append(0, ranks.common(order[:-1], order[1:]))
    shared[shared < shallow] = 0
    used = (shared > 0) | (np.append(shared[1:], 0) > 0)
    left = np.append(-1, ranks.levels[0][1][:-1])
    spots = order[used]
    pairs = maximal_pairs(spots.tolist(), shared[used].tolist(), dict(zip(spots.tolist(), left[spots].tolist())), least, periods)
    if not pairs:
        return none, none, none, none
    i, j, common = np.array(pairs, dtype=np.int64).T
    owner = doc[np.searchsorted(ranks.place, i)]
    ends = np.cumsum(sizes)
    start = i - ranks.place[(ends - sizes)[owner]]
    period, length = j - i, common + j - i
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    same = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    keep = np.append(True, ~same)
    owner, start, length, period = owner[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Every periodic run of words of every text, and the texts with each run cut to one period.

    Words are runs of other characters than ASCII white space, compared unchanged. A run is a
    stretch with smallest period q that no neighbouring word extends, of at least ``least_words``
    words and ``least_periods`` periods (three or more, so that runs are pairs of neighbours).
    Suffixes of whole texts are sorted, the tree of their LCP intervals is closed from the
    leaves up, and maximal pairs whose distance is small against their common words are the
    runs. Tasks work on what they read: there is no shuffle.

    Returns the key, ``n_words``, ``runs`` (start, length and period in words, by start and
    period) and ``collapsed``: the words that no run holds behind its first period, joined by one
    space. A null or empty text has no words and no runs. Rows that repeat, also with a null key,
    are treated each by itself. An empty table gives no rows. Other columns are not carried, so
    their names do not matter.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not pairs of neighbours")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", RUNS),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def rows(keys: pa.Array, texts: list[list[bytes]], numbers: WordNumbers) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.fromiter((numbers[w] for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
        owner, start, length, period = runs_of(flat, sizes, least_words, least_periods)
        first = (np.cumsum(sizes) - sizes)[owner] if len(owner) else owner
        n = len(flat) + 1
        cover = np.bincount(first + start + period, minlength=n) - np.bincount(first + start + length, minlength=n)
        keep = np.cumsum(cover) == 0
        touched = set(owner.tolist())
        collapsed, at = [], 0
        for d, words in enumerate(texts):
            left = compress(words, keep[at : at + len(words)].tolist()) if d in touched else words
            collapsed.append(b" ".join(left).decode())
            at += len(words)
        structs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(run_type))
        offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(sizes), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, type=pa.string())],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            keys, texts, first, held = batch.column(0), [], 0, 0
            for at, text_ in enumerate(batch.column(1)):
                texts.append(text_.as_py().encode().split())
                held += len(texts[-1])
                if held >= BATCH_WORDS or at == batch.num_rows - 1:
                    yield rows(keys.slice(first, len(texts)), texts, numbers)
                    texts, first, held = [], at + 1, 0
                    if len(numbers) > MEMO_WORDS:
                        numbers.clear()

    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one in ten with an end that repeats itself; all other columns as they were.

    With h the CRC-32 of the decimal key and g = h div 10, texts of h mod 10 = 0 take, from word
    a = g mod n on, their word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). Their
    words are joined by one space. A null key or a text without words changes nothing.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def bent(w: F.Column) -> F.Column:
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.when(n == 0, "").otherwise(
            F.array_join(
                F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "
            )
        )

    # The words of a text stand in an array of one, so that they are found once.
    bent_text = F.element_at(F.transform(F.array(words), bent), 1)
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), bent_text).otherwise(F.col(text)))
