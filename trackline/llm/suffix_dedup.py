"""Exact removal of long byte strings that occur more than once, by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.common import cut
from trackline.session import write_shared

#: Length of the strings in bytes.
LENGTH = 400
#: Length of the anchors that lead equal strings to one place.
ANCHOR = 96
#: Bytes that one array step works on; the place in them takes so many bits of a key.
CHUNK_BITS = 20
#: Distinct surroundings of one anchor that one suffix array takes.
MOST_KINDS = 1000
#: Bytes one suffix array should hold.
SHARD_BYTES = 1 << 20

U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
#: The least numbers of two, three and up to eight bytes.
BYTES = U(1) << np.arange(8, 64, 8, dtype=U)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int, inverse: bool) -> np.ndarray:
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, dtype=U)
        known[0] = 1
        known = _POWERS[base, inverse] = np.multiply.accumulate(known)
    return known[:n]


class Hashes:
    """Hashes of any stretch of a byte array in constant time each."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * powers(base, n, False), out=self.sums[1:])
        self.back = powers(base, n + 1, True)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Of all stretches of one length, in order."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def chunks(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of a run of texts, and row, first byte in the run and place in the text of each part.

    Longer texts come in parts that overlap by LENGTH - 1 bytes, so every string lies in one part.
    """
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(raw):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        size = int(offsets[last] - offsets[row])
        if size <= most:
            yield data[offsets[row] : offsets[last]], np.arange(row, last), offsets[row:last] - offsets[row], np.zeros(last - row, np.int64)
        else:
            for at in range(0, size - LENGTH + 1, most - LENGTH + 1):
                part = data[offsets[row] + at : min(offsets[row] + at + most, offsets[last])]
                yield part, np.array([row]), np.zeros(1, np.int64), np.array([at])
        row = last


def anchor_runs(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: text, start, number of starts, and two hashes.

    The anchor of a string is its stretch of ANCHOR bytes with the least hash, the first of equals,
    so it depends on the string alone: equal strings have equal anchors at equal places. The least
    of a sliding window comes from running minima inside blocks, forward and backward.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    window = LENGTH - ANCHOR + 1
    hashes = Hashes(data, BASES[0])
    grams = hashes.every(ANCHOR)
    keys = grams >> U(CHUNK_BITS) << U(CHUNK_BITS) | np.arange(len(grams), dtype=U)
    blocks = np.full(-(-len(keys) // window) * window, np.iinfo(np.uint64).max, dtype=U)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, window)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - LENGTH + 1
    least = np.minimum(backward[:starts], forward[window - 1 : window - 1 + starts])
    place = (least & U((1 << CHUNK_BITS) - 1)).astype(np.int64)
    ends = np.append(firsts[1:], len(data))
    inside = np.ones(starts + 1, dtype=bool)
    cover = np.zeros(starts + 2, dtype=np.int64)  # starts whose string would leave its text
    low = np.minimum(np.maximum(ends - LENGTH + 1, firsts), starts)
    np.add.at(cover, low, 1)
    np.add.at(cover, np.minimum(ends, starts), -1)
    inside[:starts] = np.cumsum(cover[:starts]) == 0
    inside[starts] = False
    opens = inside[:starts].copy()
    opens[1:] &= ~inside[: starts - 1] | (place[1:] != place[:-1])
    new_text = firsts[(firsts > 0) & (firsts < starts)]
    opens[new_text] = inside[new_text]
    begin = np.flatnonzero(opens)
    # A run lasts until the next one opens or the next start that is not inside.
    outside = np.append(np.flatnonzero(~inside[:starts]), starts)
    stop = np.minimum(np.append(begin[1:], starts), outside[np.searchsorted(outside, begin)])
    count = stop - begin
    text = np.searchsorted(firsts, begin, "right") - 1
    around = hashes.at(begin, count - 1 + LENGTH) ^ Hashes(data, BASES[1]).at(begin, count - 1 + LENGTH) * U(3)
    return text, begin, count, grams[place[begin]].view(np.int64), around.view(np.int64)


def find_runs(texts: DataFrame) -> DataFrame:
    """All runs of ``number``, ``text``: ``anchor``, ``around``, ``count``, ``number``, ``start``."""
    names = ["anchor", "around", "count", "number", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for data, rows, firsts, places in chunks(batch.column(1), 1 << CHUNK_BITS):
                text, begin, count, anchor, around = anchor_runs(data, firsts)
                start = begin - firsts[text] + places[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in (anchor, around, count, number[rows[text]], start)], names=names
                )

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number, zeros after the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), dtype=">u8", buffer=padded, strides=(1,)).astype(U)


def suffix_order(data: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The suffix array of strings laid end to end, by Larsson and Sadakane's refinement.

    ``ends`` and ``piece`` give for every byte the end and the number of its string; a string ends
    with a mark of its own that is less than all bytes. Suffixes are sorted by seven bytes, then
    only groups that are still equal are sorted again by the rank of what follows, twice as far
    each time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    left = ends - np.arange(n)
    # Eight bytes from every place in one read; the last gives way to the number of bytes that count.
    key = eight_bytes(data)
    near = np.flatnonzero(left < 7)
    spare = U(8) * (U(8) - left[near].astype(U))
    short = key[near] >> spare << spare | left[near].astype(U)
    key &= ~U(255)
    key |= U(7)
    key[near] = short
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    # Suffixes of fewer bytes are told apart by their strings' marks at once.
    near = np.flatnonzero(key & U(255) < U(7))
    order[near] = order[near][np.lexsort((order[near], key[near]))]
    new[near] = True
    # Ranks have a place more for the mark of every string, so what follows a suffix that is still
    # tied lies in its string or is its mark. ``head`` is the first slot of a tied suffix's group.
    marks = int(piece[-1]) + 1
    high = (n + marks).bit_length()
    rank = np.zeros(n + marks, dtype=np.uint32 if high <= 32 else U)
    rank[ends + piece] = piece
    shifted = np.arange(n) + piece
    order = shifted[order]
    first = np.flatnonzero(new[:-1])
    head = np.repeat(first, np.diff(first, append=n))
    rank[order] = head + marks
    slots = np.flatnonzero(~(new[:-1] & new[1:]))
    suffix, head = order[slots], head[slots]
    reach = 7
    while len(slots):
        # Head, rank of what follows and place in one number, if they fit.
        m = len(slots)
        wide = m.bit_length()
        key = rank[suffix + reach].astype(U)
        if 2 * high + wide <= 64:
            key <<= U(wide)
            key |= np.arange(m, dtype=U)
            key |= head.view(U) << U(high + wide)
            key.sort()
            turn = (key & U((1 << wide) - 1)).view(np.int64)
            key >>= U(wide)
        else:
            key |= head.view(U) << U(high)
            turn = np.argsort(key)
            key = key[turn]
        suffix = suffix[turn]
        order[slots] = suffix
        new = np.ones(m + 1, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = np.flatnonzero(new[:-1])
        head = np.repeat(slots[first], np.diff(first, append=m))
        rank[suffix] = head + marks
        stays = np.flatnonzero(~(new[:-1] & new[1:]))
        slots, suffix, head = slots[stays], suffix[stays], head[stays]
        reach *= 2
    back = np.zeros(n + marks, dtype=np.int64)
    back[shifted] = np.arange(n)
    return back[order]


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes: of every suffix with the one before it in the order.

    Going through the text, a prefix is one byte shorter than that of the byte before, unless the
    bytes before the two suffixes differ; only there bytes are compared, eight at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    starts = np.concatenate([[True], ends[1:] != ends[:-1]])
    known = (before > 0) & ~starts
    known[1:] &= (data[:-1] == data[before[1:] - 1]) & ~starts[np.maximum(before[1:], 0)]
    fresh = np.flatnonzero(~known & (before >= 0))
    other = before[fresh]
    limit = np.minimum(ends[fresh] - fresh, ends[other] - other)
    words = eight_bytes(data)
    length = np.zeros(len(fresh), dtype=np.int64)
    active = np.arange(len(fresh))
    while len(active):
        far = length[active]
        differ = words[fresh[active] + far] ^ words[other[active] + far]
        same = differ == 0
        stop = np.flatnonzero(~same)
        # Of eight bytes as many are equal as the difference has leading bytes of zero.
        length[active[stop]] += 7 - np.searchsorted(BYTES, differ[stop], "right")
        active = active[same]
        length[active] += 8
        active = active[length[active] < limit[active]]
    prefix = np.zeros(n, dtype=np.int64)
    prefix[fresh] = np.minimum(length, limit)
    filled = np.maximum.accumulate(np.where(known, 0, prefix + at))
    return np.where(known, filled - at, prefix)


def repeated_starts(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the joined pieces start a string of LENGTH that starts elsewhere too; firsts of pieces."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    stops = np.cumsum(sizes)
    ends, piece = np.repeat(stops, sizes), np.repeat(np.arange(len(pieces)), sizes)
    order = suffix_order(data, ends, piece)
    prefix = common_prefixes(data, ends, order)
    joined = prefix[order] >= LENGTH
    twice = np.zeros(len(data), dtype=bool)
    twice[order[joined]] = True
    twice[order[np.append(joined[1:], False)]] = True
    return twice, stops - sizes


FOUND = "anchor long, around long, count long, low long, high long, bucket long, packed binary"
#: Numbers of a packed digest: kind (around, count), start, 1 if it is in question, and two hashes.
PACKED = 6


def shard_repeats(table: pa.Table) -> pa.Table:
    """Suffix array of one shard: per kind the intervals of repeated starts, as [low, high).

    Surroundings that occur more than once stand in the array once; all their starts are repeated.
    If the anchor lies in several shards, its sorted digests follow, packed into as many buckets as
    there are shards: of every start not repeated here, and of one start of each string that is.
    """
    anchor, around, count, copies, parts = (
        table.column(c).to_numpy() for c in ("anchor", "around", "count", "copies", "parts")
    )
    pieces = table.column("bytes").to_pylist()
    twice, firsts = repeated_starts(pieces)
    sizes = np.array([len(p) for p in pieces])
    own = np.arange(len(twice)) - np.repeat(firsts, sizes) < np.repeat(count, sizes)
    twice |= own & np.repeat(copies > 1, sizes)
    # No two pieces touch here, as the last LENGTH - 1 bytes of a piece start no string of its own.
    edge = np.flatnonzero(np.diff((twice & own).view(np.int8), prepend=0, append=0))
    kind = np.searchsorted(firsts, edge[0::2], "right") - 1
    columns = [anchor[kind], around[kind], count[kind], edge[0::2] - firsts[kind], edge[1::2] - firsts[kind]]
    buckets, packed = np.zeros(0, np.int64), []
    if parts[0] > 1:
        buckets, packed = pack_digests(pieces, firsts, twice, around, count, int(parts[0]))
    n = len(packed)
    same = np.full(n, anchor[0]), *(np.zeros(n, np.int64) for _ in range(4))
    columns = [np.concatenate([c, s]) for c, s in zip(columns, same)]
    bucket = pa.array([None] * len(kind) + list(buckets), type=pa.int64())
    blobs = pa.array([None] * len(kind) + packed, type=pa.binary())
    names = ["anchor", "around", "count", "low", "high", "bucket", "packed"]
    return pa.table([*map(pa.array, columns), bucket, blobs], names=names)


def pack_digests(
    pieces: list[bytes], firsts: np.ndarray, twice: np.ndarray, around: np.ndarray, count: np.ndarray, parts: int
) -> tuple[np.ndarray, list[bytes]]:
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    firsts = firsts[: len(pieces)]
    kind = np.repeat(np.arange(len(pieces)), count)
    start = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
    place = firsts[kind] + start
    one = Hashes(data, BASES[0]).at(place, LENGTH)
    two = Hashes(data, BASES[1]).at(place, LENGTH)
    lone = ~twice[place]
    keep = lone.copy()
    again = np.flatnonzero(~lone)
    _, first = np.unique(one[again] ^ mix(two[again]), return_index=True)
    keep[again[first]] = True
    bucket = (mix(one) % U(parts)).astype(np.int64)
    order = np.flatnonzero(keep)
    order = order[np.lexsort((one[order], bucket[order]))]
    rows = np.column_stack(
        [around[kind], count[kind], start, lone.astype(np.int64), one.view(np.int64), two.view(np.int64)]
    )[order]
    found, at = np.unique(bucket[order], return_index=True)
    return found, [np.ascontiguousarray(r, dtype="<i8").tobytes() for r in np.split(rows, at[1:])]


def merge_digests(table: pa.Table) -> pa.Table:
    """Starts whose string is in another shard too, found by binary search among sorted digests."""
    rows = np.concatenate([np.frombuffer(b, dtype="<i8").reshape(-1, PACKED) for b in table.column("packed").to_pylist()])
    both = mix(rows[:, 4].astype(U)) + rows[:, 5].astype(U)
    ordered = np.sort(both)
    places = np.searchsorted(ordered, both, "right") - np.searchsorted(ordered, both, "left")
    rows = rows[(places > 1) & (rows[:, 3] == 1)]
    anchor = np.full(len(rows), table.column("anchor")[0].as_py(), dtype=np.int64)
    columns = (anchor, rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 2] + 1)
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=["anchor", "around", "count", "low", "high"])


def cut_pieces(kinds: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes around each kind, taken from one text that has it; a text is read once."""
    wanted = kinds.groupBy("number").agg(
        F.collect_list(F.struct("anchor", "around", "count", "copies", "start", "shard", "parts")).alias("kinds")
    )
    joined = wanted.join(texts, "number").select("text", "kinds")
    names = ["anchor", "around", "count", "copies", "shard", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows, found = batch.slice(at, 64), []
                for text, kinds in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for k in kinds:
                        found.append((*(k[c] for c in names), raw[k["start"] : k["start"] + k["count"] - 1 + LENGTH]))
                        if len(found) >= 8192:
                            yield batch_of(found)
                            found = []
                if found:
                    yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        arrays = [pa.array(c, type=pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], type=pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "bytes"])

    return joined.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", bytes binary")


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """``number``, ``low``, ``high``: intervals of starts of strings that start elsewhere too.

    ``texts`` has ``number`` (distinct) and ``text``. Every string of LENGTH bytes is led by its
    anchor; anchors that occur once rule their strings out, which leaves the repeated parts of the
    corpus. There, starts with one anchor and equal surroundings are one kind, counted before
    anything is moved. The bytes of one text per kind go to the shard of the anchor, a suffix
    array finds repeats inside the shard, and kinds of an anchor too frequent for one shard are
    spread over several, whose strings meet as sorted digests.
    """
    spark = texts.sparkSession
    runs = write_shared(find_runs(texts), "runs")
    kinds = runs.groupBy("anchor", "around", "count").agg(
        F.count("*").alias("copies"), F.min(F.struct("number", "start")).alias("first")
    )
    kinds = write_shared(kinds.select("anchor", "around", "count", "copies", "first.*"), "kinds")
    again = cut(
        kinds.groupBy("anchor")
        .agg(F.sum("copies").alias("places"), F.count("*").alias("n_kinds"))
        .where("places > 1")
        .select("anchor", F.ceil(F.col("n_kinds") / MOST_KINDS).alias("parts"))
    )
    repeated = kinds.join(again, "anchor")
    repeated = write_shared(repeated, "repeated-kinds")
    size = repeated.agg(F.sum(F.col("count") + LENGTH)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(8 * tasks, int(size // SHARD_BYTES) + 1)
    alone = F.xxhash64("anchor", F.pmod("around", "parts"))
    pooled = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    repeated = repeated.withColumn("shard", F.when(F.col("parts") > 1, alone).otherwise(pooled))
    pieces = cut_pieces(repeated, texts)
    found = write_shared(pieces.groupBy("shard").applyInArrow(shard_repeats, FOUND), "shard-repeats")
    names = ["anchor", "around", "count", "low", "high"]
    near = found.where("packed is null").select(names)
    far = (
        found.where("packed is not null")
        .groupBy("anchor", "bucket")
        .applyInArrow(merge_digests, ", ".join(f"{n} long" for n in names))
    )
    intervals = write_shared(near.union(far), "intervals")
    return runs.join(intervals, ["anchor", "around", "count"]).select(
        "number", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of 400 bytes that also starts anywhere else.

    Texts are read as UTF-8. Strings lie inside one text, may overlap, and are judged on the
    input. Null and short texts have none. Repeated rows are documents of their own, so what they
    share goes from all of them; null keys are kept. An empty table gives no rows. Other columns
    are not read. ``docs`` is read more than once and has to give its rows in the same order, as
    stored tables do. Surroundings and digests are told apart by hashes of 128 bits with the anchor.

    Returns the key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` of the bytes left, and with ``with_text`` those ``kept`` bytes.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    texts = numbered.select("number", "text")
    spans = repeated_intervals(texts).groupBy("number").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = numbered.join(spans, "number", "left").select("key", "text", "spans")
    fields = [T.StructField(key, docs.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] if with_text else []
    names = [f.name for f in fields]

    def judge(raw: bytes, spans: list[dict] | None) -> tuple:
        removed, parts, at, joins = 0, [], 0, 0
        reached = -1
        for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
            end = high - 1 + LENGTH
            joins += low > reached
            if low > at:
                parts.append(raw[at:low])
            removed += max(0, end - max(low, at))
            at = reached = max(at, end)
        parts.append(raw[at:])
        kept = b"".join(parts)
        return len(raw), removed, joins, hashlib.sha256(kept).hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [
                    judge(t.encode("utf-8", "surrogatepass"), s)
                    for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                ]
                columns = list(zip(*got))
                arrays = [part.column(0), *(pa.array(c, type=pa.int64()) for c in columns[:3]), pa.array(columns[3])]
                arrays += [pa.array(columns[4], type=pa.binary())] if with_text else []
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, T.StructType(fields))
