"""Near duplicates by weighted Jaccard similarity of word shingles, found with BagMinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import WORD, components, cut
from trackline.llm.vector_dedup import spanning
from trackline.session import write_shared

SHINGLE = 5
SIMILARITY = 0.8
#: Registers of a signature; 25 bands of 5, and one bit of each register for the sketch.
REGISTERS = 128
BANDS, ROWS = 25, 5
#: Of two texts with similarity 0.8, 12.8 of 128 sketch bits differ on average (deviation 3.4).
MAX_BITS = 32
#: Texts of a block, shingles of one product, and rows of small buckets that a task takes together.
BLOCK, COLUMNS, LOT = 512, 4096, 2000
#: Texts worked on at a time, and their bytes.
TEXTS, TEXT_BYTES = 512, 4 << 20

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the word shingles of every text, repeats included.

    A text with fewer words than a shingle has one shingle, all its words; without words, none.
    """
    out: list[np.ndarray] = []
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = IS_SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(joined) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    power = np.full(len(joined), BASE, dtype=U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum((joined.astype(U) + U(1)) * power, dtype=U)])
    back = np.full(len(joined), INVERSE, dtype=U)
    back[0] = 1
    back = np.multiply.accumulate(back)
    word = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
    n = len(word)
    gram = np.zeros(max(0, n - SHINGLE + 1), dtype=U)
    for k in range(SHINGLE):
        gram *= U(0xD6E8FEB86659FD93)
        gram += word[k : n - SHINGLE + 1 + k] if n >= SHINGLE else U(0)
    gram = mix(gram)
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    for first, last in zip(at[:-1], at[1:]):
        count = last - first
        if count >= SHINGLE:
            found = gram[first : last - SHINGLE + 1].copy()
        elif count:
            with np.errstate(over="ignore"):
                short = U(count)
                for k in range(first, last):
                    short = short * U(0xD6E8FEB86659FD93) + word[k]
            found = mix(np.array([short], dtype=U))
        else:
            found = np.zeros(0, dtype=U)
        found.sort()
        out.append(found)
    return out


def signatures(multisets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures of sorted multisets of 64-bit hashes: one 32-bit value per register.

    Every element is a Poisson process over its weight axis, discretised to whole repeats. The
    axis is cut into dyadic ranges (0,1], (1,2], (2,4], ...; each begun range is one process whose
    rate is its width, and a point's place in it is the path of binary splits down to one unit, so
    a range reached only in part keeps the points below the weight. A point falls into a random
    register, which keeps its earliest point; two multisets agree in a register with a probability
    of exactly their weighted Jaccard similarity. Points are drawn in order of time, and a process
    ends once it is later than all registers of its text.
    """
    sizes = np.array([len(m) for m in multisets])
    texts = len(multisets)
    best = np.full(texts * registers, np.iinfo(np.uint64).max, dtype=U)
    if not sizes.sum():
        return best.astype(np.uint32).reshape(texts, registers)
    values = np.concatenate(multisets)
    owner = np.repeat(np.arange(texts), sizes)
    first = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
    places = np.flatnonzero(first)
    weight = np.diff(np.append(places, len(values)))
    element, text = values[places], owner[places]
    seeds, texts_of, rates, lows, weights = [element], [text], [np.ones(len(places))], [np.zeros(len(places), np.int64)], [weight]
    low, width, level = 1, 1, 1
    while (reach := weight > low).any():
        with np.errstate(over="ignore"):
            seeds.append(mix(element[reach] + U(level) * U(0xA0761D6478BD642F)))
        texts_of.append(text[reach])
        rates.append(np.full(reach.sum(), float(width)))
        lows.append(np.full(reach.sum(), low))
        weights.append(weight[reach])
        low, level = low + width, level + 1
        width = low
    seed, text = np.concatenate(seeds), np.concatenate(texts_of)
    rate, low, weight = np.concatenate(rates), np.concatenate(lows), np.concatenate(weights)
    time = np.zeros(len(seed))
    partial = low + rate.astype(np.int64) > weight
    point = 0
    while len(seed):
        point += 1
        draw = mix(seed + U(point * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        other = mix(draw ^ U(0xE7037ED1A0B428DB))
        register = ((other >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        packed = time.astype(np.float32).view(np.uint32).astype(U) << U(32) | (other & U(0xFFFFFFFF))
        slot = text * registers + register
        if partial.any():
            leaf = (mix(other) >> U(32)).astype(np.float64) * 2.0**-32 * rate
            good = ~partial | (low + np.floor(leaf).astype(np.int64) < weight)
            np.minimum.at(best, slot[good], packed[good])
        else:
            np.minimum.at(best, slot, packed)
        last = (best.reshape(texts, registers).max(axis=1) >> U(32)).astype(np.uint32)
        late = np.where(last == np.uint32(0xFFFFFFFF), np.inf, last.view(np.float32).astype(np.float64))
        on = time <= late[text] * (1 + 1e-6)
        if not on.all():
            seed, text, rate, low, weight, time, partial = (a[on] for a in (seed, text, rate, low, weight, time, partial))
    return best.astype(np.uint32).reshape(texts, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    value, count = np.unique(small, return_counts=True)
    other = np.searchsorted(large, value, "right") - np.searchsorted(large, value, "left")
    shared = int(np.minimum(count, other).sum())
    return shared / (len(a) + len(b) - shared)


def groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts with bounded number and bytes."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if i + 1 - start >= TEXTS or size >= TEXT_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def sketch_texts(texts: DataFrame) -> DataFrame:
    """``text_key``, two 64-bit numbers of sketch bits and the band hashes of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = U(1) << np.arange(64, dtype=U)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in groups(texts):
                found = signatures(shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts[part]]))
                odd = (found & 1).astype(U)
                low, high = (odd[:, :64] * bits).sum(axis=1, dtype=U), (odd[:, 64:] * bits).sum(axis=1, dtype=U)
                rows = found[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS).astype(U)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), rows.shape[:2]).copy()
                for k in range(ROWS):
                    band = mix(band * U(0xD6E8FEB86659FD93) + rows[:, :, k])
                flat = pa.array(band.view(np.int64).ravel())
                offsets = pa.array(np.arange(0, BANDS * len(found) + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    names=["text_key", "low", "high", "bands"],
                )

    return texts.mapInArrow(run, "text_key long, low long, high long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, checked on all shingles."""
    left = texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep: list[bool] = []
            for part in groups(lefts):
                ours = [t.encode("utf-8", "surrogatepass") for t in lefts[part] + rights[part]]
                sets = shingle_hashes(ours)
                half = len(sets) // 2
                keep += [similarity(x, y) >= SIMILARITY for x, y in zip(sets[:half], sets[half:])]
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of texts in different classes, with the classes as ``class_a`` and ``class_b``."""
    of_a = classes.toDF("a", "class_a")
    of_b = classes.toDF("b", "class_b")
    return (
        pairs.join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .withColumns({"class_a": F.coalesce("class_a", "a"), "class_b": F.coalesce("class_b", "b")})
        .where("class_a <> class_b")
    )


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links between texts; only the classes that the links touch are worked on."""
    touched = write_shared(apart(links, classes).select("class_a", "class_b"), "touched")
    if not touched.limit(1).count():
        return classes
    merged = components(touched, "class_a", "class_b").toDF("class_key", "merged")
    known = classes.join(merged, "class_key", "left").select("text_key", F.coalesce("merged", "class_key").alias("class_key"))
    fresh = merged.join(classes, merged["class_key"] == classes["text_key"], "left_anti").select(
        F.col("class_key").alias("text_key"), F.col("merged").alias("class_key")
    )
    return write_shared(known.union(fresh), "classes")


def text_classes(docs: DataFrame) -> DataFrame:
    """``text_key`` and ``class_key`` of all texts that are linked to a different text.

    ``docs`` has ``text_key`` and ``text``. Buckets (equal bands) are compared with one text each
    instead of pair by pair: first every text with the smallest text it shares a bucket with; then,
    in buckets that still hold several classes, twice with two texts of others; and last with all
    texts of other classes there, block by block. Links inside a class need
    no check, as they cannot change it. Texts of a pair are read, never texts of a bucket at once.
    """
    sketches = write_shared(sketch_texts(docs.select("text_key", "text")), "sketches")
    buckets = write_shared(
        sketches.select(F.explode("bands").alias("bucket"), "text_key").distinct(), "buckets"
    )
    bits = sketches.groupBy("text_key").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    shared = cut(
        buckets.groupBy("bucket")
        .agg(F.min("text_key").alias("rep"), F.max("text_key").alias("other"))
        .where(F.col("rep") < F.col("other"))
        .select("bucket", "rep")
    )
    members = write_shared(buckets.join(shared, "bucket"), "bucket-members")
    involved = members.select("text_key").distinct()
    texts = write_shared(
        docs.select("text_key", "text").join(involved, "text_key").groupBy("text_key").agg(F.max("text").alias("text")),
        "bucket-texts",
    )
    # Each text with the smallest text of any of its buckets.
    first = members.where("text_key <> rep").groupBy(F.col("text_key").alias("b")).agg(F.min("rep").alias("a"))
    links = write_shared(verified(likely(first, bits), texts), "first-links")
    # A label that is right where it is equal, which spares checks; two steps up.
    up = links.select(F.col("b").alias("text_key"), F.col("a").alias("step"))
    top = links.select(F.col("b").alias("step"), F.col("a").alias("top"))
    known = up.join(top, "step", "left").select("text_key", F.coalesce("top", "step").alias("class_key"))

    # Buckets that hold several labels: each text with two texts of other labels there.
    rest, more = meet_hubs(members.select("bucket", "text_key"), known, links, bits, texts, 2)
    links = write_shared(links.union(more), "links")
    classes = components(links, "a", "b").toDF("text_key", "class_key")
    rest, more = meet_hubs(rest, classes, links, bits, texts, 3)
    classes = joined(classes, more)

    # What is left: texts of different classes in one bucket.
    crossing = cross_links(rest, classes, texts)
    return joined(classes, crossing)


def cross_links(rest: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between all texts of different classes in one bucket, as a spanning forest.

    Texts of a bucket are dealt into blocks, and a task compares two blocks by a product of their
    shingle matrices, so the rows it takes and gives are bounded, and no pairs are emitted.
    """
    placed = rest.join(classes, "text_key", "left").withColumn("class_key", F.coalesce("class_key", "text_key"))
    several = (
        placed.groupBy("bucket")
        .agg(F.min("class_key").alias("least"), F.max("class_key").alias("most"), F.count("*").alias("n"))
        .where("least < most")
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    placed = write_shared(placed.join(several, "bucket"), "crossing-buckets")
    lots = placed.count() // LOT + 1
    block = F.pmod(F.xxhash64("text_key", F.lit(4)), "blocks").cast("int")
    columns = ["bucket", "text_key", "class_key"]
    placed = placed.withColumn("block", block)
    later, earlier = F.sequence(F.col("block"), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("block") - 1)
    dealt = placed.select(*columns, "blocks", F.col("block").alias("i"), F.explode(later).alias("j"), F.lit(0).alias("side")).union(
        placed.where("block > 0").select(
            *columns, "blocks", F.explode(earlier).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")
        )
    )
    lot = F.when(F.col("blocks") > 1, F.xxhash64("bucket", "i", "j")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(lots)))
    tasks = dealt.withColumn("lot", lot).join(texts, "text_key")

    def compare(table: pa.Table) -> pa.Table:
        keys, kinds = table.column("text_key").to_numpy(), table.column("class_key").to_numpy()
        place = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "i", "j"))))
        side = table.column("side").to_numpy()
        raw = table.column("text").to_pylist()
        first = {k: n for n, k in enumerate(keys.tolist())}
        sets = dict(zip(first, shingle_hashes([raw[n].encode("utf-8", "surrogatepass") for n in first.values()])))
        members: dict[tuple, list[int]] = {}
        for n, p in enumerate(place):
            members.setdefault(p, []).append(n)
        a, b = [], []
        for (_, i, j), rows in members.items():
            at = np.array(rows)
            shared, size = shared_shingles([sets[k] for k in keys[at].tolist()])
            close = shared >= SIMILARITY * (size[:, None] + size[None, :] - shared)
            close &= kinds[at][:, None] != kinds[at][None, :]
            if i != j:
                close &= side[at][:, None] != side[at][None, :]
            x, y = np.nonzero(np.triu(close))
            if len(x):
                root = spanning(x, y, len(at))
                a += keys[at[root != np.arange(len(at))]].tolist()
                b += keys[at[root[root != np.arange(len(at))]]].tolist()
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return tasks.groupBy("lot").applyInArrow(compare, "a long, b long")


def shared_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all pairwise multiset overlaps, and of the sorted multisets.

    The n-th repeat of a shingle is a column of its own, so overlaps are products of 0 and 1.
    """
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    place = np.arange(len(values))
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])[: len(values)]
    repeat = place - np.maximum.accumulate(np.where(new, place, 0))
    _, column, count = np.unique(mix(values) + repeat.astype(U), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    often = count[column] > 1
    column, owner = dense[column[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(dense[-1]) + 1 if len(dense) else 0, COLUMNS):
        first, last = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[first:last], column[first:last] - low] = 1
        shared += part @ part.T
    return shared.astype(np.int64), sizes


def meet_hubs(
    rest: DataFrame, classes: DataFrame, links: DataFrame, bits: DataFrame, texts: DataFrame, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The buckets of ``rest`` with texts of several classes, and links that two checks a text find.

    Every bucket offers the text with most links in it and one by chance. Of what its buckets
    offer from other classes, a text is checked against the one with most links and one by chance.
    """
    degree = links.groupBy(F.col("a").alias("text_key")).count()
    placed = rest.join(classes, "text_key", "left").join(degree, "text_key", "left")
    placed = write_shared(
        placed.select(
            "bucket",
            "text_key",
            F.coalesce("class_key", "text_key").alias("class_key"),
            F.coalesce("count", F.lit(0)).alias("count"),
        ),
        "placed",
    )
    chance = F.xxhash64("text_key", F.lit(seed))
    mixed = cut(
        placed.groupBy("bucket")
        .agg(
            F.min("class_key").alias("least"),
            F.max("class_key").alias("most"),
            F.max(F.struct(F.col("count").alias("by"), "text_key", "class_key")).alias("hub"),
            F.max(F.struct(chance.alias("by"), "text_key", "class_key")).alias("any"),
        )
        .where("least < most")
        .select("bucket", "hub", "any")
    )
    rest = write_shared(placed.select("bucket", "text_key", "class_key").join(mixed, "bucket"), "mixed-buckets")
    chosen = rest.groupBy("text_key").agg(
        *(F.max(F.when(F.col("class_key") != F.col(f"{c}.class_key"), F.col(c))).alias(c) for c in ("hub", "any"))
    )
    pairs = chosen.select(F.col("hub.text_key").alias("a"), F.col("text_key").alias("b")).union(
        chosen.select("any.text_key", "text_key")
    )
    found = verified(likely(pairs.where("a is not null").distinct(), bits), texts)
    return rest.select("bucket", "text_key"), found


def differing(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def likely(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in so few bits that a link is possible."""
    joined = pairs.join(bits.toDF("a", "low_a", "high_a"), "a").join(bits.toDF("b", "low_b", "high_b"), "b")
    return joined.where(differing("low_a", "low_b") + differing("high_a", "high_b") <= MAX_BITS).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The class of every document: ``class_id``, the smallest key among its near duplicates.

    Two texts are linked if the multisets of their five-word shingles have a weighted Jaccard
    similarity of 0.8 or more; classes are what links connect. Words are runs of other characters
    than ASCII white space, compared as they stand; fewer than five words are one shingle. Equal
    texts are one text. Documents without words (null, empty, blank) are linked with nothing and
    have their own key. The class of null keys alone is null. Repeated rows each give a row, with
    the same class. An empty table gives no rows; other columns are not read.

    A pair at exactly 0.8 shares no band with a probability of 5e-5, at 0.9 of 1e-9; sketches pass
    it over with one of about 1e-7. Texts are told apart by 64-bit hashes.

    Returns the key, ``class_id`` and ``kept`` (its class has its key).
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    worded = keyed.where(F.col("text").rlike(WORD))
    classes = text_classes(worded.select("text_key", "text"))
    narrow = keyed.select("key", F.when(F.col("text").rlike(WORD), F.col("text_key")).alias("text_key"))
    placed = cut(narrow.join(classes, "text_key", "left").select("key", F.coalesce("class_key", "text_key").alias("class_key")))
    ids = cut(placed.where("class_key is not null").groupBy("class_key").agg(F.min("key").alias("class_id")))
    out = placed.join(ids, "class_key", "left").withColumn(
        "class_id", F.when(F.col("class_key").isNull(), F.col("key")).otherwise(F.col("class_id"))
    )
    return out.select(
        F.col("key").alias(key), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the smallest key, with all its columns.

    Of repeated rows with that key one stays. ``docs`` is read twice and has to give its rows in
    the same order, as stored tables do.
    """
    numbered = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("number"),
    )
    keyed = numbered.withColumn("text_key", F.when(F.col("text").rlike(WORD), F.xxhash64("text")))
    classes = text_classes(keyed.where("text_key is not null").select("text_key", "text"))
    placed = keyed.select("key", "number", "text_key").join(classes, "text_key", "left")
    least = (
        placed.where("text_key is not null")
        .groupBy(F.coalesce("class_key", "text_key").alias("class_key"))
        .agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "number")).alias("first"))
        .select(F.col("first.number").alias("number"))
    )
    kept = cut(least.union(placed.where("text_key is null").select("number")))
    return keyed.join(kept, "number", "left_semi").select("row.*")
