"""Near duplicates among vectors: spherical k-means cells, blocked cosines, one kept per group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.common import components
from trackline.session import shared_path, write_shared

COSINE = 0.95
#: Vectors that the centres are fitted on, at most; all vectors are assigned and compared.
SAMPLE = 20_000
#: Vectors a cell should hold, and the most cells: centres are sent to every task.
CELL, MOST_CELLS = 1000, 4096
ROUNDS = 10
#: Vectors of a cell in a block; two blocks are compared at a time.
BLOCK = 1024
#: Bytes of vectors that are sent to all tasks at a time.
SENT = 1 << 25
#: Cosines in single precision are taken to be this much larger before they rule anything out.
ROUNDING = 1e-5
#: Share of pairs that a sketch may leave to be looked at, and from which all pairs of two blocks are.
PASSED, DENSE = 3e-5, 1 / 64


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True).astype(np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    """A column of vectors as the rows of a matrix; shorter vectors end in zeros."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return values.reshape(-1, size)
    rows = np.zeros((len(lengths), size), values.dtype)
    rows[np.arange(size) < lengths[:, None]] = values
    return rows


def packed(rows: np.ndarray) -> pa.Array:
    """Each row as its bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array | pa.ChunkedArray, size: int, kind: str) -> np.ndarray:
    """The rows that ``packed`` has made bytes of."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros((0, size), kind)
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, size)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre next to each row, and their cosine."""
    single, cell = centres.astype(np.float32), np.empty(len(rows), dtype=np.int64)
    for i in range(0, len(rows), BLOCK):
        cell[i : i + BLOCK] = np.argmax(rows[i : i + BLOCK].astype(np.float32) @ single.T, axis=1)
    return cell, np.einsum("ij,ij->i", rows, centres[cell])


def centres_of(rows: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; a cell without vectors keeps its centre."""
    centres = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        cell, _ = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        norm = np.linalg.norm(sums, axis=1)
        filled = norm > 1e-9
        centres[filled] = sums[filled] / norm[filled, None]
    return np.unique(centres, axis=0)


def sketch(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Parts of unit vectors along a few directions and the length of the rest: products are never below the cosines."""
    along = rows @ basis
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", along, along)))
    return np.concatenate([along, rest[:, None]], axis=1).astype(np.float32)


def basis_of(rows: np.ndarray, cosine: float) -> np.ndarray:
    """Main directions of the rows: the fewest for which sketches leave hardly any pair that is not linked."""
    directions = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    some = rows[:2048]
    linked = np.mean(some @ some.T >= cosine)
    for width in (8, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256):
        if width >= directions.shape[1]:
            break
        short = sketch(some, directions[:, :width])
        if np.mean(short @ short.T >= cosine - ROUNDING) <= linked + PASSED:
            return directions[:, :width]
    return directions


def reach_of(farthest: np.ndarray, homes: np.ndarray, angle: float) -> np.ndarray:
    """Angle to a cell's centre within which a partner of its vectors can lie; -1 for cells without vectors.

    The least cosine of a cell's vectors may be rounded to more than 1.
    """
    return np.where(homes == 0, -1.0, np.minimum(np.arccos(np.clip(farthest, -1, 1)) + angle + 1e-9, np.pi))


def link_block(left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with at least the cosine; within one block each pair once."""
    product = left @ (left if right is None else right).T
    a, b = np.nonzero(product >= cosine)
    if right is None:
        a, b = a[a < b], b[a < b]
    return a, b


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n indices reaches by the links of a block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: What tasks emit.
LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


class Side:
    """Vectors in the order of their cells and from the centres outwards, in blocks of one cell each."""

    def __init__(self, cell, node, copies, own, raw, basis: np.ndarray, angle: float) -> None:
        order = np.lexsort((-own, cell))
        self.home = cell = cell[order]
        self.node, self.copies, self.own, self.raw = node[order], copies[order], own[order], raw[order]
        self.flat = np.empty(raw.shape, dtype=np.float32)
        self.sketch = np.empty((len(raw), basis.shape[1] + 1), dtype=np.float32)
        for i in range(0, len(raw), BLOCK):
            rows = unit(self.raw[i : i + BLOCK])
            self.flat[i : i + BLOCK], self.sketch[i : i + BLOCK] = rows, sketch(rows, basis)
        runs = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        starts = [i + (j - i) * k // -(-(j - i) // BLOCK) for i, j in pairwise(runs) for k in range(-(-(j - i) // BLOCK))]
        self.bounds, self.cell = np.array([*starts, len(cell)]), cell[starts]
        #: Least cosine with the block's centre of a vector that could be linked with one of the block.
        reach = reach_of(np.minimum.reduceat(self.own, starts), np.diff(self.bounds), angle)
        self.reach = (np.cos(reach) - ROUNDING).astype(np.float32)


def linked(left: Side, right: Side, centres: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left, and of right in the same or an earlier cell, with at least the cosine.

    Of two linked vectors at home in different cells, either is no further from the other's centre than
    the other and the angle together, and its angle to the plane halfway between the centres does not
    exceed the angle. Vectors of two blocks for which that holds are compared by their sketches, and what
    these leave is compared in double precision.
    """
    cells, place = np.unique(right.cell, return_inverse=True)
    each, outer = np.repeat(place, np.diff(right.bounds)), right.own.astype(np.float32)
    single, there, homes = centres.astype(np.float32), centres[cells], np.unique(left.cell)
    sine, least, step = np.sqrt(1 - cosine * cosine), np.float32(cosine - ROUNDING), max(1, (1 << 19) // left.raw.shape[1])
    near: dict[int, np.ndarray] = {}
    for i, (low, high) in enumerate(pairwise(left.bounds)):
        home, own = left.cell[i], left.own[low:high].astype(np.float32)
        blocks = int(np.searchsorted(right.cell, home, side="right"))
        if not blocks:
            continue
        end = right.bounds[blocks]
        if home not in near:
            some = homes[homes >= home][:16]
            near = dict(zip(some.tolist(), single[some] @ right.flat.T, strict=True))
        gap = (sine * np.linalg.norm(there - centres[home], axis=1) + ROUNDING).astype(np.float32)
        comes = near[home][:end] >= np.maximum(outer[:end] - gap[each[:end]], left.reach[i])
        goes = single[cells] @ left.flat[low:high].T
        goes = np.where(goes >= own - gap[:, None], goes, np.float32(-2))[place[:blocks]] >= right.reach[:blocks, None]
        if cells[place[blocks - 1]] == home:
            goes[right.cell[:blocks] == home] = comes[right.bounds[np.searchsorted(right.cell, home)] : end] = True
        rows = np.flatnonzero(goes) % goes.shape[1]
        cols = np.flatnonzero(comes)
        row_cuts = np.concatenate([[0], np.cumsum(np.count_nonzero(goes, axis=1))]).tolist()
        col_cuts = np.searchsorted(cols, right.bounds[: blocks + 1]).tolist()
        mine, theirs = left.sketch[low:high], right.sketch[cols]
        found = []
        for j in range(blocks):
            (r, s), (c, d) = row_cuts[j : j + 2], col_cuts[j : j + 2]
            if r == s or c == d:
                continue
            product = mine[rows[r:s]] @ theirs[c:d].T
            if product.max() < least:
                continue
            a, b = np.divmod(np.flatnonzero(product >= least), product.shape[1])
            if len(a) > DENSE * product.size:
                a, b = link_block(unit(left.raw[low + rows[r:s]]), unit(right.raw[cols[c:d]]), cosine)
                yield low + rows[r + a], cols[c + b]
            else:
                found.append((low + rows[r + a], cols[c + b]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                close = np.einsum("ij,ij->i", unit(left.raw[x]), unit(right.raw[y])) >= cosine
                yield x[close], y[close]


class Found:
    """Links of the vectors sent to a task, and which of them are connected, as far as the task knows."""

    def __init__(self, n: int) -> None:
        self.links, self.label = np.zeros(n, dtype=np.int64), np.arange(n)
        self.edges, self.held = [], 0

    def connect(self, u: np.ndarray, v: np.ndarray) -> None:
        new = self.label[u] != self.label[v]
        if new.any():
            self.edges.append(np.unique(u[new] * len(self.label) + v[new]))
            self.held += len(self.edges[-1])
            if self.held > 1 << 18:
                self.settle()

    def settle(self) -> None:
        if self.edges:
            moved = np.flatnonzero(self.label != np.arange(len(self.label)))
            u, v = np.divmod(np.concatenate(self.edges), len(self.label))
            self.label = spanning(np.concatenate([u, moved]), np.concatenate([v, self.label[moved]]), len(self.label))
            self.edges, self.held = [], 0


def portions(homes: np.ndarray, most: int) -> list[tuple[np.ndarray, int, int]]:
    """Cells that are sent together, at most so many vectors: their numbers, and which of how many parts of them."""
    out, held, n = [], [], 0
    for cell, count in enumerate(homes.tolist()):
        if held and n + count > most:
            out.append((np.array(held), 0, 1))
            held, n = [], 0
        if count > most:
            out += [(np.array([cell]), k, -(-count // most)) for k in range(-(-count // most))]
        elif count:
            held.append(cell)
            n += count
    return [*out, (np.array(held), 0, 1)] if held else out


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Links and components of all vectors with cosine of at least ``cosine``, at least 0.

    Equal vectors are one, with a count. Centres of spherical k-means are fitted on a bounded
    sample; every vector is at home in the cell of its nearest centre, and the vectors are stored
    once, in the order of their cells. Then portions of them, of a bounded number of bytes, are sent to all
    tasks one after the other, and met there by the stored vectors of the same and of later cells; so
    vectors are neither copied nor shuffled to be compared. Cells that are too far from all cells of a
    portion are not read. Blocks of a cell are compared by those of their vectors that could have
    a partner in the other block (``linked``), first by sketches whose products are never below the
    cosines. So no link is missed. A task emits one row per vector it links, with the number of
    links and a partner, never pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components are linked with
    nothing. Of different lengths, the shorter counts as ending in zeros. Repeated rows are
    vectors of their own and link with each other. A null key takes part; the component is the
    smallest key there is, null if there is none. An empty table gives no rows.

    Returns the key, ``n_links``, ``component_id`` and ``kept``.
    """
    spark = vectors.sparkSession
    given = vectors.schema[vector].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, stored_as = ("float32", "array<float>") if single else ("float64", "array<double>")
    v = F.col(vector).cast(stored_as)
    fine = (
        F.col(vector).isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    named = vectors.select(F.col(key).alias("key"), F.when(fine, v).alias("vector"))
    named = named.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    usable = named.where("node is not null")
    nodes = write_shared(usable.groupBy("node").agg(F.max(F.size("vector")).alias("size")), "nodes")
    n, size = nodes.agg(F.count("*"), F.max("size")).first()
    size = size or 1
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node")
    sample = usable.join(F.broadcast(chosen), "node").groupBy("node").agg(F.first("vector").alias("vector")).toArrow()
    sample = sample.sort_by("node").column("vector").combine_chunks()
    if len(sample):
        fitted = unit(rows_of(sample, size))
        centres, basis = centres_of(fitted, int(min(MOST_CELLS, len(fitted), max(1, n // CELL)))), basis_of(fitted, cosine)
    else:
        centres, basis = np.zeros((1, size)), np.eye(size)
    angle = float(np.arccos(cosine))
    shared = spark.sparkContext.broadcast((centres, basis))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = shared.value
        for batch in batches:
            raw = rows_of(batch.column(1), size)
            cell, own = nearest(unit(raw), centres)
            arrays = [pa.array(cell, type=pa.int32()), batch.column(0), batch.column(2), pa.array(own), packed(raw)]
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "node", "copies", "own", "data"])

    distinct = usable.groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    stored = write_shared(
        distinct.mapInArrow(settle, "cell int, node long, copies long, own double, data binary")
        .repartitionByRange("cell", "node")
        .sortWithinPartitions("cell", F.desc("own"), "node"),
        "vectors",
    )
    homes, spread = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for row in stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("own").alias("own")).collect():  # one row a cell
        homes[row["cell"]], spread[row["cell"]] = row["n"], np.arccos(np.clip(row["own"], -1, 1))
    found = shared_path(spark, "vector-links")
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("node", "root", "links")])
    spark.createDataFrame([], schema).write.parquet(found)

    def send(cells: np.ndarray, part: int, parts: int) -> None:
        """Have a portion met by the vectors of its cells and of later ones."""
        first, last = int(cells[0]), int(cells[-1])
        portion = stored.where(F.col("cell").between(first, last))
        if parts > 1:
            portion = portion.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)) == part)
        table = portion.toArrow()
        sent = spark.sparkContext.broadcast(
            (*(table.column(c).to_numpy() for c in ("cell", "node", "copies", "own")), unpacked(table.column("data"), size, kind))
        )
        apart = np.arccos(np.clip(centres[first:] @ centres[cells].T, -1, 1))
        close = (apart <= spread[first:, None] + spread[cells] + angle + ROUNDING).any(axis=1) & (homes[first:] > 0)
        read = stored.where(F.col("cell") >= first)
        if close.sum() < np.count_nonzero(homes[first:]):
            read = read.where(F.col("cell").isin((first + np.flatnonzero(close)).tolist()))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (centres, basis), right = shared.value, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if right is None:
                    right = Side(*sent.value, basis, angle)
                    met = Found(len(right.node))
                columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                left = Side(*columns, unpacked(batch.column(4), size, kind), basis, angle)
                links, partner = np.zeros(len(left.node), dtype=np.int64), np.full(len(left.node), -1)
                for a, b in linked(left, right, centres, cosine):
                    once = (left.home[a] > right.home[b]) | (left.node[a] > right.node[b])
                    a, b = a[once], b[once]
                    np.add.at(links, a, right.copies[b])
                    np.add.at(met.links, b, left.copies[a])
                    new = partner[a] < 0
                    partner[a[new]] = b[new]
                    met.connect(partner[a], b)
                some = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (left.node[some], right.node[partner[some]], links[some])], schema=LINKS
                )
            if right is not None:
                met.settle()
                some = met.links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (right.node[some], right.node[met.label[some]], met.links[some])], schema=LINKS
                )

        read.mapInArrow(meet, schema).write.mode("append").parquet(found)
        sent.destroy()

    for cells, part, parts in portions(homes, max(1, SENT // (size * np.dtype(kind).itemsize))):
        send(cells, part, parts)
    links = spark.read.schema(schema).parquet(found)
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(links.select("node", "root"), "node", "root").withColumnRenamed("root", "class")
    placed = write_shared(
        named.select("key", "node")
        .join(stored.select("node", "copies"), "node", "left")
        .join(totals.join(classes, "node", "left"), "node", "left")
        .select(
            "key",
            F.coalesce("class", "node").alias("class"),
            F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        ),
        "placed",
    )
    crowd = F.col("n_links") > 0
    least = placed.where(crowd).groupBy("class").agg(F.min("key").alias("least"))
    out = placed.join(least, "class", "left").withColumn(
        "component_id", F.when(crowd, F.col("least")).otherwise(F.col("key"))
    )
    return out.select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
