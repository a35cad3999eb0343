"""Most similar vectors for every vector by shifted space-filling curves (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery, internal, valid_vector

#: Curves, dimensions and bits of a curve's grid (dimensions x bits fit a signed 64-bit key).
CURVES, DIMS, BITS = 4, 6, 10
#: Rows that a row is compared with on either side along a curve, at least.
HALF_WINDOW = 2048
#: Curves of a search for few queries, and of one for neighbours that are hardly similar.
QUERY_CURVES, FAR_CURVES = 8, 12
#: Parts of a group of exact copies.
SALTS = 64
#: Half windows in a block of a curve; a block is searched by one task and also gets the half windows before and after it.
BLOCK_HALVES = 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each grid cell (rows of `cells`, each coordinate below 2**bits) on the Hilbert curve.

    Works on whole columns: first the Gray-code rotations of each bit plane are undone from the top,
    then the planes are interleaved.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q = np.int64(1 << plane)
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] & (1 << plane), np.int64((1 << plane) - 1), 0)
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ fix) >> plane) & 1)
    return key


def curve_frame(curve: int, width: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (orthonormal columns) and the shift of one curve; a function of the seed alone."""
    rng = np.random.default_rng([seed, curve, width])
    basis, _ = np.linalg.qr(rng.standard_normal((width, min(dims, width))))
    return basis, rng.random(basis.shape[1])


def curve_keys(unit: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on a shifted curve.

    Projections of unit vectors have a spread of about width**-0.5; the grid spans eight times that and
    what lies outside is folded to its edge.
    """
    basis, shift = curve_frame(curve, unit.shape[1], dims, seed)
    at = unit @ basis * (math.sqrt(unit.shape[1]) / 8.0) + 0.25 + shift / 2
    return hilbert_keys(np.clip(at * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a float32 matrix, without copying value by value."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(flat), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    wide = m.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def with_keys(vectors: DataFrame, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """One row for each vector and curve: id, curve, key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(matrix(batch.column("vec")))
                for c in range(curves):
                    key = pa.array(curve_keys(unit, c, dims, bits, seed))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(unit), c, np.int32)), key], names=["id", "curve", "key"])

    return vectors.select("id", "vec").mapInArrow(keyed, "id bigint, curve int, key bigint")


def block_marks(vectors: DataFrame, curves: int, dims: int, bits: int, seed: int, half: int) -> dict:
    """Where the blocks of each curve meet: by curve and place (-1 half a window before the border, 0 at it, 1 half a
    window after it) the (key, id) found there, as two arrays in order.

    Rows are numbered along the curve by their place in their range partition and the sizes of the partitions
    before it. Three rows for each block come to the driver.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, pos = batch.column("curve").to_numpy(), np.empty(batch.num_rows, np.int64)
            for c in np.unique(curve).tolist():
                at = np.flatnonzero(curve == c)
                pos[at] = seen.get(c, 0) + np.arange(len(at))
                seen[c] = seen.get(c, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(pos), part, np.int32)), pa.array(pos)], names=[*batch.schema.names, "part", "pos"])

    ordered = with_keys(vectors, curves, dims, bits, seed).select("curve", "key", "id").repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    spots = checkpoint(ordered.mapInArrow(numbered, "curve int, key bigint, id bigint, part int, pos bigint"))
    total, before = {}, []
    for r in spots.groupBy("curve", "part").agg(F.count("*").alias("n")).orderBy("curve", "part").collect():
        before.append((r["curve"], r["part"], total.get(r["curve"], 0)))
        total[r["curve"]] = total.get(r["curve"], 0) + r["n"]
    size = BLOCK_HALVES * half
    first = vectors.sparkSession.createDataFrame(before, "curve int, part int, first bigint")
    placed = spots.join(F.broadcast(first), ["curve", "part"]).withColumn("place", F.col("pos") + F.col("first"))
    side = F.when(F.col("place") % size == 0, 0).when(F.col("place") % size == half, 1).when(F.col("place") % size == size - half, -1)
    found = placed.where(F.col("place") >= size - half).select("curve", "key", "id", side.alias("side")).where("side is not null").orderBy("curve", "side", "key", "id").toPandas()
    return {k: (g["key"].to_numpy(), g["id"].to_numpy()) for k, g in found.groupby(["curve", "side"])}


def passed(marks: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the (key, id) marks each row is at or beyond."""
    if marks is None:
        return np.zeros(len(key), np.int64)
    n = len(marks[0])
    order = np.lexsort((np.arange(n + len(key)) >= n, np.concatenate([marks[1], ids]), np.concatenate([marks[0], key])))
    count = np.empty(n + len(key), np.int64)
    count[order] = np.cumsum(order < n)
    return count[n:]


def curve_blocks(vectors: DataFrame, curves: int, dims: int, bits: int, seed: int, half: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of (id, vec, bigint columns `keep`) along each curve in blocks: id, vec, keep, block, core; in a partition
    sorted by block and place.

    A block has `BLOCK_HALVES` half windows of rows of its own (`core`) and the half windows before and after it, so
    every row has its neighbours along the curve beside it, however many partitions there are.
    """
    marks = vectors.sparkSession.sparkContext.broadcast(block_marks(vectors, curves, dims, bits, seed, half))
    names = ["id", "vec", *keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = marks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, ids = unit_rows(matrix(batch.column("vec"))), batch.column("id").to_numpy()
            for c in range(curves):
                key = curve_keys(unit, c, dims, bits, seed)
                block = passed(at.get((c, 0)), key, ids)
                last = len(at[c, 0][0]) if (c, 0) in at else 0
                for step, here in ((0, block >= 0), (-1, passed(at.get((c, 1)), key, ids) < block), (1, (passed(at.get((c, -1)), key, ids) > block) & (block < last))):
                    rows = np.flatnonzero(here)
                    if len(rows):
                        own = batch.select(names).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array((c << 40) + block[rows] + step), pa.array(np.full(len(rows), step == 0)), pa.array(key[rows])], names=[*names, "block", "core", "key"])

    ddl = "id bigint, vec array<float>, " + "".join(f"{c} bigint, " for c in keep) + "block bigint, core boolean, key bigint"
    return vectors.select(*names).mapInArrow(cut, ddl).repartition("block").sortWithinPartitions("block", "key", "id").drop("key")


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The stretches of a sorted batch that lie in one block."""
    block = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield int(block[lo]), batch.slice(lo, hi - lo)


def best_of(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row, by k passes (k is small); spoils `sims`."""
    rows = np.arange(len(sims))
    cols, vals = np.empty((len(sims), k), np.int64), np.empty((len(sims), k), np.float32)
    for i in range(k):
        c = sims.argmax(axis=1)
        cols[:, i], vals[:, i] = c, sims[rows, c]
        sims[rows, c] = -3.0
    return cols, vals


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that `curve_blocks` gives, each as one batch; a block is of bounded size."""
    now, parts = None, []
    for batch in batches:
        for block, piece in by_block(batch):
            if block != now and parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts = []
            now = block
            parts.append(piece)
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def window_neighbours(k: int, half: int, least: float, every: int = 1):
    """A mapInArrow function: k best partners of each row among its neighbours in the order of the rows.

    Rows come as `curve_blocks` gives them. Half a half window of core rows at a time is compared with these and the
    `half` rows before and after them, so every row meets its window once. Only core rows whose id is divisible by
    `every` look for partners, and only pairs of `least` and more are kept.
    """
    chunk = max(1, half // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_blocks(batches):
            ids, unit = block.column("id").to_numpy(), unit_rows(matrix(block.column("vec")))
            asks = np.flatnonzero(block.column("core").to_numpy(zero_copy_only=False) & (ids % every == 0))
            a, b, s = [], [], []
            for lo in range(0, len(ids), chunk):
                at = asks[np.searchsorted(asks, lo) : np.searchsorted(asks, lo + chunk)]
                if not len(at):
                    continue
                first = max(0, lo - half)
                sims = unit[at] @ unit[first : lo + chunk + half].T
                sims[np.arange(len(at)), at - first] = -3.0
                if least > 0:  # few rows have a partner at all
                    busy = np.flatnonzero(sims.max(axis=1) >= least)
                    at, sims = at[busy], sims[busy]
                if len(at):
                    cols, vals = best_of(sims, min(k, sims.shape[1]))
                    row, col = np.nonzero(vals >= max(least, -2.0))
                    a.append(ids[at[row]])
                    b.append(ids[first + cols[row, col]])
                    s.append(vals[row, col])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["a", "b", "sim"])

    return run


def best_partners(pairs: DataFrame, k: int) -> DataFrame:
    """The k best distinct partners `b` of each `a`; of equal similarity the smaller id."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def curve_neighbours(vectors: DataFrame, k: int, least: float = -2.0, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, half: int = HALF_WINDOW, every: int = 1, seed: int = 42) -> DataFrame:
    """Approximate k nearest neighbours of each row of (id bigint, vec array<float>), both orders merged.

    The rows are cut into blocks by (curve, key, id) - ids split even one hot key - and every row is
    compared with the `half` rows before and after it on each curve. Columns a, b, sim, rank. With `every`
    only rows whose id it divides are queries (a); all rows can be partners. `vectors` is read twice.
    """
    pairs = curve_blocks(vectors, curves, dims, bits, seed, half).mapInArrow(window_neighbours(k, half, least, every), "a bigint, b bigint, sim float")
    return best_partners(pairs, k)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id bigint, vec array<float>) of the rows with an id and a valid vector; null, all-zero, NaN and infinite vectors
    drop out. First deliveries count."""
    cols = [id_col, vec_col] + (["loaded_at"] if "loaded_at" in df.columns else [])
    rows = internal(first_delivery(df.select(*cols), id_col), id=F.col(f"`{id_col}`").cast("bigint"), vec=F.col(f"`{vec_col}`").cast("array<float>"))
    return rows.where(F.col("id").isNotNull() & valid_vector(F.col("vec")))


def by_length(vectors: DataFrame) -> list[DataFrame]:
    """The rows of (vec, ...) split by the length of the vector: similarity is defined among equal lengths only."""
    lengths = sorted(r["n"] for r in vectors.select(F.size("vec").alias("n")).distinct().collect())
    return [vectors] if len(lengths) <= 1 else [vectors.where(F.size("vec") == n) for n in lengths]


def collapse_copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies: the k + 1 smallest ids of each vector stand for all; the rest follow from them.

    Gives (representatives, rest): `rest` has id and the k smallest ids of its vector. A group of copies
    is ranked and joined by salted parts, so a third of all rows being one vector is no hot task.
    """
    keyed = vectors.withColumn("copy", F.xxhash64("vec")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    w = Window.partitionBy("copy", "salt").orderBy("id")
    parts = keyed.select("id", "copy", "salt").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    heads = parts.withColumn("r", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("r") <= k + 1)
    groups = heads.groupBy("copy").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    marked = keyed.join(spread, ["copy", "salt"], "left")
    inside = F.col("ids").isNull() | F.array_contains("ids", F.col("id"))
    return marked.where(inside).select("id", "vec"), marked.where(~inside).select("id", F.slice("ids", 1, k).alias("ids"))


def nearest_vectors(df: DataFrame, id_col: str, vec_col: str, k: int, least: float = -2.0, **search) -> DataFrame:
    """The k most similar other vectors (cosine) of every vector: a, b, sim, rank.

    `least` leaves out partners below that cosine before they are shuffled. Exact copies are searched
    through k + 1 representatives and joined back, so equal vectors get the smallest other ids of their
    group. Null, zero and NaN vectors take no part; vectors of different lengths have no similarity; repeated deliveries
    count once; an empty table gives no rows; other columns are dropped. `search` sets the curves.
    """
    heads, rest = collapse_copies(clean_vectors(df, id_col, vec_col), k)
    near = reduce(DataFrame.unionByName, [curve_neighbours(part, k, least, **search) for part in by_length(checkpoint(heads))])
    follow = rest.where(F.col("id") % search.get("every", 1) == 0).select(F.col("id").alias("a"), F.posexplode("ids").alias("p", "b")).select("a", "b", F.lit(1.0).cast("float").alias("sim"), (F.col("p") + 1).alias("rank"))
    return near.unionByName(follow)
