"""A varied subset of given size by determinantal greedy selection (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.llm.neighbours import BITS, DIMS, clean_vectors, matrix, unit_rows, with_keys

#: Rows of a partition that yields one core-set, and rows that one task of the final pass holds, about.
PART_ROWS, FINAL_ROWS = 4096, 8192
#: A partition gives this many times its share of the size asked for, and at least so many rows (all if fewer are asked for).
OVERSAMPLE, LEAST_QUOTA = 4, 256
#: Width of the similarity kernel exp(-(1 - cosine) / WIDTH).
WIDTH = 0.25
#: Below this the determinant is exhausted: the rest are copies of what was chosen.
EXHAUSTED = 1e-9


def greedy_determinant(unit: np.ndarray, size: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Greedy maximisation of the kernel determinant; rows chosen, in order, and the factor each one adds.

    Incremental Cholesky: `left` is what of each row the chosen ones don't explain, the factor by which
    the determinant would grow. Choosing a row adds one column to the factorisation and updates all rows.
    Ties go to the earlier row. Once nothing is left, the earliest rows fill the size up with factor 0.
    """
    n = len(unit)
    size = min(size, n)
    left, chol = np.ones(n), np.zeros((n, size))
    order, gain = np.empty(size, np.int64), np.zeros(size)
    taken = np.zeros(n, bool)
    for t in range(size):
        j = int(np.argmax(np.where(taken, -1.0, left)))
        if left[j] <= EXHAUSTED:
            order[t:] = np.flatnonzero(~taken)[: size - t]
            break
        order[t], gain[t] = j, left[j]
        taken[j] = True
        column = np.exp((unit @ unit[j] - 1.0) / width) - chol[:, :t] @ chol[j, :t]
        chol[:, t] = column / np.sqrt(left[j])
        left = np.maximum(left - chol[:, t] ** 2, 0.0)
    return order, gain


def of_usual_length(vectors: DataFrame) -> DataFrame:
    """The rows whose vector has the most frequent length (of equally frequent ones the smallest)."""
    usual = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return vectors if usual is None else vectors.where(F.size("vec") == usual["n"])


def diverse_subset(df: DataFrame, id_col: str, vec_col: str, size: int, width: float = WIDTH, part_rows: int = PART_ROWS, final_rows: int = FINAL_ROWS, seed: int = 42) -> DataFrame:
    """`size` rows whose vectors span the variety of all: id, pick (1 = first), gain.

    At every size of the table partitions by hash each yield a core-set of a quota of rows, and again from the
    core-sets as long as that shrinks them to `final_rows`. The quota is `size` or, for large sizes, `OVERSAMPLE` times
    the share of a partition, so no task holds more than about part_rows x quota numbers. Frequent groups, spread evenly over
    the partitions, are thinned in each. The final pass maximises the determinant over what is left: in stretches of a
    space-filling curve of about `final_rows` rows (one as long as they suffice), taking rows of different stretches
    as unlike; the rows of highest gain of all stretches are chosen. Null, zero and NaN vectors take no part;
    neither do those of another length than the most frequent one; repeated deliveries count once; if fewer than `size` vectors
    exist all are returned; copies come last; an empty table gives no rows; other columns are dropped.
    """
    spread = "id bigint, vec array<float>, pick int, gain double"

    def choose(ids: np.ndarray, m: np.ndarray, most: int) -> pa.RecordBatch:
        at = np.argsort(ids, kind="stable")
        order, gain = greedy_determinant(unit_rows(m[at]).astype(np.float64), most, width)
        kept = at[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(list(m[kept]), pa.list_(pa.float32())), pa.array(np.arange(1, len(kept) + 1, dtype=np.int32)), pa.array(gain)], names=["id", "vec", "pick", "gain"])

    def thin(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, ids, vecs = None, [], []
            for batch in batches:
                for p, i, v in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("vec").to_numpy(zero_copy_only=False), strict=True):
                    if p != part and ids:
                        yield choose(np.array(ids), np.stack(vecs), most)
                        ids, vecs = [], []
                    part = p
                    ids.append(i)
                    vecs.append(v)
            if ids:
                yield choose(np.array(ids), np.stack(vecs), most)

        return run

    rows, before = of_usual_length(checkpoint(clean_vectors(df, id_col, vec_col))), None
    n, turn = rows.count(), 0
    while before is None or n > final_rows and n < 0.9 * before:
        parts = max(1, -(-n // part_rows))
        quota = min(size, max(LEAST_QUOTA, -(-OVERSAMPLE * size // parts)))
        cut = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(parts)).cast("int"))
        rows = checkpoint(cut.repartition("part").sortWithinPartitions("part").mapInArrow(thin(quota), spread).select("id", "vec"))
        before, n, turn = n, rows.count(), turn + 1
    stretches = max(1, -(-n // final_rows))
    if stretches > 1:
        keyed = rows.join(with_keys(rows, 1, DIMS, BITS, seed).select("id", "key"), "id")
        final = keyed.repartitionByRange(stretches, "key", "id").withColumn("part", F.spark_partition_id())
    else:
        final = rows.coalesce(1).withColumn("part", F.lit(0))
    best = final.select("id", "vec", "part").mapInArrow(thin(size), spread).select("id", "pick", "gain").orderBy(F.desc("gain"), "pick", "id").limit(size)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("gain"), "pick", "id")).alias("pick"), F.round("gain", 9).alias("gain"))


def nearest_pick(df: DataFrame, id_col: str, vec_col: str, subset: DataFrame) -> DataFrame:
    """The subset row most similar to each row: id, pick_id, sim. The subset's size is a parameter and so
    bounds what is broadcast. An empty subset gives no rows."""
    vectors = of_usual_length(clean_vectors(df, id_col, vec_col))
    chosen = vectors.join(F.broadcast(subset.select("id")), "id", "left_semi").toPandas().sort_values("id")
    ids = chosen.id.to_numpy()
    picked = unit_rows(np.stack(chosen.vec.to_list())) if len(ids) else None
    shared = df.sparkSession.sparkContext.broadcast((ids, picked))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks, unit = shared.value
        for batch in batches:
            if batch.num_rows and len(picks):
                sims = unit_rows(matrix(batch.column("vec"))) @ unit.T
                best = sims.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(picks[best]), pa.array(sims.max(axis=1))], names=["id", "pick_id", "sim"])

    return vectors.mapInArrow(near, "id bigint, pick_id bigint, sim float")
