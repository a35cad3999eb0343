"""Vector operators: standardise, reduce, distances, exact neighbours, centroids, learned transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.common import valid_vector

#: Rows of a query block that is broadcast at a time, and groups that partial sums are added up in.
BLOCK_ROWS, SUM_GROUPS = 4096, 32


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vec_col: str, *extra: str) -> DataFrame:
    """(id, vec array<double>, extra) of rows with an id and a vector without null or NaN; all-zero vectors drop out."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), *extra)
    return rows.where(F.col("id").isNotNull() & valid_vector(F.col("vec"))).withColumn("vec", F.col("vec").cast("array<double>"))


def column_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """Mean and population deviation of each place of the vectors: pos, mean, std."""
    return df.select(F.posexplode(vec_col).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize(df: DataFrame, vec_col: str, out: str = "z") -> DataFrame:
    """Z-scores by population deviation; constant places become 0. The statistics are one row per place (the width of a vector)."""
    stats = sorted(column_stats(df, vec_col).collect())
    mean, std = F.array(*[F.lit(r["mean"]) for r in stats]), F.array(*[F.lit(r["std"] or 0.0) for r in stats])
    if not stats:
        return df.withColumn(out, F.col(vec_col).cast("array<double>"))
    scaled = F.zip_with(F.zip_with(F.col(vec_col), mean, lambda x, m: x - m), std, lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    return df.withColumn(out, scaled)


def moments(df: DataFrame, vec_col: str, group: str | None = None) -> dict:
    """Count, sum and sum of outer products of the vectors, by group if given (a bounded set of labels).

    Summed per batch, then in `SUM_GROUPS` groups, so the driver gets at most that many matrices per label.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g = as_matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=object)
            for label in dict.fromkeys(g):
                m = x[g == label]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([len(m)]), pa.array([m.sum(axis=0)], pa.list_(pa.float64())), pa.array([(m.T @ m).reshape(-1)], pa.list_(pa.float64()))], names=["g", "n", "s", "o"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "n": [int(pdf.n.sum())], "s": [np.sum(np.stack(pdf.s.to_list()), axis=0)], "o": [np.sum(np.stack(pdf.o.to_list()), axis=0)]})

    schema = "g string, n bigint, s array<double>, o array<double>"
    label = F.col(group).cast("string") if group else F.lit("")
    parts = df.where(valid_vector(F.col(vec_col))).select(F.col(vec_col).cast("array<double>").alias("v"), label.alias("g")).mapInArrow(partial, schema)
    spread = parts.withColumn("__k", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)))
    out: dict = {}
    for r in spread.groupBy("g", "__k").applyInPandas(lambda pdf: add(pdf.drop(columns="__k")), schema).collect():
        n, s, o = out.get(r["g"], (0, 0.0, 0.0))
        out[r["g"]] = (n + r["n"], s + np.array(r["s"]), o + np.array(r["o"]).reshape(len(r["s"]), -1))
    return out


def apply_matrix(df: DataFrame, vec_col: str, mean: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    """Add `(vec - mean) @ matrix`; the matrix is at most width x width."""

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_list()) - mean) @ matrix)) if len(v) else v

    return df.withColumn(out, project(F.col(vec_col).cast("array<double>")))


def fit_pca(df: DataFrame, vec_col: str, variance: float = 0.95, cap: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the principal axes that reach `variance`, at most `cap`; signs fixed by each axis' largest entry."""
    got = moments(df, vec_col).get("")
    if got is None:
        return np.zeros(0), np.zeros((0, 0))
    n, s, o = got
    mean = s / n
    values, axes = np.linalg.eigh(o / n - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    k = min(cap, int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), variance - 1e-12) + 1), len(values))
    axes = axes[:, :k]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])


def reduce_pca(df: DataFrame, vec_col: str, variance: float = 0.95, cap: int = 50, out: str = "reduced") -> DataFrame:
    """Vectors in the space of their principal axes."""
    mean, axes = fit_pca(df, vec_col, variance, cap)
    return df.withColumn(out, F.col(vec_col).cast("array<double>")) if not len(mean) else apply_matrix(df, vec_col, mean, axes, out)


def fit_lda(df: DataFrame, vec_col: str, label: str, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and discriminant axes from the scatter within and between labels (null labels don't count)."""
    by = moments(df.where(F.col(label).isNotNull()), vec_col, label)
    if len(by) < 2:
        raise ValueError("a discriminant transform needs two labels")
    n = sum(x[0] for x in by.values())
    mean = sum(x[1] for x in by.values()) / n
    within = sum(o - np.outer(s, s) / m for m, s, o in by.values()) / n
    between = sum(m * np.outer(s / m - mean, s / m - mean) for m, s, _ in by.values()) / n
    root = np.linalg.cholesky(within + ridge * max(np.trace(within) / len(within), 1e-6) * np.eye(len(within)))
    half = np.linalg.solve(root, np.linalg.solve(root, between).T)
    _, axes = np.linalg.eigh((half + half.T) / 2)
    return mean, np.linalg.solve(root.T, axes[:, ::-1][:, : min(len(by) - 1, len(within))])


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest of `rows` to each of `queries` (both id, vec): i, j, dist, rank; a row isn't its own neighbour.

    Metrics: cosine (1 - cosine), euclidean, manhattan. Queries are taken in blocks of `block`, each broadcast
    in turn and held against all rows; every batch of rows keeps k per query, so no pair beyond that leaves
    a task. Equal distances (to 9 places) rank by j.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    parts = None
    marked = queries.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for b in range(blocks):
        held = marked.where(F.col("__part") == b).select("id", "vec").toPandas()
        if not len(held):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((held.id.to_numpy(), np.stack(held.vec.to_list()).astype(np.float64)))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                d, own = distances(q, as_matrix(batch.column("vec")), metric), batch.column("id").to_numpy()
                d = np.round(np.where(ids[:, None] == own[None, :], np.inf, d), 9)
                order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, : min(k, len(own))]
                i, j, dist = np.repeat(ids, order.shape[1]), own[order].reshape(-1), np.take_along_axis(d, order, 1).reshape(-1)
                keep = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(dist[keep])], names=["i", "j", "dist"])

        part = rows.select("id", "vec").mapInArrow(near, "i bigint, j bigint, dist double")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return rows.sparkSession.createDataFrame([], "i bigint, j bigint, dist double, rank int")
    w = Window.partitionBy("i").orderBy("dist", "j")
    return parts.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two matrices."""
    if metric == "cosine":
        return 1.0 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))
    if metric == "manhattan":
        return np.concatenate([np.abs(a[lo : lo + 16, None, :] - b[None]).sum(axis=2) for lo in range(0, len(a), 16)]) if len(a) else np.zeros((0, len(b)))
    raise ValueError(f"unknown metric {metric!r}")


def centroids(df: DataFrame, label: str, vec_col: str = "vec") -> DataFrame:
    """Mean vector and size of each label, summed by (label, place) so that a frequent label is no hot task."""
    cells = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vec_col).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("centroid"), F.max("n").alias("n"))


def with_centroid_distance(df: DataFrame, label: str, vec_col: str = "vec", out: str = "centroid_dist") -> DataFrame:
    """Distance of each row to the centroid of its label (null without a label)."""
    from voxloom.functions.scalars import euclidean

    cen = centroids(df, label, vec_col).select(label, "centroid")
    return df.join(cen, label, "left").withColumn(out, euclidean(F.col(vec_col), F.col("centroid"))).drop("centroid")


def closest_per_cluster(df: DataFrame, label: str, n: int, vec_col: str = "vec") -> DataFrame:
    """The n rows of each label nearest to its centroid, with rank; ties by id."""
    w = Window.partitionBy(label).orderBy(F.round("centroid_dist", 9), "id")
    return with_centroid_distance(df.where(F.col(label).isNotNull()), label, vec_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_indices(df: DataFrame, label: str, vec_col: str = "vec", block: int = BLOCK_ROWS) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of labelled vectors in one row (k, n, davies_bouldin, calinski_harabasz).

    Needs only sums by label; for Davies-Bouldin blocks of centroids are broadcast in turn and held
    against all centroids. Both are null with fewer than two labels.
    """
    rows = df.where(F.col(label).isNotNull())
    d = with_centroid_distance(rows, label, vec_col, "d")
    spread = d.groupBy(F.col(label).cast("string").alias("l")).agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"))
    cen = centroids(rows, label, vec_col).select(F.col(label).cast("string").alias("l"), "centroid", "n").join(spread, "l")
    n_blocks, worst = max(1, -(-cen.count() // block)), None
    for b in range(n_blocks):
        held = cen.where(F.pmod(F.xxhash64("l"), F.lit(n_blocks)) == b).select("l", "centroid", "s").toPandas()
        if not len(held):
            continue
        shared = df.sparkSession.sparkContext.broadcast((held.l.to_list(), np.stack(held.centroid.to_list()).astype(np.float64), held.s.to_numpy()))

        def ratio(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, c, s = shared.value
            for batch in batches:
                if batch.num_rows:
                    mine = batch.column("l").to_pylist()
                    gap = distances(as_matrix(batch.column("centroid")), c, "euclidean")
                    same = np.array(mine, dtype=object)[:, None] == np.array(names, dtype=object)[None, :]
                    r = np.where(same, -1.0, (batch.column("s").to_numpy()[:, None] + s[None, :]) / np.where(same, 1.0, gap))
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array(r.max(axis=1))], names=["l", "r"])

        part = cen.select("l", "centroid", "s").mapInArrow(ratio, "l string, r double")
        worst = part if worst is None else worst.union(part)
    whole = rows.select(F.posexplode(vec_col).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    grand = F.array(*[F.lit(r["m"]) for r in whole]) if whole else F.array().cast("array<double>")
    from voxloom.functions.scalars import euclidean

    sums = cen.agg(F.sum(F.col("n") * F.pow(euclidean(F.col("centroid"), grand), F.lit(2))).alias("between"), F.sum("w").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    k, n, within, between = sums["k"], sums["n"] or 0, sums["within"] or 0.0, sums["between"] or 0.0
    score = round(between * (n - k) / (within * (k - 1)), 4) if k > 1 and within > 0 else None
    base = worst if worst is not None else df.sparkSession.createDataFrame([], "l string, r double")
    dbi = F.round(F.avg("r"), 6) if k > 1 else F.lit(None).cast("double")
    top = base.groupBy("l").agg(F.max("r").alias("r"))
    return top.agg(dbi.alias("davies_bouldin")).select(F.lit(k).alias("k"), F.lit(n).cast("bigint").alias("n"), "davies_bouldin", F.lit(score).cast("double").alias("calinski_harabasz"))


def mean_distances(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean euclidean distance of each row of (id, vec, g) to the other rows of its group: id, mean_dist (null if alone).

    Exact: groups are cut into blocks, each pair of blocks is one group of work that emits a sum for each row.
    """
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    cut = rows.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    spread = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    ask = spread.select("g", F.col("p").alias("i"), F.col("q").alias("j"), F.lit(True).alias("asks"), "id", "vec")
    told = spread.select("g", F.col("q").alias("i"), F.col("p").alias("j"), F.lit(False).alias("asks"), "id", "vec")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        x, y = (np.stack(s.vec.to_list()) if len(s) else np.zeros((0, 1)) for s in (a, b))
        total = [distances(x[lo : lo + 1024], y, "euclidean").sum(axis=1) for lo in range(0, len(x), 1024)] if len(y) else []
        return pd.DataFrame({"id": a.id, "total": np.concatenate(total) if total else np.zeros(len(a))})

    parts = ask.unionByName(told).groupBy("g", "i", "j").applyInPandas(lambda pdf: sums(pdf), "id bigint, total double")
    return parts.groupBy("id").agg(F.sum("total").alias("total")).join(cut.select("id", "n"), "id").select("id", F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).alias("mean_dist"))


def soft_memberships(df: DataFrame, label: str, top: int = 5, vec_col: str = "vec") -> DataFrame:
    """The `top` labels each row of (id, vec) belongs to most: id, rank, cluster, share.

    The share of a label falls with the distance to its centroid: 1 / d over the sum of 1 / d (d at least 1e-9). Equal shares
    rank by label. One row for each label is broadcast; more than `BLOCK_ROWS` labels are refused.
    """
    held = centroids(df.where(F.col(label).isNotNull()), label, vec_col).select(label, "centroid").limit(BLOCK_ROWS + 1).toPandas().sort_values(label)
    if len(held) > BLOCK_ROWS:
        raise ValueError(f"memberships in more than {BLOCK_ROWS} clusters are not computed")
    kind, arrow = dict(df.dtypes)[label], to_arrow_type(df.schema[label].dataType)
    shared = df.sparkSession.sparkContext.broadcast((held[label].to_list(), np.stack(held.centroid.to_list()) if len(held) else None))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centre = shared.value
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            near = 1.0 / np.maximum(distances(as_matrix(batch.column("vec")), centre, "euclidean"), 1e-9)
            near = np.round(near / near.sum(axis=1, keepdims=True), 12)
            order = np.argsort(-near, axis=1, kind="stable")[:, :top]
            ids = np.repeat(batch.column("id").to_numpy(), order.shape[1])
            out = [pa.array(ids), pa.array(np.tile(np.arange(1, order.shape[1] + 1), len(near)).astype(np.int32)), pa.array([names[c] for c in order.reshape(-1)], arrow), pa.array(np.take_along_axis(near, order, 1).reshape(-1))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "rank", "cluster", "share"])

    return df.select(F.col("id").cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(share, f"id bigint, rank int, cluster {kind}, share double")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] by their least and largest value (nulls and NaN don't count and become null); a column
    without range becomes 0. Two figures for each column come to the driver."""
    real = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    ends = df.agg(*[f(real[c]).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in columns:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        scaled[c] = real[c] if lo is None else F.when(real[c].isNotNull(), (real[c] - lo) / (hi - lo) if hi > lo else F.lit(0.0))
    return df.withColumns(scaled)


def fit_lmnn(df: DataFrame, vec_col: str, label: str, sample: int = 2000, targets: int = 3, rounds: int = 60, pull: float = 0.5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix of a large-margin transform: rows are drawn to their `targets` nearest of the same label and rows
    of other labels pushed out by a margin.

    Fitted by gradient steps on at most `sample` labelled rows, those with the smallest hash of their vector; falls back to
    `fit_lda` where no label has more than one row among them. Starts from the identity; the step is kept only if it helps.
    """
    got = df.where(F.col(label).isNotNull() & valid_vector(F.col(vec_col))).select(F.col(vec_col).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l")).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).toPandas()
    y = got.l.to_numpy()
    _, counts = np.unique(y, return_counts=True)
    if len(counts) < 2 or counts.max() < 2:
        return fit_lda(df, vec_col, label)
    x = np.stack(got.v.to_list())
    mean = x.mean(axis=0)
    x = (x - mean) / max(np.sqrt(((x - mean) ** 2).sum(axis=1)).mean(), 1e-12)
    same = y[:, None] == y[None, :]
    d = distances(x, x, "euclidean") + np.where(same & ~np.eye(len(x), dtype=bool), 0.0, np.inf)
    near = np.argsort(d, axis=1)[:, :targets]
    i = np.repeat(np.arange(len(x)), near.shape[1])
    j = near.reshape(-1)
    ok = np.isfinite(d[i, j])
    i, j = i[ok], j[ok]
    transform, step = np.eye(x.shape[1]), 1e-2

    def cost(m: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ m
        sq = distances(z, z, "euclidean") ** 2
        own = sq[i, j]
        viol = 1.0 + own[:, None] - sq[i]
        viol = np.where(same[i], 0.0, np.maximum(viol, 0.0))
        active = (viol > 0).astype(np.float64)
        pulls = pull + (1 - pull) * active.sum(axis=1) / len(x)
        diff = x[i] - x[j]
        grad = diff.T @ (diff * pulls[:, None])
        weight = np.zeros((len(x), len(x)))
        np.add.at(weight, i, active * (1 - pull) / len(x))
        grad -= x.T @ (weight.sum(axis=1)[:, None] * x) + x.T @ (weight.sum(axis=0)[:, None] * x) - x.T @ (weight + weight.T) @ x
        return pull * own.sum() + (1 - pull) * viol.sum() / len(x), 2 * grad @ m / len(x)

    now, grad = cost(transform)
    for _ in range(rounds):
        tried = transform - step * grad
        value, slope = cost(tried)
        if value < now:
            transform, now, grad, step = tried, value, slope, step * 1.2
        else:
            step /= 3
    return mean, transform


def silhouettes(df: DataFrame, label: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette (euclidean) of each row of (id, vec, label): id, label, silhouette; exact.

    Rows are taken in blocks that are broadcast and held against all; each batch emits the summed
    distances of a block's rows to every label, not the pairs. Rows alone in their label get 0.
    """
    rows = df.where(F.col(label).isNotNull()).select("id", "vec", F.col(label).cast("string").alias("l"))
    blocks = max(1, -(-rows.count() // block))
    parts = None
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").toPandas()
        if not len(held):
            continue
        shared = df.sparkSession.sparkContext.broadcast((held.id.to_numpy(), np.stack(held.vec.to_list()).astype(np.float64)))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if batch.num_rows:
                    labels, at = np.unique(np.array(batch.column("l").to_pylist()), return_inverse=True)
                    hot = np.eye(len(labels))[at]
                    total = distances(q, as_matrix(batch.column("vec")), "euclidean") @ hot
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(labels))), pa.array(np.tile(labels, len(ids)).tolist(), pa.string()), pa.array(total.reshape(-1))], names=["id", "other", "total"])

        part = rows.mapInArrow(sums, "id bigint, other string, total double")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return df.sparkSession.createDataFrame([], "id bigint, label string, silhouette double")
    sizes = rows.groupBy(F.col("l").alias("other")).agg(F.count("*").alias("n"))
    means = parts.groupBy("id", "other").agg(F.sum("total").alias("total")).join(sizes, "other").join(rows.select("id", "l"), "id")
    own = F.col("other") == F.col("l")
    got = means.groupBy("id", "l").agg(F.max(F.when(own, F.col("total") / (F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return got.select("id", F.col("l").alias("label"), F.round(F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0), 6).alias("silhouette"))


def trial_scores(trials: DataFrame, vectors: DataFrame, enroll: str = "enroll", test: str = "test") -> DataFrame:
    """Cosine of the two vectors of each trial; trials with an unknown id are left out."""
    from voxloom.functions.scalars import cosine

    a = vectors.select(F.col("id").alias(enroll), F.col("vec").alias("__a"))
    b = vectors.select(F.col("id").alias(test), F.col("vec").alias("__b"))
    return trials.join(a, enroll).join(b, test).withColumn("score", cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def vector_mean(v: Column) -> Column:
    """Mean of the values of an array."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
