"""Non-linear embeddings: uniform manifold approximation and stochastic neighbour embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.vectors import as_matrix, distances

#: Rows that a layout is fitted on; the others are placed among them.
UMAP_LANDMARKS, TSNE_LANDMARKS = 4000, 1000


def smooth_weights(near: np.ndarray) -> np.ndarray:
    """Membership strengths of sorted neighbour distances: exp(-(d - nearest) / scale), the scale so that they sum to log2(k)."""
    k = near.shape[1]
    rho = np.where(near > 0, near, np.inf).min(axis=1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    over = np.maximum(near - rho[:, None], 0.0)
    low, high, scale = np.zeros(len(near)), np.full(len(near), np.inf), np.ones(len(near))
    for _ in range(48):
        large = np.exp(-over / scale[:, None]).sum(axis=1) > np.log2(max(k, 2))
        high, low = np.where(large, scale, high), np.where(large, low, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
    scale = np.maximum(scale, 1e-3 * max(near.mean(), 1e-12))
    return np.exp(-over / scale[:, None])


def curve_of(min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to 1 up to `min_dist` and an exponential beyond, on a grid."""
    x = np.linspace(0.01, 3, 200)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    grid = [(a, b) for a in np.geomspace(0.3, 8, 60) for b in np.linspace(0.5, 1.6, 45)]
    return min(grid, key=lambda ab: float(((1 / (1 + ab[0] * x ** (2 * ab[1])) - want) ** 2).sum()))


def principal_start(x: np.ndarray, width: int, spread: float) -> np.ndarray:
    """First principal coordinates, signs fixed, scaled to `spread`."""
    c = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    axes = axes[:width] * np.sign(axes[:width][np.arange(min(width, len(axes))), np.abs(axes[:width]).argmax(axis=1)])[:, None]
    start = c @ axes.T
    start = np.pad(start, ((0, 0), (0, width - start.shape[1])))
    return start / max(np.abs(start).max(), 1e-12) * spread


def umap_layout(x: np.ndarray, width: int, k: int, min_dist: float, metric: str, epochs: int, seed: int) -> np.ndarray:
    """Layout of a fuzzy neighbour graph: edges pull by their strength, random pairs push, the step falls to 0."""
    n = len(x)
    k = min(k, n - 1)
    if n < 3 or k < 1:
        return np.zeros((n, width))
    d = np.maximum(distances(x, x, metric), 0.0)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    strength = np.zeros((n, n))
    np.put_along_axis(strength, near, smooth_weights(np.take_along_axis(d, near, 1)), 1)
    strength = strength + strength.T - strength * strength.T
    i, j = np.nonzero(np.triu(strength) > strength.max() / max(epochs, 1))
    w = strength[i, j]
    rng, at = np.random.default_rng(seed), principal_start(x, width, 10.0)
    a, b = curve_of(min_dist)
    for e in range(epochs):
        step = 1.0 - e / epochs
        go = rng.random(len(w)) < w / w.max()
        p, q = i[go], j[go]
        diff = at[p] - at[q]
        sq = (diff * diff).sum(axis=1)
        pull = np.where(sq > 0, -2 * a * b * np.maximum(sq, 1e-12) ** (b - 1) / (1 + a * sq**b), 0.0)
        move = np.clip(diff * pull[:, None], -4, 4)
        shift = np.zeros_like(at)
        np.add.at(shift, p, move)
        np.add.at(shift, q, -move)
        for _ in range(3):
            o = rng.integers(0, n, len(p))
            diff = at[p] - at[o]
            sq = (diff * diff).sum(axis=1)
            push = np.where(p == o, 0.0, 2 * b / ((0.001 + sq) * (1 + a * sq**b)))
            np.add.at(shift, p, np.clip(diff * push[:, None], -4, 4))
        at = at + step * np.clip(shift, -4, 4)
    return at


def tsne_layout(x: np.ndarray, width: int, perplexity: float, metric: str, rounds: int, seed: int) -> np.ndarray:
    """Exact stochastic neighbour embedding: gradient descent with momentum on the divergence of the neighbour probabilities."""
    n = len(x)
    if n < 4:
        return np.zeros((n, width))
    sq = np.maximum(distances(x, x, metric), 0.0) ** 2
    np.fill_diagonal(sq, np.inf)
    target = np.log(min(perplexity, (n - 1) / 3))
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.full(n, 1.0 / max(np.median(sq[np.isfinite(sq)]), 1e-12))
    for _ in range(60):
        p = np.exp(-(sq - sq.min(axis=1, keepdims=True)) * beta[:, None])
        p /= p.sum(axis=1, keepdims=True)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1) > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    at, speed, gain = principal_start(x, width, 1e-2) + 1e-4 * np.random.default_rng(seed).standard_normal((n, width)), np.zeros((n, width)), np.ones((n, width))
    for r in range(rounds):
        early = r < rounds // 4
        q = 1 / (1 + distances(at, at, "euclidean") ** 2)
        np.fill_diagonal(q, 0.0)
        m = ((4.0 if early else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
        grad = 4 * (m.sum(axis=1)[:, None] * at - m @ at)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if early else 0.8) * speed - max(n / 12.0, 50.0) * gain * grad
        at = at + speed
        at -= at.mean(axis=0)
    return at


def placed(vectors: DataFrame, layout, landmarks: int, k: int, metric: str, seed: int, out: str) -> DataFrame:
    """Fit `layout` (a function of a matrix) on the `landmarks` rows of (id, vec) with the smallest hashes, all if there are no
    more, and put every other row at the mean of its k nearest landmarks, weighted by their strengths."""
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    held = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks).toPandas().sort_values("id")
    if not len(held):
        return rows.select("id", F.array().cast("array<double>").alias(out))
    x = np.stack(held.vec.to_list())
    shared = vectors.sparkSession.sparkContext.broadcast((held.id.to_numpy(), x, layout(x)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, at = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy()
            d = distances(as_matrix(batch.column("vec")), marks, metric)
            near = np.argsort(d, axis=1, kind="stable")[:, : max(1, min(k, len(ids)))]
            w = smooth_weights(np.maximum(np.take_along_axis(d, near, 1), 0.0))
            got = (at[near] * (w / w.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)
            spot = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            got = np.where((ids[spot] == own)[:, None], at[spot], got)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(got), pa.list_(pa.float64()))], names=["id", out])

    return rows.mapInArrow(place, f"id bigint, {out} array<double>")


def umap(vectors: DataFrame, width: int = 20, k: int = 15, min_dist: float = 0.1, metric: str = "cosine", epochs: int = 200, landmarks: int = UMAP_LANDMARKS, seed: int = 42, out: str = "reduced") -> DataFrame:
    """Uniform manifold approximation of (id, vec): id, `out`.

    The layout is fitted on at most `landmarks` rows by one process and holds for them; the rest is placed in one pass over
    the table, without a shuffle. Repeatable for a seed. Vectors must be of one length, without nulls, and for cosine not
    all zero; an empty table gives no rows.
    """
    return placed(vectors, lambda x: umap_layout(x, width, k, min_dist, metric, epochs, seed), landmarks, k, metric, seed, out)


def tsne(vectors: DataFrame, width: int = 2, perplexity: float = 30.0, metric: str = "euclidean", rounds: int = 300, landmarks: int = TSNE_LANDMARKS, seed: int = 42, out: str = "reduced") -> DataFrame:
    """Stochastic neighbour embedding of (id, vec): id, `out`; landmarks as in `umap`."""
    return placed(vectors, lambda x: tsne_layout(x, width, perplexity, metric, rounds, seed), landmarks, 5, metric, seed, out)
