"""Clustering: density hierarchy, k-means, Mapper, diagnostics, model choice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.functions.scalars import cluster_count_score, membership_score
from voxloom.operators.components import connected_components
from voxloom.operators.graphs import joining_edges, middle_distance, mutual_reachability, with_bound
from voxloom.operators.vectors import apply_matrix, exact_neighbours, fit_pca, silhouettes

#: Largest tree whose hierarchy one task condenses; `density_clusters` refuses larger input.
MAX_TREE_EDGES = 5_000_000


def condense(i: np.ndarray, j: np.ndarray, d: np.ndarray, nodes: np.ndarray, min_size: int, leaf: bool = False, profile: bool = False) -> pd.DataFrame:
    """Flat clusters from the edges of a spanning forest: id, cluster (-1 noise), prob, outlier.

    The edges are merged in order of (d, i, j). Of the merge tree only branches of at least `min_size`
    rows are clusters; a row leaves its cluster at 1 / d of the merge that drops it. Clusters are chosen by
    excess of mass (or as leaves), never the root. prob is a row's lambda over its cluster's largest,
    outlier 1 - its lambda over the largest below the branch it left. Clusters are numbered by smallest id. With
    `profile` one row for each cluster instead: size, birth and largest lambda, stability (its mass) and persistence (stability
    over size times the largest lambda of all).
    """
    n = len(nodes)
    at = {x: k for k, x in enumerate(nodes.tolist())}
    order = np.lexsort((j, i, d))
    parent, top = list(range(n)), list(range(n))
    left, right, height, size = [-1] * n, [-1] * n, [0.0] * n, [1] * n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: int, b: int, h: float) -> None:
        left.append(top[a]), right.append(top[b]), height.append(h), size.append(size[top[a]] + size[top[b]])
        parent[b] = a
        top[a] = len(left) - 1

    for e in order.tolist():
        a, b = find(at[int(i[e])]), find(at[int(j[e])])
        if a != b:
            join(a, b, float(d[e]))
    roots = sorted({find(x) for x in range(n)})
    for r in roots[1:]:  # parts of a forest meet at infinite distance
        join(find(roots[0]), r, math.inf)
    lam = lambda h: 0.0 if math.isinf(h) else 1.0 / max(h, 1e-12)
    birth, mass, kids, home, drop, deepest = [0.0], [0.0], [[]], np.zeros(n, int), np.zeros(n), [0.0]
    stack = [(len(left) - 1, 0)] if n > 1 else []
    while stack:
        node, c = stack.pop()
        if left[node] < 0:
            home[node], drop[node] = c, math.inf
            continue
        here, pair = lam(height[node]), (left[node], right[node])
        big = [x for x in pair if size[x] >= min_size]
        if len(big) == 2:
            for x in pair:
                birth.append(here), mass.append(0.0), kids.append([]), deepest.append(here)
                kids[c].append(len(birth) - 1)
                mass[c] += size[x] * (here - birth[c])
                stack.append((x, len(birth) - 1))
            deepest[c] = max(deepest[c], here)
            continue
        for x in pair:
            if big and x == big[0]:
                stack.append((x, c))
                continue
            below = [x]
            while below:
                y = below.pop()
                if left[y] < 0:
                    home[y], drop[y] = c, here
                    mass[c] += here - birth[c]
                    deepest[c] = max(deepest[c], here)
                else:
                    below += [left[y], right[y]]
    drop = np.where(np.isinf(drop), [deepest[c] for c in home], drop)
    keep, score = [False] * len(birth), list(mass)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(score[k] for k in kids[c])
        if kids[c] and (leaf or below > score[c]):
            score[c] = below
        else:
            keep[c] = True
    owner, below_max = [-1] * len(birth), list(deepest)
    for c in range(len(birth) - 1, -1, -1):
        for k in kids[c]:
            below_max[c] = max(below_max[c], below_max[k])
    for c in range(len(birth)):
        if keep[c] and owner[c] < 0:
            owner[c] = c
        for k in kids[c]:
            owner[k] = owner[c]
    cluster = np.array([owner[c] for c in home]) if n else np.zeros(0, int)
    peak = {c: max(drop[cluster == c].max(), 1e-300) for c in set(cluster.tolist()) - {-1}}
    first = {c: min(nodes[cluster == c]) for c in peak}
    name = {c: k for k, c in enumerate(sorted(peak, key=lambda c: first[c]))}
    if profile:
        last = max([x for x in drop.tolist() if not math.isinf(x)], default=0.0)
        held = lambda c: int((cluster == c).sum())
        return pd.DataFrame({
            "cluster": list(name.values()), "size": [held(c) for c in name], "birth_lambda": [birth[c] for c in name], "max_lambda": [float(peak[c]) for c in name],
            "stability": [mass[c] for c in name], "persistence": [mass[c] / (held(c) * last) if last > 0 else 1.0 for c in name],
        })
    return pd.DataFrame({
        "id": nodes, "cluster": [name.get(c, -1) for c in cluster.tolist()], "prob": [min(1.0, drop[k] / peak[c]) if c in peak else 0.0 for k, c in enumerate(cluster.tolist())],
        "outlier": [1 - drop[k] / below_max[home[k]] if below_max[home[k]] > 0 else 0.0 for k in range(n)],
    })


def density_clusters(vectors: DataFrame, min_cluster_size: int = 25, min_samples: int = 5, k: int = 30, metric: str = "euclidean", leaf: bool = False, knn: DataFrame | None = None, profile: bool = False) -> DataFrame:
    """Density clustering of (id, vec): id, cluster (-1 noise), prob, outlier.

    Core distance is the distance to the `min_samples`-th other row. The spanning tree of the mutual reachability of
    all pairs is built by distributed rounds: the k nearest neighbours (exact; given or computed) spare most of the
    search, what they can't decide is searched among all rows. Only its n - 1 edges go to the task that condenses
    the hierarchy, at most `MAX_TREE_EDGES`, else an error is raised. With `profile` (C8) one row for each cluster:
    cluster, size, birth_lambda, max_lambda, stability, persistence.
    """
    near = checkpoint(knn if knn is not None else exact_neighbours(vectors, vectors, max(k, min_samples), metric))
    core = near.where(F.col("rank") <= min_samples).groupBy(F.col("i").alias("id")).agg(F.max("dist").alias("core"))
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).join(core, "id", "left")
    rows = with_bound(rows.select("id", "vec", F.coalesce("core", F.lit(0.0)).alias("core"), F.col("id").alias("comp")), near)
    tree = checkpoint(joining_edges(rows, mutual_reachability(near, min_samples), metric))
    n = tree.count()
    if n > MAX_TREE_EDGES:
        raise ValueError(f"the hierarchy of {n} edges exceeds {MAX_TREE_EDGES}; cluster parts of the data instead")
    alone = vectors.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        edge = pdf[pdf.i != pdf.j]
        return condense(edge.i.to_numpy(), edge.j.to_numpy(), edge.d.to_numpy(), np.sort(pdf.loc[pdf.i == pdf.j, "i"].unique()), min_cluster_size, leaf, profile)

    schema = "cluster int, size bigint, birth_lambda double, max_lambda double, stability double, persistence double" if profile else "id bigint, cluster int, prob double, outlier double"
    whole = tree.select("i", "j", "d").union(alone).withColumn("part", F.lit(0))
    return whole.groupBy("part").applyInPandas(lambda pdf: solve(pdf.drop(columns="part")), schema)


def cluster_summary(clusters: DataFrame, label: str = "cluster") -> DataFrame:
    """Number of clusters without noise and percentage of rows in one."""
    inside = F.col(label).isNotNull() & (F.col(label) != -1)
    return clusters.agg(F.count_distinct(F.when(inside, F.col(label))).alias("n_clusters"), F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)) * 100, 6).alias("membership_pct"))


def choose_model(runs: Iterable[tuple[dict, Callable[[], DataFrame]]], least: int = 3) -> tuple[dict, DataFrame] | None:
    """Of several (parameters, clustering) the one with the best mean of the two score curves; those with
    fewer than `least` clusters don't count; None if none is left."""
    best = None
    for params, make in runs:
        found = checkpoint(make())
        row = cluster_summary(found).select("n_clusters", "membership_pct", ((cluster_count_score(F.col("n_clusters").cast("double")) + membership_score(F.col("membership_pct"))) / 2).alias("score")).first()
        if row["n_clusters"] >= least and (best is None or row["score"] > best[0]):
            best = (row["score"], params | row.asDict(), found)
    return best and (best[1], best[2])


def score_grid(vectors: DataFrame, grid: list[dict], repeats: int, make: Callable[..., DataFrame]) -> list[dict]:
    """Every parameter set of a grid run `repeats` times by `make(vectors, seed=, **params)` (id, cluster): clusters, membership, the
    mean of the two score curves and the mean silhouette of the rows in a cluster (None with fewer than two clusters)."""
    out = []
    for params in grid:
        for seed in range(repeats):
            found = checkpoint(make(vectors, seed=seed, **params))
            row = cluster_summary(found).select("n_clusters", "membership_pct", ((cluster_count_score(F.col("n_clusters").cast("double")) + membership_score(F.col("membership_pct"))) / 2).alias("score")).first()
            inside = found.where(F.col("cluster") >= 0).join(vectors.select("id", "vec"), "id") if "vec" not in found.columns else found.where(F.col("cluster") >= 0)
            quality = silhouettes(inside.select("id", "vec", "cluster"), "cluster").agg(F.avg("silhouette")).first()[0] if row["n_clusters"] > 1 else None
            out.append({**params, "seed": seed, **row.asDict(), "silhouette": quality})
    return out


def kmeans(vectors: DataFrame, k: int = 10, n_init: int = 10, seed: int = 42) -> DataFrame:
    """C4: k-means, best of `n_init` seeded starts: id, vec, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = checkpoint(vectors.withColumn("features", array_to_vector("vec")))
    fits = [KMeans(k=k, seed=seed + t, maxIter=50, tol=1e-4).fit(data) for t in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("id", "vec", F.col("prediction").alias("cluster"))


def cluster_profile(rows: DataFrame, label: str, prob: str, outlier: str, core: str | None = None) -> DataFrame:
    """Size, mean, least and largest probability, mean outlier score and, with `core`, mean core distance of each
    cluster (null and -1 don't count)."""
    p, o = (F.when(~F.isnan(F.col(c)), F.col(c).cast("double")) for c in (prob, outlier))
    return rows.where(F.col(label).isNotNull() & (F.col(label) != -1)).groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_prob"), F.round(F.min(p), 6).alias("min_prob"), F.round(F.max(p), 6).alias("max_prob"), F.round(F.avg(o), 6).alias("mean_outlier"), *([F.round(F.avg(core), 6).alias("mean_core")] if core else []))


def cluster_histogram(rows: DataFrame, label: str, truth: str) -> DataFrame:
    """A5: of each cluster its size and the counts of the true labels in it, as a map (null and -1 clusters and null truths don't count)."""
    cells = rows.where(F.col(label).isNotNull() & (F.col(label) != -1) & F.col(truth).isNotNull()).groupBy(label, F.col(truth).cast("string").alias("t")).agg(F.count("*").alias("n"))
    return cells.groupBy(label).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("histogram"))


def neighbour_diagnostics(knn: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """For each row the distance to its k-th neighbour, its inverse, and the label entropy (natural) of the k neighbours."""
    near = knn.where(F.col("rank") <= k).join(labels.select(F.col("id").alias("j"), F.col("cluster")), "j", "left")
    votes = near.groupBy("i", "cluster").agg(F.count("*").alias("c"), F.max("dist").alias("d"))
    got = votes.groupBy("i").agg(F.max("d").alias("core_dist"), (F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("h"))
    return got.select(F.col("i").alias("id"), F.round("core_dist", 6).alias("core_dist"), F.round(F.when(F.col("core_dist") > 0, 1 / F.col("core_dist")), 6).alias("lambda"), F.round(F.abs("h"), 6).alias("label_entropy"))


def mapper_nodes(vectors: DataFrame, knn: DataFrame, cubes: int = 10, overlap: float = 0.5, radius: float | None = None) -> DataFrame:
    """Mapper nodes (cube, node, id): the first principal coordinate is covered by overlapping cubes; inside a cube
    rows linked by neighbour distances up to `radius` (median if not given) form a node."""
    mean, axes = fit_pca(vectors, "vec", 1.0, 1)
    lens = apply_matrix(vectors, "vec", mean, axes, "z").select("id", F.col("z")[0].alias("z"))
    low, high = lens.agg(F.min("z"), F.max("z")).first()
    if radius is None:
        radius = middle_distance(knn) or 0.0
    width = max((high or 0.0) - (low or 0.0), 1e-12) / (cubes - (cubes - 1) * overlap)
    step = width * (1 - overlap)
    cube = F.explode(F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("z") - low - width) / step - 1e-9)), F.least(F.lit(cubes - 1), F.floor((F.col("z") - low) / step + 1e-9))), lambda c: c.cast("bigint")))
    spread = checkpoint(lens.select("id", cube.alias("cube")))
    near = knn.where(F.col("dist") <= radius).select("i", "j")
    key = lambda c: F.col(c) * cubes + F.col("cube")
    inside = near.join(spread.withColumnRenamed("id", "i"), "i").join(spread.select(F.col("id").alias("j"), F.col("cube").alias("other")), "j").where("cube = other")
    parts = connected_components(inside.select(key("i").alias("a"), key("j").alias("b")))
    return spread.withColumn("k", key("id")).join(parts, F.col("k") == parts.id, "left").select("cube", F.coalesce("component", "k").alias("node"), spread.id)


def mapper_links(nodes: DataFrame) -> DataFrame:
    """Mapper nodes that share rows: a < b, n shared. A row lies in few cubes, so its pairs are few."""
    left, right = nodes.select("id", F.col("node").alias("a")), nodes.select("id", F.col("node").alias("b"))
    return left.join(right, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def mapper_groups(nodes: DataFrame, links: DataFrame, least: int = 1) -> DataFrame:
    """Connected groups of Mapper nodes of at least `least` nodes; nodes without a link are their own group."""
    parts = connected_components(links.select("a", "b"))
    every = nodes.select("node").distinct().join(parts, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("group"))
    w = Window.partitionBy("group")
    return every.withColumn("n_nodes", F.count("*").over(w)).where(F.col("n_nodes") >= least)
