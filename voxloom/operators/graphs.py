"""Graph operators on edge lists (i, j, w): affinities, normalisation, spanning trees, repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.operators.components import SOLO_EDGES, connected_components
from voxloom.operators.ordered import exact_quantiles
from voxloom.operators.vectors import BLOCK_ROWS, as_matrix, distances, exact_neighbours


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (i, j, w) also as (j, i, w)."""
    return edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def self_edges(nodes: DataFrame, weight: float = 0.1) -> DataFrame:
    return nodes.select("i", F.col("i").alias("j"), F.lit(weight).alias("w"))


def middle_distance(knn: DataFrame) -> float | None:
    """Exact median of the distances, None of none."""
    got = exact_quantiles(knn.where("dist is not null"), [], "dist", [0.5]).first()
    return got["q"][0] if got else None


def affinity(knn: DataFrame, method: str = "rbf", sigma: float | None = None, symmetric: bool = True, k: int | None = None) -> DataFrame:
    """G1: neighbour distances (i, j, dist) as affinities, with 0.1 on the diagonal; with `k` only the k nearest of each row (by rank).

    `rbf`: exp(-d^2 / 2 sigma^2), sigma the median positive distance unless given (A13); `inverse`: 1 / (1 + d).
    `symmetric` takes the mean of both directions (a missing one counts 0).
    """
    knn = knn if k is None else knn.where(F.col("rank") <= k)
    if method == "rbf" and sigma is None:
        sigma = middle_distance(knn.where("dist > 0")) or 1.0
    w = F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma)) if method == "rbf" else 1 / (1 + F.col("dist"))
    edges = knn.select("i", "j", w.alias("w"))
    if symmetric:
        edges = both_ways(edges).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    return edges.unionByName(self_edges(knn.select("i").union(knn.select(F.col("j").alias("i"))).distinct()))


def local_scaled(knn: DataFrame, floor: float = 1e-8, mutual: str = "product", diagonal: float | None = 0.1) -> DataFrame:
    """Local scaling exp(-d^2 / (s_i s_j)), s = distance to the last neighbour kept (at least `floor`).

    `product` keeps mutual edges and multiplies their two weights; `mean` keeps every edge with the mean of
    both directions.
    """
    scale = knn.groupBy("i").agg(F.greatest(F.max("dist"), F.lit(floor)).alias("s"))
    edges = knn.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    edges = edges.select("i", "j", F.exp(-F.col("dist") * F.col("dist") / (F.col("s") * F.col("t") + 1e-12)).alias("w"))
    if mutual == "product":
        back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
        edges = edges.join(back, ["i", "j"]).select("i", "j", (F.col("w") * F.col("v")).alias("w"))
    else:
        edges = both_ways(edges).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    return edges if diagonal is None else edges.unionByName(self_edges(knn.select("i").distinct(), diagonal))


def mutual_reachability(knn: DataFrame, min_samples: int, self_counts: bool = False) -> DataFrame:
    """Edges (i < j, d) with d = max(core_i, core_j, dist); core distance = distance to the `min_samples`-th neighbour (rank)."""
    k = min_samples - 1 if self_counts else min_samples
    core = knn.where(F.col("rank") <= max(k, 1)).groupBy("i").agg(F.max("dist").alias("core"))
    once = knn.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").groupBy("i", "j").agg(F.min("dist").alias("dist"))
    both = once.join(core, "i").join(core.select(F.col("i").alias("j"), F.col("core").alias("other")), "j")
    return both.select("i", "j", F.greatest("core", "other", "dist").alias("d"))


def reachability_kernel(knn: DataFrame, k: int, self_weight: float = 0.1) -> DataFrame:
    """Affinities exp(-max(core_i, core_j, d)) over the k nearest neighbours, averaged over both directions (a missing
    one counts 0), and `self_weight` on the diagonal: i, j, w. Core distance = distance to the k-th neighbour."""
    near = knn.where(F.col("rank") <= k)
    core = near.groupBy("i").agg(F.max("dist").alias("core"))
    far = F.greatest("core", "other", "dist")
    one = near.join(core, "i").join(core.select(F.col("i").alias("j"), F.col("core").alias("other")), "j").select("i", "j", (F.exp(-far) / 2).alias("w"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    return both.unionByName(core.select("i", F.col("i").alias("j"), F.lit(float(self_weight)).alias("w")))


def adaptive_graph(knn: DataFrame, k: int, sigma: str = "kth", vectors: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """Affinities exp(-d^2 / (s_i s_j)) over the k nearest neighbours, averaged over both directions: i, j, w.

    `sigma`: a row's `kth`, `median` or `mean` neighbour distance, or `global`, the median of all. With `vectors` components
    are joined by the lightest edges (`connect`). The info of the graph is `graph_stats`.
    """
    near = knn.where(F.col("rank") <= k)
    if sigma == "global":
        middle = middle_distance(near) or 0.0
        one = near.select("i", "j", F.exp(-F.col("dist") * F.col("dist") / (middle * middle + 1e-8)).alias("w"))
    else:
        pick = {"kth": F.max("dist"), "median": F.percentile("dist", F.lit(0.5)), "mean": F.avg("dist")}[sigma]
        scale = near.groupBy("i").agg(F.greatest(pick, F.lit(1e-8)).alias("s"))
        one = near.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", F.exp(-F.col("dist") * F.col("dist") / (F.col("s") * F.col("t") + 1e-8)).alias("w"))
    half = one.withColumn("w", F.col("w") / 2)
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    return both if vectors is None else connect(both, near.select("i", "j", F.col("dist").alias("d")), vectors=vectors, metric=metric)


def row_stochastic(edges: DataFrame) -> DataFrame:
    """Weights divided by their row sum; rows that sum to 0 stay 0."""
    total = edges.groupBy("i").agg(F.sum("w").alias("t"))
    return edges.join(total, "i").select("i", "j", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("w"))


def kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Minimum spanning forest of the edges (i, j, d) of a small graph; equal weights by (i, j)."""
    pdf = pdf.sort_values(["d", "i", "j"])
    nodes = {x: k for k, x in enumerate(pd.unique(pd.concat([pdf.i, pdf.j])).tolist())}
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for a, b in zip(pdf.i.tolist(), pdf.j.tolist(), strict=True):
        x, y = find(nodes[a]), find(nodes[b])
        keep.append(x != y)
        parent[x] = y
    return pdf.loc[np.array(keep, bool), ["i", "j", "d"]]


def minimum_spanning_forest(edges: DataFrame, max_rounds: int = 40, solo_edges: int = SOLO_EDGES) -> DataFrame:
    """Minimum spanning forest of undirected edges (i, j, d) by Boruvka rounds: i < j, d.

    Each round every component takes its lightest outgoing edge - equal weights by (i, j), so the choice
    is a total order and has no cycles - and joined components are contracted; parallel edges between two
    components keep the lightest. Rounds grow with the logarithm of the number of nodes. Zero distances are
    kept as edges; loops are ignored.
    """
    now = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").groupBy("i", "j").agg(F.min("d").alias("d"))
    now = checkpoint(now.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("d").cast("double").alias("d")))
    if now.count() <= solo_edges:
        return now.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda pdf: kruskal(pdf), "i bigint, j bigint, d double")
    now = checkpoint(now.select(F.col("i").alias("a"), F.col("j").alias("b"), F.struct("d", "i", "j").alias("e")))
    chosen = None
    for _ in range(max_rounds):
        ends = now.select("a", "e", "b").union(now.select("b", "e", "a"))
        best = checkpoint(ends.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.e").alias("e"), F.col("m.b").alias("b")))
        if best.isEmpty():
            break
        picked = best.select("e").distinct()
        chosen = checkpoint(picked if chosen is None else chosen.union(picked).distinct())
        home = connected_components(best.select("a", "b"))
        to = lambda c: home.select(F.col("id").alias(c), F.col("component").alias(f"to_{c}"))  # noqa: B023,E731
        moved = now.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "e").where("a <> b")
        now = checkpoint(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e").groupBy("a", "b").agg(F.min("e").alias("e")))
    else:
        raise RuntimeError(f"the forest is not finished after {max_rounds} rounds")
    if chosen is None:
        return edges.select("i", "j", "d").limit(0)
    return chosen.select("e.i", "e.j", "e.d")


def nearest_outside(queries: DataFrame, rows: DataFrame, metric: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Lightest edge from each of `queries` to a row of another component (both id, vec, core, comp): comp, e (d, i < j).

    d is the largest of both core distances and the distance (to 9 places); equal weights by (i, j). Queries are
    broadcast in blocks and held against all rows; a batch emits one edge for each component that asks.
    """
    blocks = -(-queries.count() // block)
    out, parts = "comp bigint, d double, i bigint, j bigint", None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec", "core", "comp").toPandas()
        if not len(held):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((held.id.to_numpy(), np.stack(held.vec.to_list()).astype(np.float64), held.core.to_numpy(), held.comp.to_numpy()))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, cores, comps = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own, core, comp = as_matrix(batch.column("vec")), *(batch.column(c).to_numpy() for c in ("id", "core", "comp"))
                step, found = max(1, (1 << 21) // len(own)), []
                for lo in range(0, len(ids), step):
                    at = slice(lo, lo + step)
                    d = np.maximum(np.round(distances(q[at], x, metric), 9), np.maximum(cores[at, None], core[None, :]))
                    d[comps[at, None] == comp[None, :]] = np.inf
                    least = d.min(axis=1)
                    row, col = np.nonzero((d == least[:, None]) & np.isfinite(d))
                    a, b = ids[at][row], own[col]
                    found.append(pd.DataFrame({"comp": comps[at][row], "d": least[row], "i": np.minimum(a, b), "j": np.maximum(a, b)}))
                best = pd.concat(found).sort_values(["d", "i", "j"]).drop_duplicates("comp")
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

        part = rows.select("id", "vec", "core", "comp").mapInArrow(near, out)
        parts = part if parts is None else parts.union(part)
    parts = parts if parts is not None else rows.sparkSession.createDataFrame([], out)
    return parts.select("comp", F.struct("d", "i", "j").alias("e"))


def joining_edges(rows: DataFrame, known: DataFrame, metric: str = "euclidean", block: int = BLOCK_ROWS) -> DataFrame:
    """Exact minimum spanning tree between the components of (id, vec, core, bound, comp): i < j, d.

    Weights are those of `nearest_outside`. `known` (i, j, d) holds the edges to near neighbours; no edge of a
    row that it lacks is lighter than the row's `bound`. In Boruvka rounds every component but the largest takes its
    lightest edge outwards: the lightest known one, unless some of its rows have a bound that is not above it;
    those are searched against all rows. So near neighbours save work, but never decide the tree.
    """
    fixed = checkpoint(rows.select("id", "vec", "core", "bound"))
    home = checkpoint(rows.select("id", "comp"))
    known = known.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    chosen = None
    while len(largest := home.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()) > 1:
        end = lambda k, c: home.select(F.col("id").alias(k), F.col("comp").alias(c))  # noqa: B023,E731
        known = checkpoint(known.join(end("i", "a"), "i").join(end("j", "b"), "j").where("a <> b").select("i", "j", "d", "a", "b"))
        asking = F.col("comp") != largest[0]["comp"]
        e = F.struct("d", "i", "j").alias("e")
        seen = known.select(F.col("a").alias("comp"), e).union(known.select(F.col("b").alias("comp"), e)).where(asking).groupBy("comp").agg(F.min("e").alias("e"))
        now = fixed.join(home, "id")
        unsure = checkpoint(now.where(asking).join(seen, "comp", "left").where(F.col("e").isNull() | (F.col("bound") <= F.col("e.d"))).select("id", "vec", "core", "comp"))
        best = checkpoint(seen.union(nearest_outside(unsure, now, metric, block)).groupBy("comp").agg(F.min("e").alias("e")).select("e.i", "e.j", "e.d"))
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.union(best)
        groups = connected_components(best.join(end("i", "a"), "i").join(end("j", "b"), "j").select("a", "b"))
        home = checkpoint(home.join(groups.select(F.col("id").alias("comp"), "component"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))
        known = known.select("i", "j", "d")
    none = rows.sparkSession.createDataFrame([], "i bigint, j bigint, d double")
    return none if chosen is None else minimum_spanning_forest(chosen)


def with_bound(rows: DataFrame, knn: DataFrame) -> DataFrame:
    """Add to (id, ...) the distance of the last neighbour listed in `knn`, infinite where it lists all other rows."""
    n = rows.count()
    last = knn.groupBy(F.col("i").alias("id")).agg(F.max("dist").alias("last"), F.count("*").alias("listed"))
    bound = F.when(F.coalesce("listed", F.lit(0)) >= n - 1, F.lit(float("inf"))).otherwise(F.coalesce("last", F.lit(0.0)))
    return rows.join(last, "id", "left").withColumn("bound", bound).drop("last", "listed")


def spanning_tree(vectors: DataFrame, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """Exact minimum spanning tree of the complete graph of (id, vec): i < j, d. The k nearest neighbours spare most of the
    search and never decide (`joining_edges`)."""
    near = checkpoint(exact_neighbours(vectors, vectors, k, metric))
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(0.0).alias("core"), F.col("id").cast("bigint").alias("comp"))
    return joining_edges(with_bound(rows, near), near.select("i", "j", F.col("dist").alias("d")), metric)


def add_tree_edges(graph: DataFrame, tree: DataFrame, sigma: float) -> DataFrame:
    """Raise the affinities of the tree's edges to exp(-d / sigma), both directions; other edges stay."""
    extra = both_ways(tree.select("i", "j", F.exp(-F.col("d") / sigma).alias("w")))
    return graph.select("i", "j", "w").unionByName(extra).groupBy("i", "j").agg(F.max("w").alias("w"))


def connect(graph: DataFrame, candidates: DataFrame, weight_scale: float = 0.1, vectors: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """Add the lightest edges that join the components of a graph, with weight exp(-d^2 / scale).

    Components are contracted first and the spanning tree of what lies between them is added. With `vectors` (id, vec)
    it is exact, and `candidates` (i, j, d) are the nearest neighbours of each row; without them only the candidates
    count, and what they don't reach stays apart.
    """
    home = connected_components(graph.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b")))
    if vectors is not None:
        rows = vectors.select("id", "vec").join(home, "id", "left").select("id", "vec", F.lit(0.0).alias("core"), F.coalesce("component", "id").alias("comp"))
        tree = joining_edges(with_bound(rows, candidates.withColumnRenamed("d", "dist")), candidates, metric)
        return graph.select("i", "j", "w").unionByName(both_ways(tree.select("i", "j", F.exp(-F.col("d") * F.col("d") / weight_scale).alias("w"))))
    a, b = home.select(F.col("id").alias("i"), F.col("component").alias("ci")), home.select(F.col("id").alias("j"), F.col("component").alias("cj"))
    between = candidates.join(a, "i", "left").join(b, "j", "left").select("i", "j", "d", F.coalesce("ci", "i").alias("ci"), F.coalesce("cj", "j").alias("cj")).where("ci <> cj")
    lightest = between.groupBy(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.min(F.struct("d", "i", "j")).alias("e"))
    tree = minimum_spanning_forest(lightest.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("e.d").alias("d")))
    real = tree.join(lightest, (tree.i == lightest.a) & (tree.j == lightest.b)).select(F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.exp(-F.col("e.d") * F.col("e.d") / weight_scale).alias("w"))
    return graph.select("i", "j", "w").unionByName(both_ways(real))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, undirected edges without loops, density and components in one row."""
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    nodes = edges.select("i").union(edges.select("j")).distinct().count()
    parts = connected_components(e.select(F.col("i").alias("a"), F.col("j").alias("b")))
    n_parts = parts.select("component").distinct().count() + nodes - parts.count()
    density = F.round(F.when(F.lit(nodes) > 1, 2.0 * F.col("n_edges") / (nodes * (nodes - 1))).otherwise(0.0), 9)
    return e.agg(F.count("*").alias("n_edges")).select(F.lit(nodes).cast("bigint").alias("n_nodes"), "n_edges", density.alias("density"), F.lit(n_parts).cast("bigint").alias("n_components"))
