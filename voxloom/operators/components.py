"""Connected components of an edge list (G6) by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint

#: Graphs of up to so many edges are solved by one task; larger ones in distributed rounds, with the same result.
SOLO_EDGES = 500_000


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: nodes and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, low = united(pdf.a.to_numpy(), pdf.b.to_numpy())
    return pd.DataFrame({"id": nodes, "component": low})


def connected_components(edges: DataFrame, max_rounds: int = 50, solo_edges: int = SOLO_EDGES) -> DataFrame:
    """Component (smallest member) of every node of the edges (a, b): id, component.

    Large-star, small-star: each round links the larger neighbours of a node to its smallest one, then
    the smaller ones; the number of rounds grows with the logarithm of the graph's size. Aggregation
    finds the smallest neighbour, so no node's neighbours are ever gathered. Null ends are ignored,
    repeated edges and loops do no harm, an empty table gives no rows.
    """
    edges = checkpoint(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    if edges.count() <= solo_edges:
        whole = edges.dropna().withColumn("part", F.lit(0))
        found = whole.groupBy("part").applyInPandas(lambda pdf: _solve(pdf), "id bigint, component bigint")
        half = edges.where("(a is null) <> (b is null)").select(F.coalesce("a", "b").alias("id")).distinct()
        return found.unionByName(half.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    nodes = checkpoint(edges.select(F.col("a").alias("id")).union(edges.select("b")).where("id is not null").distinct())
    now = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        small = large.select(F.col("b").alias("n"), F.col("a").alias("s"))
        low = small.groupBy("n").agg(F.min("s").alias("m"))
        linked = small.join(low, "n")
        now = checkpoint(linked.select(F.col("m").alias("a"), F.col("s").alias("b")).where("a <> b").union(low.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct())
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    return nodes.join(now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
