"""Iterative label propagation on a row-stochastic edge list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint, forget


#: More classes than this are summed by (node, class) instead of one column each.
WIDE = 200

#: Graphs of up to so many (edges + nodes) * classes are propagated by one task.
SOLO_CELLS = 10_000_000


def class_list(labels: DataFrame, label: str = "label") -> list[str]:
    """The classes in order; their number is that of speakers, which bounds the class arrays."""
    return [r[0] for r in labels.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]


def one_hot(label: Column, classes: list[str]) -> Column:
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in classes])


def initial_scores(nodes: DataFrame, classes: list[str], prior: str | None = None, conf: str | None = None, least: float = 0.7, uniform: bool = False) -> DataFrame:
    """L1, L3: class scores of each node (i, label, ...): adds `y`.

    Labelled nodes are one-hot. Others with a `prior` class and confidence of at least `least` give it 0.5 *
    confidence and share the rest evenly; the rest are all 0, or even with `uniform`.
    """
    k = max(1, len(classes))
    base = F.array_repeat(F.lit(1.0 / k if uniform else 0.0), len(classes))
    y = base
    if prior:
        share = 0.5 * F.col(conf)
        rest = (1 - share) / max(1, k - 1)
        weak = F.array(*[F.when(F.col(prior) == c, share).otherwise(rest) for c in classes])
        y = F.when(F.col(prior).isin(*classes) & (F.col(conf) >= least), weak).otherwise(base)
    return nodes.withColumn("y", F.when(F.col("label").isNotNull(), one_hot(F.col("label"), classes)).otherwise(y))


def normalized(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.when(total == 0, scores).otherwise(F.transform(scores, lambda x: x / total))


def spread(edges: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """One product of the edge matrix with the scores: i, s. Sums are by place, so a hub's neighbours are never gathered."""
    flat = edges.join(scores.select(F.col("i").alias("j"), F.col("f")), "j")
    if n > WIDE:  # one sum a class would be too many columns
        cells = flat.select("i", "w", F.posexplode("f").alias("c", "x")).where("x <> 0").groupBy("i", "c").agg(F.sum(F.col("w") * F.col("x")).alias("v"))
        held = F.map_from_entries(F.collect_list(F.struct("c", "v")))
        return cells.groupBy("i").agg(held.alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("s"))
    sums = [F.sum(F.col("w") * F.col("f")[c]).alias(f"s{c}") for c in range(n)]
    return flat.groupBy("i").agg(*sums).select("i", F.array(*[F.col(f"s{c}") for c in range(n)]).alias("s"))


def anchored_nodes(nodes: DataFrame, classes: list[str], alpha: float, manual: float, weak: float, weak_least: float, clamp: bool) -> DataFrame:
    """i, y and what a step makes of the sum s over the neighbours of a node: keep * s + anchor, before rows are normalised.

    It is the same in every step. Nodes without an id have no edges and are left out.
    """
    keep, none = F.lit(1.0), F.array_repeat(F.lit(0.0), len(classes))
    if clamp:
        anchor = F.transform("y", lambda x: (1 - alpha) * x)
    else:
        known = F.col("label").isNotNull()
        keep, anchor = F.when(known, 1.0 - manual), F.when(known, F.transform(one_hot(F.col("label"), classes), lambda x: manual * x))
        if weak:
            sure, strength = F.col("prior").isin(*classes) & (F.col("conf") >= weak_least), weak * F.col("conf")
            keep, anchor = keep.when(sure, 1 - strength), anchor.when(sure, F.transform(one_hot(F.col("prior"), classes), lambda x: strength * x))
        keep, anchor = keep.otherwise(1.0), anchor.otherwise(none)
    return nodes.where("i is not null").select("i", "y", keep.cast("double").alias("keep"), anchor.alias("anchor"))


def propagate_solo(edges: pd.DataFrame, nodes: pd.DataFrame, alpha: float, max_iter: int, tol: float) -> pd.DataFrame:
    """All steps over a small graph: the rows of `i`, `f` and a row of `step`, `delta`, `confidence`, `entropy` for each step."""
    at = pd.Index(nodes.i)
    to, of = at.get_indexer(edges.i), at.get_indexer(edges.j)
    given = (to >= 0) & (of >= 0)
    order = np.lexsort((of[given], to[given]))
    to, of, w = to[given][order], of[given][order], edges.w.to_numpy(float)[given][order]
    f, anchor, keep = np.stack(nodes.y.to_list(), 1).astype(float), np.stack(nodes.anchor.to_list(), 1).astype(float), nodes.keep.to_numpy(float)
    steps = []
    for step in range(max_iter):
        new = np.stack([np.bincount(to, w * x[of], len(at)) for x in f])
        new = new * alpha * keep + anchor
        total = new.sum(0)
        new /= np.where(total == 0, 1.0, total)
        steps.append((step + 1, np.abs(new - f).sum(), new.max(0).mean(), -(new * np.log(new + 1e-10)).sum(0).mean()))
        f = new
        if steps[-1][1] < tol:
            break
    n, m = [None] * len(at), [None] * len(steps)
    history = {c: pd.Series(n + [x[p] for x in steps], dtype=object) for p, c in enumerate(("step", "delta", "confidence", "entropy"))}
    return pd.DataFrame({"i": pd.Series(nodes.i.tolist() + m, dtype=object), "f": list(f.T) + m, **history})  # objects: a null would turn ids into floats


def propagate(
    edges: DataFrame, nodes: DataFrame, classes: list[str], *, alpha: float = 0.95, manual: float = 0.2, weak: float = 0.0, weak_least: float = 0.7, clamp: bool = False,
    max_iter: int = 100, tol: float = 1e-6, solo_cells: int = SOLO_CELLS,
) -> tuple[DataFrame, list[dict]]:
    """Propagate class scores until they settle; returns (i, f) and the history of delta, confidence, entropy.

    `edges` (i, j, w) with rows that sum to 1; `nodes` i, y, label and for weak anchors prior, conf. A step
    takes alpha * W f, mixes in the label of labelled nodes with strength `manual` and the prior of
    confident ones with `weak` * conf, and normalises rows. With `clamp` it is alpha * W f + (1 - alpha) * y
    without anchors. Up to `solo_cells` products of edges and classes, one task makes all steps; beyond that every step is a
    distributed one, checkpointed, with the same result. A node given twice is refused; the history of an empty table is empty.
    """
    k = len(classes)
    base = checkpoint(anchored_nodes(nodes, classes, alpha, manual, weak, weak_least, clamp))
    edges = checkpoint(edges.select("i", "j", "w").where("i is not null and j is not null and w is not null"))
    n, own = base.agg(F.count("i"), F.count_distinct("i")).first()
    if own < n:
        raise ValueError(f"{n - own} nodes are given twice")
    if not n:
        return base.select("i", F.col("y").alias("f")), []
    if (edges.count() + n) * k <= solo_cells:
        kind = base.schema["i"].dataType.simpleString()
        whole, both = edges.withColumn("part", F.lit(0)).groupBy("part"), base.withColumn("part", F.lit(0)).groupBy("part")
        got = checkpoint(whole.cogroup(both).applyInPandas(lambda e, v: propagate_solo(e, v, alpha, max_iter, tol), f"i {kind}, f array<double>, step int, delta double, confidence double, entropy double"))
        seen = got.where("step is not null").select(F.col("step").alias("iteration"), "delta", "confidence", "entropy").orderBy("step").collect()
        return got.where("step is null").select("i", "f"), [r.asDict() for r in seen]
    edges = edges.repartition("j").persist()  # every step joins them by j: laid out once
    state, history = base.withColumn("f", F.col("y")), []
    for step in range(max_iter):
        s = F.coalesce(F.transform("s", lambda x: x * alpha), F.array_repeat(F.lit(0.0), k))
        new = normalized(F.zip_with(s, "anchor", lambda a, b: F.col("keep") * a + b))
        moved = state.join(spread(edges, state, k), "i", "left").select("i", "keep", "anchor", F.col("f").alias("old"), new.alias("f"))
        gap = F.aggregate(F.zip_with("f", "old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
        ent = -F.aggregate(F.transform("f", lambda x: x * F.ln(x + 1e-10)), F.lit(0.0), lambda a, x: a + x)
        moved = checkpoint(moved.select("i", "keep", "anchor", "f", gap.alias("gap"), F.array_max("f").alias("top"), ent.alias("ent")))
        seen = moved.agg(F.sum("gap").alias("delta"), F.avg("top").alias("confidence"), F.avg("ent").alias("entropy")).first()
        history.append({"iteration": step + 1, **seen.asDict()})
        if step:
            forget(state)
        state = moved
        if (seen["delta"] or 0.0) < tol:
            break
    edges.unpersist()  # the last step is checkpointed
    return state.select("i", "f"), history


def propagate_anchored(edges: DataFrame, nodes: DataFrame, n_classes: int, *, alpha: float = 0.5, anchor: float = 0.9, max_iter: int = 100, tol: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """f = alpha W f + (1 - alpha) y, then anchor * y + (1 - anchor) * f on labelled nodes, until the largest change of a
    score is below `tol`; returns (i, f) and the changes. `nodes`: i, label, y. Every step is checkpointed."""
    state, changes = checkpoint(nodes.select("i", "label", "y", F.col("y").alias("f"))), []
    for _ in range(max_iter):
        s = F.coalesce("s", F.array_repeat(F.lit(0.0), n_classes))
        mixed = F.zip_with(s, F.col("y"), lambda a, b: alpha * a + (1 - alpha) * b)
        new = F.when(F.col("label").isNotNull(), F.zip_with(mixed, F.col("y"), lambda a, b: (1 - anchor) * a + anchor * b)).otherwise(mixed)
        moved = checkpoint(state.join(spread(edges, state, n_classes), "i", "left").select("i", "label", "y", F.col("f").alias("old"), new.alias("f")))
        changes.append(moved.agg(F.max(F.array_max(F.zip_with("f", "old", lambda a, b: F.abs(a - b))))).first()[0] or 0.0)
        state = moved.drop("old")
        if changes[-1] < tol:
            break
    return state.select("i", "f"), changes


def decide(scores: DataFrame, classes: list[str]) -> DataFrame:
    """Class of the largest score (ties: first class) and its score; `unlabeled` where all are 0."""
    names = F.array(*[F.lit(c) for c in classes])
    top = F.array_max("f")
    return scores.select("i", F.when(top > 0, names[F.array_position("f", top).cast("int") - 1]).otherwise(F.lit("unlabeled")).alias("lp_label"), F.round(top, 6).alias("lp_confidence"))


def margin_confidence(scores: DataFrame, k: int) -> DataFrame:
    """0.6 * (best - second) + 0.4 * (1 - entropy / ln k)."""
    s = F.sort_array("f", asc=False)
    ent = -F.aggregate(F.transform("f", lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    second = F.when(F.size("f") > 1, s[1]).otherwise(0.0)
    return scores.select("i", F.round(0.6 * (s[0] - second) + 0.4 * (1 - ent / F.ln(F.lit(float(max(2, k))))), 6).alias("confidence"))


def self_training(nodes: DataFrame, decided: DataFrame, least: float = 0.9) -> DataFrame:
    """Labels for unlabelled nodes decided with more than `least`; labelled ones keep theirs (i, label, added)."""
    both = nodes.select("i", "label").join(decided.select("i", "lp_label", "lp_confidence"), "i", "left")
    add = F.col("label").isNull() & (F.col("lp_confidence") > least) & (F.col("lp_label") != "unlabeled")
    return both.select("i", F.when(add, F.col("lp_label")).otherwise(F.col("label")).alias("label"), F.coalesce(add, F.lit(False)).alias("added"))


def cluster_speakers(labelled: DataFrame, cluster: str, speaker: str, order: str) -> DataFrame:
    """Speaker of each cluster = that of its last labelled row, with a conflict mark where speakers differ."""
    rows = labelled.where(F.col(speaker).isNotNull() & F.col(cluster).isNotNull())
    return rows.groupBy(cluster).agg(F.max_by(speaker, order).alias("speaker"), (F.count_distinct(speaker) > 1).alias("conflict"))
