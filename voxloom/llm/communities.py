"""Grouping records into similarity clusters (problem 5): neighbour descent, then modularity communities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery
from voxloom.llm.neighbours import SALTS, by_length, clean_vectors, curve_neighbours, matrix, unit_rows
from voxloom.operators.components import connected_components

#: Neighbours kept for each row; curves that seed them and rows seen on either side along each.
NEIGHBOURS, SEED_CURVES, SEED_HALF = 5, 3, 1024
#: Descent ends with a round that changes at most this share of the neighbours.
SETTLED = 0.1
#: Sweeps over a block of the graph end with one that moves at most one node in so many.
CALM = 100
#: Nodes of a block of the graph, about.
BLOCK_NODES = 20_000
#: Rows of one side of an exact comparison, and communities whose means are broadcast at a time.
BLOCK_ROWS, BLOCK_MEANS = 8192, 4096
#: Nearest means looked up for each community.
MEAN_NEIGHBOURS = 8
#: Added to angles where a bound decides, so that rounding never does.
MARGIN = 1e-3


def descend(vectors: DataFrame, near: DataFrame, k: int, least: float) -> DataFrame:
    """One round of neighbour descent: neighbours of a row are compared with each other.

    Around each row meet its k neighbours and the k rows most similar to it that have it as theirs (as usual in
    neighbour descent; others can still meet around other rows). Vectors travel as half-precision bytes; only
    pairs better than the present k-th partner are emitted. Column `fresh` is 1 for partners that the round found.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                half = unit_rows(matrix(batch.column("vec"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in half], pa.binary())], names=["id", "half"])

    kth = near.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(float(least))).alias("kth"))
    small = vectors.mapInArrow(packed, "id bigint, half binary").join(kth, F.col("id") == F.col("a"), "left").select("id", "half", F.coalesce("kth", F.lit(float(least))).alias("kth"))
    back = near.select(F.col("b").alias("c"), F.col("a").alias("m"), "sim")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("sim"), "m"))).where(F.col("r") <= k).select("c", "m")
    meet = near.select(F.col("a").alias("c"), F.col("b").alias("m")).union(back).distinct()
    groups = meet.join(small, F.col("m") == F.col("id")).groupBy("c").agg(F.collect_list(F.struct("id", "kth", "half")).alias("x")).where(F.size("x") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            for at in range(0, len(lists), 4096):
                part = lists.slice(at, 4096)
                if not len(part):
                    continue
                size = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                ids, kth_ = flat.field("id").to_numpy(), flat.field("kth").to_numpy()
                vec = np.frombuffer(b"".join(flat.field("half").to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
                group = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                cube = np.zeros((len(size), size.max(), vec.shape[1]), np.float32)
                cube[group, place] = vec
                which = np.full(cube.shape[:2], -1, np.int64)
                which[group, place] = ids
                bound = np.full(cube.shape[:2], 9.0, np.float32)
                bound[group, place] = kth_
                sims = cube @ cube.transpose(0, 2, 1)
                g, i, j = np.nonzero((sims > bound[:, :, None]) & (sims >= least) & (which[:, :, None] != which[:, None, :]) & (which[:, None, :] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(which[g, i]), pa.array(which[g, j]), pa.array(sims[g, i, j])], names=["a", "b", "sim"])

    better = groups.select("x").mapInArrow(compare, "a bigint, b bigint, sim float")
    both = near.select("a", "b", "sim", F.lit(0).alias("fresh")).unionByName(better.withColumn("fresh", F.lit(1)))
    once = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= k)


def neighbour_graph(vectors: DataFrame, k: int, least: float, settled: float = SETTLED, seed: int = 42) -> DataFrame:
    """Undirected edges (a < b, w) between rows at least `least` similar: descent from a seed graph.

    The seed graph takes the neighbours along few space-filling curves instead of random ones, which
    saves most rounds of the descent. Rounds go on until one changes at most the share `settled` of the neighbours;
    similarities only rise, so there is such a round.
    """
    near = checkpoint(curve_neighbours(vectors, k, least, SEED_CURVES, half=SEED_HALF, seed=seed))
    while True:
        near = checkpoint(descend(vectors, near, k, least))
        changed = near.agg(F.avg("fresh")).first()[0]
        if changed is None or changed <= settled:
            break
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").cast("double").alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, volume: dict[int, float], total: float) -> dict[int, int]:
    """Communities of one block of a graph by moves of best modularity gain; node -> smallest member.

    `volume` holds a node's weighted degree in the whole graph, `total` the sum of all degrees. A sweep over all nodes is
    repeated as long as it moves more than one node in `CALM`; then communities are contracted and moved again, until
    nothing improves.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two, w = at[: len(a)], at[len(a) :], np.asarray(w, np.float64)
    vol = np.array([volume[x] for x in nodes.tolist()])
    member = np.arange(len(nodes))  # the community of each node, among those of the present level
    while True:
        n = len(vol)
        apart = one != two
        src, dst, wt = np.concatenate([one[apart], two[apart]]), np.concatenate([two[apart], one[apart]]), np.concatenate([w[apart], w[apart]])
        order = np.argsort(src, kind="stable")
        cut = np.searchsorted(src[order], np.arange(n + 1)).tolist()
        near, weight = dst[order].tolist(), wt[order].tolist()
        home, mass, own, moved = list(range(n)), vol.tolist(), vol.tolist(), False
        while True:
            changed = 0
            for x in range(n):
                lo, hi = cut[x], cut[x + 1]
                if lo == hi:
                    continue
                links: dict[int, float] = {}
                for y, v in zip(near[lo:hi], weight[lo:hi], strict=True):
                    c = home[y]
                    links[c] = links.get(c, 0.0) + v
                old, part = home[x], own[x] / total
                mass[old] -= own[x]
                best, gain = old, links.get(old, 0.0) - part * mass[old] + 1e-12
                for c, v in links.items():
                    g = v - part * mass[c]
                    if g > gain or g == gain and best != old and c < best:
                        best, gain = c, g
                mass[best] += own[x]
                if best != old:
                    home[x] = best
                    changed += 1
            moved |= changed > 0
            if changed * CALM <= n:
                break
        if not moved:
            break
        kept, to = np.unique(np.array(home), return_inverse=True)
        member = to[member]
        vol = np.bincount(to, vol, len(kept))
        pairs, where = np.unique(to[one] * np.int64(len(kept)) + to[two], return_inverse=True)
        one, two, w = pairs // len(kept), pairs % len(kept), np.bincount(where, w, len(pairs))
    least = np.full(member.max() + 1 if len(member) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, member, nodes)
    return dict(zip(nodes.tolist(), least[member].tolist(), strict=True))


def block_solver(total: float):
    """A grouped-map function: the moves of one block's edges (a, b, w, va, vb)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        vols = dict(zip(pdf.a.tolist(), pdf.va.tolist(), strict=True)) | dict(zip(pdf.b.tolist(), pdf.vb.tolist(), strict=True))
        got = louvain(pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.w.to_numpy(), vols, total)
        return pd.DataFrame({"id": list(got), "to": list(got.values())}, dtype="int64")

    return solve


def modularity_communities(edges: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Communities of a weighted graph (a, b, w): id, community (its smallest member).

    Every round puts nodes into blocks of about `block_nodes` - a node goes with its strongest neighbour, so mutual
    strongest neighbours always meet - moves nodes inside each block by their gain in the modularity of the whole
    graph, and contracts the communities. A round without a move is the last; every other one makes the graph smaller.
    """
    edges = checkpoint(edges.where("a <> b and w > 0"))
    volume = checkpoint(edges.select(F.col("a").alias("id"), "w").union(edges.select("b", "w")).groupBy("id").agg(F.sum("w").alias("vol")))
    total, left = volume.agg(F.sum("vol"), F.count("*")).first()
    labels = volume.select("id", F.col("id").alias("community"))
    while left:
        both = edges.select("a", "b", "w").union(edges.select("b", "a", "w"))
        top = both.groupBy("a").agg(F.max(F.struct("w", (-F.col("b")).alias("nb"))).alias("t"))
        first = top.select(F.col("a").alias("id"), F.least("a", -F.col("t.nb")).alias("up"))
        hop = first.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        anchor = first.join(hop, "up", "left").select("id", F.least("up", F.coalesce("upper", "up")).alias("anchor"))
        blocks = checkpoint(volume.join(anchor, "id").select("id", "vol", F.pmod(F.xxhash64("anchor"), F.lit(-(-left // block_nodes))).cast("int").alias("block")))
        ends = blocks.select(F.col("id").alias("a"), F.col("vol").alias("va"), F.col("block")), blocks.select(F.col("id").alias("b"), F.col("vol").alias("vb"), F.col("block").alias("other"))
        inside = edges.join(ends[0], "a").join(ends[1], "b").where("block = other").drop("other")
        moves = checkpoint(inside.groupBy("block").applyInPandas(block_solver(total), "id bigint, to bigint").where("id <> to"))
        moved = moves.count()
        if not moved:
            break
        step = moves.select(F.col("id").alias("community"), "to")
        labels = checkpoint(labels.join(step, "community", "left").select("id", F.coalesce("to", "community").alias("community")))
        for end in ("a", "b"):
            edges = edges.join(moves.select(F.col("id").alias(end), F.col("to").alias(f"to_{end}")), end, "left").withColumn(end, F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
        volume = volume.join(moves, "id", "left").groupBy(F.coalesce("to", "id").alias("id")).agg(F.sum("vol").alias("vol"))
        edges, volume = checkpoint(edges), checkpoint(volume)
        left = edges.select("a").union(edges.select("b")).distinct().count()
    return labels


def community_means(rows: DataFrame) -> DataFrame:
    """Size and mean of the unit vectors of each community of (id, vec, community): community, n, mean, long (length of the mean).

    Summed per batch before the shuffle, so a community of a third of all rows is a row for each batch.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, at = np.unique(batch.column("community").to_numpy(), return_inverse=True)
                unit = unit_rows(matrix(batch.column("vec"))).astype(np.float64)
                order = np.argsort(at, kind="stable")
                sums = np.add.reduceat(unit[order], np.searchsorted(at[order], np.arange(len(keys))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at)), pa.array(list(sums), pa.list_(pa.float64()))], names=["community", "n", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for c, n, s in zip(batch.column("community").to_pylist(), batch.column("n").to_pylist(), matrix64(batch.column("total")), strict=True):
                if c in sums:
                    sums[c][0] += n
                    sums[c][1] += s
                else:
                    sums[c] = [n, s.copy()]
        means = [s / n for n, s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array(means, pa.list_(pa.float32())), pa.array([float(np.linalg.norm(m)) for m in means], pa.float64())], names=["community", "n", "mean", "long"])

    parts = rows.select("community", "vec").mapInArrow(partial, "community bigint, n bigint, total array<double>")
    return parts.repartition("community").mapInArrow(added, "community bigint, n bigint, mean array<float>, long double")


def matrix64(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def relabelled(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, vec, community) after the communities of `pairs` (a, b) have been joined, each named by its smallest one."""
    to = connected_components(pairs.select("a", "b")).select(F.col("id").alias("community"), F.col("component").alias("to")).where("community <> to")
    return rows.join(F.broadcast(to) if to.count() <= BLOCK_MEANS else to, "community", "left").select("id", "vec", F.coalesce("to", "community").alias("community"))


def join_communities(rows: DataFrame, least: float, seed: int = 42) -> DataFrame:
    """(id, vec, community) with those communities joined whose members are on average at least `least` similar across.

    The dot product of two means is the average similarity across, so such communities hold a pair of rows that
    similar. Modularity cuts a large cluster whose graph is sparse into several; means that belong together are found
    like any similar vectors, along space-filling curves.
    """
    means = checkpoint(community_means(rows).where("long > 0"))
    near = curve_neighbours(means.select(F.col("community").alias("id"), F.col("mean").alias("vec")), MEAN_NEIGHBOURS, least, seed=seed)
    long_a, long_b = means.select(F.col("community").alias("a"), F.col("long").alias("la")), means.select(F.col("community").alias("b"), F.col("long").alias("lb"))
    return relabelled(rows, near.join(long_a, "a").join(long_b, "b").where(F.col("sim") * F.col("la") * F.col("lb") >= least))


def suspects(rows: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """The rows that an exact comparison with a community of `groups` (community, mean) has to look at: target, id, vec, community.

    By the angles to the mean of a community, no row can be `least` similar to one of its members unless its own angle
    is at most the widest of the members plus the angle of `least`; and two members can only be less similar than that if
    their angles add up to more than it. Means are broadcast in blocks of `BLOCK_MEANS`.
    """
    limit, spark = math.acos(least), rows.sparkSession
    n_blocks = -(-groups.count() // BLOCK_MEANS)
    found = [spark.createDataFrame([], "target bigint, id bigint, vec array<float>, community bigint")]
    for p in range(n_blocks):
        block = groups.where(F.pmod(F.xxhash64("community"), F.lit(n_blocks)) == p).select("community", "mean").toPandas().sort_values("community")
        if not len(block):
            continue
        mean = spark.sparkContext.broadcast((block.community.to_numpy(), unit_rows(np.stack(block["mean"].to_list()))))

        def angle_to(own: np.ndarray, unit: np.ndarray, mean=mean) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Members of the block's communities: which rows they are, their community's place, their angle to its mean."""
            ids, m = mean.value
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            mine = np.flatnonzero(ids[at] == own)
            return mine, at[mine], np.arccos(np.clip((unit[mine] * m[at[mine]]).sum(axis=1), -1.0, 1.0)) + MARGIN

        def widest(batches: Iterator[pa.RecordBatch], angle_to=angle_to) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, at, angle = angle_to(batch.column("community").to_numpy(), unit_rows(matrix(batch.column("vec"))))
                    places = np.unique(at)
                    far = np.zeros(places.max() + 1 if len(places) else 0)
                    np.maximum.at(far, at, angle)
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(far[places], pa.float64())], names=["place", "far"])

        wide = np.zeros(len(block))
        for r in rows.select("community", "vec").mapInArrow(widest, "place bigint, far double").groupBy("place").agg(F.max("far").alias("far")).collect():
            wide[r["place"]] = r["far"]
        reach = spark.sparkContext.broadcast(wide)

        def look(batches: Iterator[pa.RecordBatch], mean=mean, angle_to=angle_to, reach=reach) -> Iterator[pa.RecordBatch]:
            far = reach.value
            ids, m = mean.value
            bound = np.cos(np.minimum(np.pi, limit + far + MARGIN)).astype(np.float32)
            for batch in batches:
                own, unit = batch.column("community").to_numpy(), unit_rows(matrix(batch.column("vec"))) if batch.num_rows else None
                if unit is None:
                    continue
                mine, at, angle = angle_to(own, unit)
                outer = angle > limit - far[at]
                row, place = [mine[outer]], [at[outer]]
                for lo in range(0, len(unit), 1024):
                    i, j = np.nonzero(unit[lo : lo + 1024] @ m.T >= bound)
                    i += lo
                    other = own[i] != ids[j]
                    row.append(i[other])
                    place.append(j[other])
                rows_, places = np.concatenate(row), np.concatenate(place)
                if len(rows_):
                    hit = batch.select(["id", "vec", "community"]).take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[places]), *hit.columns], names=["target", "id", "vec", "community"])

        found.append(rows.select("id", "vec", "community").mapInArrow(look, "target bigint, id bigint, vec array<float>, community bigint"))
    return reduce(DataFrame.unionByName, found)


def compared(left: DataFrame, right: DataFrame, out: str, judge) -> DataFrame:
    """Exact comparison of rows of `left` with those of `right` of the same `target` (both target, vec, community).

    Both sides are cut into blocks of about `BLOCK_ROWS`; each pair of blocks is one group, handed as (target, unit rows
    and communities of the left block, those of the right block) to `judge`, which gives the values of one output row
    or None.
    """
    sizes = left.groupBy("target").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nl")).join(right.groupBy("target").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nr")), "target")

    def spread(df: DataFrame, mine: str, other: str, side: int) -> DataFrame:
        cut = df.join(sizes, "target").withColumn("p", F.pmod(F.xxhash64("vec", "community"), F.col(mine)).cast("int"))
        cut = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("p", "q") if side == 0 else ("q", "p")
        return cut.select("target", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "community", "vec")

    ready = spread(left, "nl", "nr", 0).unionByName(spread(right, "nr", "nl", 1)).repartition("target", "i", "j").sortWithinPartitions("target", "i", "j", "side")
    names = [c.split()[0] for c in out.split(", ")]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settled() -> tuple | None:
            side = np.concatenate([h[0] for h in held])
            own, unit = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            return judge(key[0], unit[side == 0], own[side == 0], unit[side == 1], own[side == 1])

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("target", "i", "j")], axis=1)
            side, own, unit = batch.column("side").to_numpy(), batch.column("community").to_numpy(), exact_rows(batch.column("vec"))
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(cols)), strict=True):
                now = tuple(cols[lo].tolist())
                if now != key and key is not None:
                    if got := settled():
                        yield told(got)
                    held = []
                key = now
                held.append((side[lo:hi], own[lo:hi], unit[lo:hi]))
        if key is not None and (got := settled()):
            yield told(got)

    return ready.mapInArrow(many, out)


def exact_rows(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision, as the exact comparison needs them."""
    m = matrix(column).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def loose_targets(inner: DataFrame, least: float) -> DataFrame:
    """Communities two of whose own suspects are less than `least` similar: target."""

    def judge(target: int, x: np.ndarray, _own: np.ndarray, y: np.ndarray, _other: np.ndarray) -> list | None:
        return [(target,)] if len(y) and any((x[at : at + 1024] @ y.T).min() < least for at in range(0, len(x), 1024)) else None

    return compared(inner, inner, "target bigint", judge).distinct()


def outer_links(outer: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Communities a (of a row outside) and b (that it is a suspect of) with a pair at least `least` similar: a, b."""
    members = rows.join(outer.select(F.col("target").alias("community")).distinct(), "community", "left_semi").select(F.col("community").alias("target"), "vec", "community")

    def judge(target: int, x: np.ndarray, own: np.ndarray, y: np.ndarray, _other: np.ndarray) -> list | None:
        hit = {c for at in range(0, len(x), 1024) if len(y) for c in own[at : at + 1024][(x[at : at + 1024] @ y.T >= least).any(axis=1)].tolist()}
        return [(c, target) for c in sorted(hit)] or None

    return compared(outer, members, "a bigint, b bigint", judge).distinct()


def grouped(vectors: DataFrame, least: float, k: int, settled: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Communities of different vectors, and the graph: (id, vec, community), edges (a, b, w)."""
    edges = checkpoint(neighbour_graph(vectors, k, least, settled, seed))
    labels = modularity_communities(edges)
    rows = checkpoint(vectors.join(labels, "id", "left").withColumn("community", F.coalesce("community", "id")))
    return checkpoint(join_communities(rows, least, seed)), edges


def one_of_each(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the smallest id of every different vector, and (id, rep) of all rows. Copies are joined by salted parts."""
    keyed = vectors.withColumn("copy", F.xxhash64("vec")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    heads = keyed.groupBy("copy").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("rep"), F.count("*").alias("n"))
    heads = checkpoint(heads)
    twins = heads.where("n > 1").select("copy", "rep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return heads.select(F.col("rep").alias("id"), "vec"), keyed.select("id", "copy", "salt").join(twins, ["copy", "salt"], "left").select("id", F.coalesce("rep", "id").alias("rep"))


def similarity_communities(df: DataFrame, id_col: str, vec_col: str, least: float = 0.72, k: int = NEIGHBOURS, settled: float = SETTLED, seed: int = 42) -> DataFrame:
    """Group rows into communities of mutually similar vectors: id, community, degree.

    `degree` is the weighted degree inside the community in the neighbour graph, where exact copies are one node; the
    members with the highest are the most typical. Vectors without a neighbour at least `least` similar form communities
    of their own with degree 0. Null, zero and NaN vectors take no part; vectors of different lengths are never
    together; repeated deliveries count once; an empty table gives no rows; equal degrees rank by id; other columns are
    dropped.
    """
    heads, members = one_of_each(checkpoint(clean_vectors(df, id_col, vec_col)))
    found = []
    for part in by_length(heads):
        rows, edges = grouped(part, least, k, settled, seed)
        rows = rows.select("id", "community")
        ends = edges.select("a", "b", "w").union(edges.select("b", "a", "w"))
        degree = ends.join(rows.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(rows.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
        degree = degree.where("ca = cb").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))
        found.append(rows.join(degree, "id", "left").select(F.col("id").alias("rep"), "community", F.round(F.coalesce("degree", F.lit(0.0)), 6).alias("degree")))
    return members.join(reduce(DataFrame.unionByName, found), "rep").select("id", "community", "degree")


def tight_clusters(df: DataFrame, id_col: str, vec_col: str, least: float = 0.72, min_size: int = 5, k: int = NEIGHBOURS, settled: float = SETTLED, seed: int = 42) -> DataFrame:
    """The communities that pass the exact check: at least `min_size` rows, every pair of them at least
    `least` similar, no row outside that similar. Columns id, community (its smallest id).

    Wherever the check finds a row outside that is as similar as that, its community is joined to the other one and both
    are checked again; so what graph, modularity and means left apart comes together, and no cluster is reported with
    a similar row outside. Copies are compared once and count as rows.
    """
    heads, members = one_of_each(checkpoint(clean_vectors(df, id_col, vec_col)))
    members, found = checkpoint(members), []
    for part in by_length(heads):
        rows = grouped(part, least, k, settled, seed)[0]
        sizes = members.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("n"))
        sized = lambda now: now.join(sizes, "id").groupBy("community").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size).select("community")  # noqa: B023,E731
        to_check, loose = sized(rows), None
        while True:
            groups = checkpoint(community_means(rows).join(to_check, "community", "left_semi"))
            all_suspects = checkpoint(suspects(rows, groups, least))
            fails = checkpoint(loose_targets(all_suspects.where("community = target"), least))
            loose = fails if loose is None else checkpoint(loose.union(fails))
            links = checkpoint(outer_links(all_suspects.where("community <> target"), rows, least))
            if links.isEmpty():
                break
            names = connected_components(links)
            bad = names.join(loose.select(F.col("target").alias("id")), "id", "left_semi").select(F.col("component").alias("target")).distinct()
            loose = checkpoint(loose.union(bad))  # what is joined to a loose community is loose
            rows = checkpoint(relabelled(rows, links))
            changed = names.select(F.col("component").alias("community")).distinct()
            to_check = checkpoint(sized(rows).join(changed, "community", "left_semi").join(loose.select(F.col("target").alias("community")), "community", "left_anti"))
        good = sized(rows).join(loose.select(F.col("target").alias("community")), "community", "left_anti")
        found.append(rows.join(good, "community", "left_semi").select(F.col("id").alias("rep"), "community"))
    all_rows = members.join(reduce(DataFrame.unionByName, found), "rep").select("id", "community")
    first = all_rows.groupBy("community").agg(F.min("id").alias("first_id"))
    return all_rows.join(first, "community").select("id", F.col("first_id").alias("community"))


def describe(found: DataFrame, samples: DataFrame, typical: int = 3) -> DataFrame:
    """One row for each community of two or more samples: size, most typical members, and what the given clustering says.

    The typical members have the highest weighted degree inside the community (ties: smaller id).
    `given_label` is the most frequent cluster_labels value (ties: smaller; -1 and null don't count),
    `given_share` its share of the members, `given_labels` the number of different ones, `mean_prob` the
    mean of cluster_probs without nulls and NaN.
    """
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    top = found.withColumn("r", rank).where(F.col("r") <= typical)
    tops = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical_ids"))
    given = first_delivery(samples.select("sample_id", "cluster_labels", "cluster_probs", "loaded_at"), "sample_id").select(
        F.col("sample_id").alias("id"), F.when(F.col("cluster_labels") != -1, F.col("cluster_labels")).alias("label"), F.when(~F.isnan("cluster_probs"), F.col("cluster_probs").cast("double")).alias("prob")
    )
    votes = found.join(given, "id", "left").groupBy("community", "label").agg(F.count("*").alias("n"), F.sum("prob").alias("p"), F.count("prob").alias("np"))
    said = votes.groupBy("community").agg(
        F.sum("n").alias("size"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", (-F.col("label")).alias("neg")))).alias("m"),
        F.count("label").alias("given_labels"), (F.sum("p") / F.sum("np")).alias("mean_prob"),
    ).where(F.col("size") > 1)
    return said.join(tops, "community").select(
        "community", "size", "typical_ids", (-F.col("m.neg")).alias("given_label"), F.round(F.col("m.n") / F.col("size"), 6).alias("given_share"), "given_labels", F.round("mean_prob", 6).alias("mean_prob"),
    )
