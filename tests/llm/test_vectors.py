"""Problems 2, 4 and 5 against brute force on planted groups, with invalid vectors, copies and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from voxloom.llm import communities as C
from voxloom.llm import neighbours as N
from voxloom.llm import subset as S

DDL = "id bigint, vec array<float>, loaded_at string, a int, community int, pick int"


def planted(seed=5, groups=(1, 1, 4, 5, 9, 60), width=24, noise=0.25):
    r = np.random.default_rng(seed)
    rows = []
    for g in groups:
        centre = r.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(g):
            v = centre + noise * r.normal(size=width) / np.sqrt(width)
            rows.append(v * r.uniform(0.3, 4))
    ids = r.permutation(len(rows)) * 3 + 7
    return ids, np.array(rows, np.float32)


def frame(spark, ids, m, extra=()):
    rows = [(int(i), [float(x) for x in v], "a", 0, 0, 0) for i, v in zip(ids, m)]
    rows += [(rows[0][0], [1.0] * m.shape[1], "b", 0, 0, 0), (10_001, None, "a", 0, 0, 0), (10_002, [0.0] * m.shape[1], "a", 0, 0, 0), (10_003, [float("nan")] * m.shape[1], "a", 0, 0, 0), (10_004, [1.0, 2.0], "a", 0, 0, 0), (10_005, [], "a", 0, 0, 0), (None, [1.0] * m.shape[1], "a", 0, 0, 0), (10_006, [None] * m.shape[1], "a", 0, 0, 0), *extra]
    return spark.createDataFrame(rows, DDL)


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_is_a_curve(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = N.hilbert_keys(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("half", [8, 2048])
def test_neighbours(spark, half):
    ids, m = planted()
    sims = unit(m) @ unit(m).T
    np.fill_diagonal(sims, -2)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.argsort(-sims[i])[:3]}
    got = {(r.a, r.b) for r in N.nearest_vectors(frame(spark, ids, m), "id", "vec", 3, half=half, curves=6).collect()}
    assert len(got & want) / len(want) >= (0.9 if half == 8 else 1.0)
    near = {(r.a, r.b) for r in N.nearest_vectors(frame(spark, ids, m), "id", "vec", 3, 0.9, every=3).collect()}
    assert near == {(a, b) for a, b in want if a % 3 == 0 and sims[list(ids).index(a), list(ids).index(b)] >= 0.9}


def test_windows_do_not_end_at_partitions(spark):
    n, half, r = 300, 8, np.random.default_rng(11)
    m = r.normal(size=(n, 12)).astype(np.float32)
    ids = r.permutation(n).astype(np.int64)
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id bigint, vec array<float>")
    want = set()
    for c in range(2):
        line = ids[np.lexsort((ids, N.curve_keys(N.unit_rows(m), c, N.DIMS, N.BITS, 42)))].tolist()
        want |= {(a, b) for x, a in enumerate(line) for b in line[max(0, x - half) : x + half + 1] if a != b}
    names, got = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), []
    old = [spark.conf.get(c) for c in names]
    try:
        for parts in ("3", "60"):
            spark.conf.set(names[0], parts), spark.conf.set(names[1], "false")
            got.append({(r.a, r.b) for r in N.curve_neighbours(rows, 8 * half, curves=2, half=half).collect()})
    finally:
        for c, v in zip(names, old):
            spark.conf.set(c, v)
    assert got[0] == got[1] and want <= got[0]


def test_copies_form_no_hot_group(spark):
    ids, m = planted(groups=(1, 3))
    copies = [(20_000 + i, [1.0] + [0.0] * (m.shape[1] - 1), "a", 0, 0, 0) for i in range(40)]
    got = [(r.a, r.b, r.rank) for r in N.nearest_vectors(frame(spark, ids, m, copies), "id", "vec", 3).where("a >= 20000").collect()]
    assert sorted(got) == sorted((20_000 + i, b, k + 1) for i in range(40) for k, b in enumerate([x for x in range(20_000, 20_004) if x != 20_000 + i][:3]))


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    assert N.nearest_vectors(none, "id", "vec", 3).count() == 0
    assert C.tight_clusters(none, "id", "vec").count() == 0
    assert S.diverse_subset(none, "id", "vec", 5).count() == 0


def test_tight_clusters(spark):
    ids, m = planted()
    sims = unit(m.astype(float)) @ unit(m.astype(float)).T
    want = {}
    for i in range(len(ids)):
        mine = np.flatnonzero(sims[i] >= 0.72)
        if len(mine) >= 5 and (sims[np.ix_(mine, mine)] >= 0.72).all() and all((np.flatnonzero(sims[j] >= 0.72) == mine).all() for j in mine):
            want[int(ids[i])] = int(ids[mine].min())
    assert sorted(np.bincount(list(want.values()))[np.unique(list(want.values()))]) == [5, 9, 60]
    got = {r.id: r.community for r in C.tight_clusters(frame(spark, ids, m), "id", "vec").collect()}
    assert got == want


def test_chain_is_no_cluster(spark):
    angles = np.deg2rad(np.arange(12) * 8.0)  # neighbours are similar, the ends are not
    m = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    assert C.tight_clusters(frame(spark, np.arange(12) + 1, m), "id", "vec").count() == 0


def test_modularity_in_blocks(spark):
    edges = [(g * 10 + i, g * 10 + j, 1.0) for g in range(6) for i in range(8) for j in range(i + 1, 8)] + [(g * 10, g * 10 + 10, 0.1) for g in range(5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    for nodes in (10**6, 12):
        got = {r.id: r.community for r in C.modularity_communities(df, nodes).collect()}
        assert got == {g * 10 + i: g * 10 for g in range(6) for i in range(8)}


def test_check_reunites_what_the_graph_left_apart(spark, monkeypatch):
    """With every row a community of its own and no means compared, the exact check alone finds the clusters of enough rows."""
    ids, m = planted(groups=(60, 9, 30))
    got = {r.id: r.community for r in C.tight_clusters(frame(spark, ids, m), "id", "vec").collect()}
    real = C.grouped

    def split(vectors, *rest):
        rows, edges = real(vectors, *rest)
        return rows.selectExpr("id", "vec", "min(id) over (partition by community, id % 2) as community"), edges

    monkeypatch.setattr(C, "grouped", split)
    again = {r.id: r.community for r in C.tight_clusters(frame(spark, ids, m), "id", "vec", min_size=4).collect()}
    assert got and {i: c for i, c in again.items() if i in got} == got


def test_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(6)] + [(10 + i, [1.0, 0.01 * i, 0.0]) for i in range(6)]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "id bigint, vec array<float>, loaded_at string")
    assert {(r.a < 10) == (r.b < 10) for r in N.nearest_vectors(df, "id", "vec", 3).collect()} == {True}
    assert sorted((r.id, r.community) for r in C.tight_clusters(df, "id", "vec").collect()) == [(i, 0 if i < 10 else 10) for i, _ in rows]
    assert S.diverse_subset(df, "id", "vec", 4).count() == 4


def test_copies_are_one_node(spark):
    ids, m = planted(groups=(40,))
    m = np.concatenate([m, np.tile(m[:1], (100, 1))])
    ids = np.concatenate([ids, ids.max() + 1 + np.arange(100)])
    got = {r.community for r in C.tight_clusters(frame(spark, ids, m), "id", "vec").collect()}
    assert C.tight_clusters(frame(spark, ids, m), "id", "vec").count() == 140 and got == {int(ids.min())}


def test_greedy_equals_exhaustive_gain():
    r = np.random.default_rng(0)
    m = unit(r.normal(size=(40, 6)))
    order, gain = S.greedy_determinant(m, 10, 0.3)
    kernel = np.exp((m @ m.T - 1) / 0.3)
    chosen: list[int] = []
    for j, g in zip(order, gain):
        base = np.linalg.det(kernel[np.ix_(chosen, chosen)]) if chosen else 1.0
        dets = [np.linalg.det(kernel[np.ix_([*chosen, x], [*chosen, x])]) / base if x not in chosen else -1 for x in range(40)]
        assert abs(max(dets) - g) < 1e-8 and abs(dets[j] - g) < 1e-8
        chosen.append(int(j))


def test_subset_covers_every_group(spark):
    ids, m = planted(groups=(1, 1, 2, 3, 5, 300), width=32)
    got = S.diverse_subset(frame(spark, ids, m), "id", "vec", 12, part_rows=40, final_rows=60).orderBy("pick").collect()
    owner = np.repeat(np.arange(6), (1, 1, 2, 3, 5, 300))
    at = {int(i): g for i, g in zip(ids, owner)}
    assert len({r.id for r in got}) == 12 and {at[r.id] for r in got[:6]} == set(range(6))
    assert [r.pick for r in got] == list(range(1, 13))
    few = S.diverse_subset(frame(spark, ids[:3], m[:3]), "id", "vec", 12)
    assert few.count() == 3
    cover = S.nearest_pick(frame(spark, ids, m), "id", "vec", spark.createDataFrame([(r.id,) for r in got], "id bigint"))
    assert cover.count() == len(ids) and cover.where("sim < 0.5").count() == 0


def test_core_sets_come_near_the_greedy_choice_over_all_rows(spark):
    ids, m = planted(groups=(1, 2, 3, 40, 80, 400, 700), width=32, noise=0.6)
    order, _ = S.greedy_determinant(unit(m.astype(float)), 24)
    for part_rows, final_rows in ((100, 300), (100, 60)):  # the second with a final pass in stretches
        got = S.diverse_subset(frame(spark, ids, m), "id", "vec", 24, part_rows=part_rows, final_rows=final_rows).collect()
        at = {int(i): k for k, i in enumerate(ids)}
        value = lambda rows: np.linalg.slogdet(np.exp((unit(m[rows].astype(float)) @ unit(m[rows].astype(float)).T - 1) / S.WIDTH))[1]
        chance = np.mean([value(np.random.default_rng(s).choice(len(ids), 24, replace=False)) for s in range(20)])
        assert len(got) == 24
        assert value([at[r.id] for r in got]) >= value(order) - 0.1 * abs(value(order) - chance)


def test_subset_of_copies(spark):
    m = np.tile(np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], np.float32), (20, 1))
    got = S.diverse_subset(frame(spark, np.arange(40) + 1, m), "id", "vec", 5).orderBy("pick").collect()
    assert len(got) == 5 and [r.gain > 0 for r in got] == [True, True, False, False, False]
