"""Vectors, graphs, propagation, clustering and selection: hand cases and properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.operators import cluster as C
from voxloom.operators import graphs as G
from voxloom.operators import propagate as P
from voxloom.operators import select as S
from voxloom.operators import vectors as V
from voxloom.operators.components import connected_components
from voxloom.plans import reference as R


@pytest.fixture(scope="module")
def data(spark):
    return checkpoint(S.synthetic_clusters(spark, 90, 16, 3, 0.3))


def matrix(df):
    rows = df.orderBy("id").collect()
    return np.array([r.vec for r in rows]), np.array([r.label for r in rows])


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_exact_neighbours(spark, data, metric):
    x, _ = matrix(data)
    d = V.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(0, 90, 10) for j in np.lexsort((np.arange(90), np.round(d[i], 9)))[:4]}
    got = V.exact_neighbours(data.where("id % 10 = 0"), data, 4, metric, block=3)
    assert {(r.i, r.j) for r in got.collect()} == want
    assert V.exact_neighbours(data.limit(0), data, 4).count() == 0


def test_standardize_pca_lda(spark, data):
    x, y = matrix(data)
    z = np.array([r.z for r in V.standardize(data, "vec").orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(0)) / x.std(0))
    mean, axes = V.fit_pca(data, "vec", 0.95, 50)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    assert axes.shape[1] == k and np.allclose(((x - mean) @ axes).var(0), values[:k])
    m, lda = V.fit_lda(data, "vec", "label")
    p = (x - m) @ lda
    within = sum(((p[y == c] - p[y == c].mean(0)) ** 2).sum() for c in range(3))
    assert lda.shape[1] == 2 and within < 0.1 * ((p - p.mean(0)) ** 2).sum()
    with pytest.raises(ValueError):
        V.fit_lda(data.where("label = 0"), "vec", "label")


def test_silhouette_and_indices(spark, data):
    x, y = matrix(data)
    d = V.distances(x, x, "euclidean")
    a = np.array([d[i][(y == y[i])].sum() / ((y == y[i]).sum() - 1) for i in range(90)])
    b = np.array([min(d[i][y == c].mean() for c in range(3) if c != y[i]) for i in range(90)])
    got = {r.id: r.silhouette for r in V.silhouettes(data, "label", block=32).collect()}
    assert np.allclose([got[i] for i in range(90)], (b - a) / np.maximum(a, b), atol=2e-6)
    one = V.cluster_indices(data.where("label = 0"), "label").first()
    assert one.davies_bouldin is None and one.calinski_harabasz is None


def test_components_and_forest(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 60, 70), r.integers(0, 60, 70), r.integers(1, 6, 70))]
    parent = list(range(60))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    weight = 0
    for a, b, w in sorted(((min(a, b), max(a, b), w) for a, b, w in edges), key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            weight += w
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    df = spark.createDataFrame(edges, "i bigint, j bigint, d double")
    ab = df.select(F.col("i").alias("a"), F.col("j").alias("b"))
    got = {x.id: x.component for x in connected_components(ab).collect()}
    assert got == {x.id: x.component for x in connected_components(ab, solo_edges=0).collect()}
    low = {}
    for v in nodes:
        low[find(v)] = min(v, low.get(find(v), v))
    assert got == {v: low[find(v)] for v in nodes}
    tree = G.minimum_spanning_forest(df).collect()
    assert {tuple(t) for t in tree} == {tuple(t) for t in G.minimum_spanning_forest(df, solo_edges=0).collect()}
    assert sum(t.d for t in tree) == weight and len(tree) == len(nodes) - len(set(map(find, nodes)))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert G.minimum_spanning_forest(df.limit(0)).count() == 0


def test_graph_rows_and_connection(spark, data):
    near = checkpoint(V.exact_neighbours(data.select("id", "vec"), data.select("id", "vec"), 20, "euclidean"))
    g = G.row_stochastic(G.affinity(near.where("rank <= 4")))
    assert g.groupBy("i").agg(F.abs(F.sum("w") - 1).alias("e")).where("e > 1e-9").count() == 0
    scaled = G.local_scaled(near.where("rank <= 4"), diagonal=None)
    back = scaled.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    assert scaled.join(back, ["i", "j"]).where("abs(w - v) < 1e-12").count() == scaled.count()
    apart = G.local_scaled(near.where("rank <= 4"), mutual="mean", diagonal=None)
    every = V.exact_neighbours(data.select("id", "vec"), data.select("id", "vec"), 89, "euclidean").select("i", "j", F.col("dist").alias("d"))
    assert G.graph_stats(G.connect(apart, every)).first().n_components == 1


def test_propagation_recovers_groups(spark, data):
    near = checkpoint(V.exact_neighbours(data.select("id", "vec"), data.select("id", "vec"), 6, "euclidean"))
    w = checkpoint(G.row_stochastic(G.affinity(near)))
    nodes = data.select(F.col("id").alias("i"), F.when(F.col("id") < 6, F.col("label").cast("string")).alias("label"))
    classes = P.class_list(nodes)
    f, history = P.propagate(w, P.initial_scores(nodes, classes), classes, max_iter=30, tol=1e-3)
    got = {r.i: r.lp_label for r in P.decide(f, classes).collect()}
    truth = {r.id: str(r.label) for r in data.collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 88 and history[-1]["delta"] < history[0]["delta"]
    total = f.select(F.abs(F.aggregate("f", F.lit(0.0), lambda a, x: a + x) - 1).alias("e"))
    assert total.where("e > 1e-9").count() == 0
    clamp, _ = P.propagate(w, P.initial_scores(nodes, classes), classes, clamp=True, max_iter=5, tol=0.0)
    assert clamp.count() == 90


def test_propagation_query_runs_to_its_stop(spark, small, monkeypatch):
    seen, real = [], P.propagate

    def spy(edges, nodes, classes, **given):
        f, history = real(edges, nodes, classes, **given)
        seen.append((edges.toPandas(), nodes.toPandas().sort_values("i"), classes, history))
        return f, history

    monkeypatch.setattr(P, "propagate", spy)
    got = R.propagation_converged(spark, small).toPandas().sort_values("i")
    edges, nodes, classes, history = seen[0]
    assert history[-1]["delta"] < 1e-6 or len(history) == 100
    at = {x: k for k, x in enumerate(nodes.i)}
    w = np.zeros((len(at), len(at)))
    w[edges.i.map(at), edges.j.map(at)] = edges.w
    hot = lambda col: np.array([[1.0 * (x == c) for c in classes] for x in col])
    known, f = nodes.label.notna().to_numpy()[:, None], np.stack(nodes.y.to_list())
    for _ in range(100):
        s, old = 0.95 * w @ f, f
        weak = 0.05 * nodes.conf.to_numpy()[:, None]
        f = np.where(known, 0.8 * s + 0.2 * hot(nodes.label), (1 - weak) * s + weak * hot(nodes.prior))
        f /= f.sum(axis=1, keepdims=True)
        if np.abs(f - old).sum() < 1e-6:
            break
    assert np.allclose(got.lp_confidence, f.max(axis=1), atol=2e-6)


def test_propagation_query_does_not_start_jobs_for_every_step(spark, small):
    sc = spark.sparkContext
    sc.setJobGroup("propagation", "")
    try:
        assert R.propagation_converged(spark, small).count() == 500
        started = len(sc.statusTracker().getJobIdsForGroup("propagation"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < started < 100  # 100 steps to the stop


@pytest.mark.parametrize("how", [{}, {"weak": 0.05}, {"clamp": True}])
def test_propagation_in_one_task_and_in_steps(spark, how):
    far = 2**60  # as a float it is no number of its own
    edges = [(far + a, far + b, w) for a, b, w in [(0, 1, 0.6), (0, 2, 0.4), (1, 0, 1.0), (2, 3, 0.5), (2, 1, 0.5), (3, 9, 0.7), (3, 2, 0.3), (9, 1, 1.0), (5, 0, 0.0)]]
    w = spark.createDataFrame([*edges, (far, None, 0.5), (None, far, 0.5), (far + 1, far + 2, None)], "i bigint, j bigint, w double")
    nodes = [(far, "a", None, None), (far + 1, "b", "b", 0.9), (far + 2, None, "a", 0.8), (far + 3, None, "b", 0.1), (far + 4, None, None, None), (far + 5, None, "x", 0.9), (None, "a", None, None)]
    start = P.initial_scores(spark.createDataFrame(nodes, "i bigint, label string, prior string, conf double"), ["a", "b"], "prior", "conf")
    one, steps = (P.propagate(w, start, ["a", "b"], max_iter=4, solo_cells=cells, **how) for cells in (1000, 0))
    ends = [{r.i: r.f for r in f.collect()} for f, _ in (one, steps)]
    assert ends[0].keys() == ends[1].keys() == {far + x for x in range(6)}
    assert all(np.allclose(ends[0][i], ends[1][i], rtol=0, atol=1e-12) for i in ends[0])
    assert [h["iteration"] for h in one[1]] == [h["iteration"] for h in steps[1]] == [1, 2, 3, 4]
    assert all(np.isclose(a[c], b[c], atol=1e-12) for a, b in zip(one[1], steps[1], strict=True) for c in a)
    tol = 1.001 * one[1][1]["delta"]
    settled = [P.propagate(w, start, ["a", "b"], tol=tol, solo_cells=cells, **how)[1] for cells in (1000, 0)]
    assert len(settled[0]) == len(settled[1]) <= 2 and settled[0][-1]["delta"] < tol
    with pytest.raises(ValueError):
        P.propagate(w, start.union(start), ["a", "b"])
    assert P.propagate(w, start.where("i < 0"), ["a", "b"])[0].count() == 0


def test_density_clusters(spark, data):
    got = C.density_clusters(data.select("id", "vec"), 10, 4, 25).collect()
    truth = {r.id: r.label for r in data.collect()}
    names = {}
    for r in got:
        if r.cluster >= 0:
            names.setdefault(r.cluster, set()).add(truth[r.id])
        assert 0 <= r.prob <= 1 and 0 <= r.outlier <= 1
    assert sorted(map(tuple, names.values())) == [(0,), (1,), (2,)] and sum(r.cluster >= 0 for r in got) >= 75


def apart():
    """Two groups of 8 x 5 rows on a grid, 9 apart, 12 copies of one vector, and a row whose neighbours lie in both groups."""
    grid = [(x, y) for x in range(8) for y in range(5)]
    x = np.array([*grid, *[(x + 16, y) for x, y in grid], *[(60, 3)] * 12, (11, 40)], float)
    return np.random.default_rng(3).permutation(len(x)) * 2 + 1, x


@pytest.mark.parametrize("k", [4, 6])
def test_density_clusters_equal_the_tree_of_all_pairs(spark, k):
    ids, x = apart()
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, vec array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    core = np.sort(d, axis=1)[:, 4]
    a, b = np.triu_indices(len(x), 1)
    full = np.maximum(d[a, b], np.maximum(core[a], core[b]))
    want = C.condense(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), full, np.sort(ids), 6).set_index("id")
    got = C.density_clusters(rows, 6, 4, k).toPandas().set_index("id").loc[want.index]
    assert got.cluster.tolist() == want.cluster.tolist()
    assert np.allclose(got[["prob", "outlier"]], want[["prob", "outlier"]])


def test_connect_finds_what_the_neighbours_miss(spark):
    ids, x = apart()
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, vec array<double>")
    near = checkpoint(V.exact_neighbours(rows, rows, 4, "euclidean"))
    graph = checkpoint(G.local_scaled(near.where("rank <= 3 and dist < 9"), mutual="mean", diagonal=None))
    joined = checkpoint(G.connect(graph, near.select("i", "j", F.col("dist").alias("d")), 400.0, vectors=rows))
    every = G.connect(graph, V.exact_neighbours(rows, rows, len(x) - 1, "euclidean").select("i", "j", F.col("dist").alias("d")), 400.0)
    assert np.isclose(joined.agg(F.sum("w")).first()[0], every.agg(F.sum("w")).first()[0])
    assert G.graph_stats(joined).first().n_components == 1


def test_condense_by_hand():
    i, j, d = np.array([0, 1, 3, 4, 2]), np.array([1, 2, 4, 5, 3]), np.array([1.0, 1.0, 1.0, 1.0, 9.0])
    got = C.condense(i, j, d, np.arange(7), 3)
    assert got.cluster.tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert C.condense(i[:0], j[:0], d[:0], np.arange(2), 3).cluster.tolist() == [-1, -1]


def test_model_choice_and_mapper(spark, data):
    runs = [({"k": k}, lambda k=k: C.kmeans(data.select("id", "vec"), k, 1)) for k in (2, 3, 6)]
    params, _ = C.choose_model(runs)
    assert params["k"] == 6
    assert C.choose_model(runs[:1]) is None
    near = checkpoint(V.exact_neighbours(data.select("id", "vec"), data.select("id", "vec"), 6, "euclidean"))
    nodes = checkpoint(C.mapper_nodes(data.select("id", "vec"), near, 5))
    assert nodes.select("id").distinct().count() == 90 and nodes.groupBy("id").count().where("count > 2").count() == 0
    groups = C.mapper_groups(nodes, C.mapper_links(nodes))
    assert groups.select("node").distinct().count() == nodes.select("node").distinct().count()


def test_selection_takes_the_best_of_ten_starts(spark, data, small, monkeypatch):
    starts, real = [], S.kmeans

    def spy(vectors, k, n_init, seed):
        starts.append(n_init)
        return real(vectors, k, 1, seed)

    monkeypatch.setattr(S, "kmeans", spy)
    R.kmeans_representatives(spark, small), R.hybrid_selection(spark, small)
    S.representatives(data.select("id", "vec"), 6, 3), S.hybrid_selection(data.select("id", "vec"), 6, 3)
    assert starts == [10] * 4


def test_selection(spark, data):
    rows = data.withColumn("p", (F.col("id") * 37 % 90) / 90.0).unionByName(spark.createDataFrame([(500, [1.0] * 16, 7, 0.5), (501, [1.0] * 16, -1, 0.5)], "id bigint, vec array<double>, label int, p double"))
    got = {}
    for r in S.select_for_labelling(rows, "label", "p").collect():
        got.setdefault(r.label, []).append(r.reason)
    assert {k: sorted(v) for k, v in got.items()} == {c: ["boundary_diverse", "centroid", "uncertain"] for c in range(3)} | {7: ["small_cluster"]}
    top = S.top_per_group_then_global(rows.select("id", "label", "p"), "label", "p", 1, 10)
    assert top.count() == 10 and top.select("id").distinct().count() == 10
    split = S.stratified_split(rows, "label", 0.2)
    assert {r.label: r.n for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 6, 1: 6, 2: 6, 7: 1, -1: 1}
    sets = S.nested_speakers(rows, "label").groupBy("subset").count().orderBy("subset").collect()
    assert [(r.subset, r["count"]) for r in sets] == [(n, n) for n in range(2, 6)]
    assert S.random_uncertainty(data.select("id", "vec"), 5, 3).count() == 5
