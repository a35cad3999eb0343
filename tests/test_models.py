"""Embeddings, learned metrics, kernel machines, anchored propagation and the small helpers beside them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import scalars
from voxloom.operators import cluster, embed, graphs, metrics, propagate, select, vectors
from voxloom.sources import readers


def groups(spark, sizes=(40, 40, 40), width=12, noise=0.35, seed=3, skew=None):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(len(sizes), width))
    label = np.repeat(np.arange(len(sizes)), sizes)
    x = centres[label] + noise * r.normal(size=(len(label), width))
    if skew is not None:
        x[:, skew] *= 40  # a place that says nothing but dominates distances
    return spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id bigint, vec array<double>, label int"), x, label


def purity(at, label, k=5):
    d = vectors.distances(at, at, "euclidean")
    np.fill_diagonal(d, np.inf)
    return (label[np.argsort(d, axis=1)[:, :k]] == label[:, None]).mean()


@pytest.mark.parametrize("make", [lambda v, n: embed.umap(v, 2, 10, landmarks=n), lambda v, n: embed.tsne(v, 2, 15.0, landmarks=n)])
@pytest.mark.parametrize("landmarks", [10_000, 60])
def test_embeddings_keep_groups(spark, make, landmarks):
    df, _, label = groups(spark)
    rows = {r.id: r.reduced for r in make(df, landmarks).collect()}
    at = np.array([rows[i] for i in range(len(label))])
    assert at.shape == (120, 2) and np.isfinite(at).all() and purity(at, label) > 0.95
    again = {r.id: r.reduced for r in make(df.repartition(3), landmarks).collect()}
    assert all(np.allclose(rows[i], again[i]) for i in rows)


def test_embeddings_of_little(spark):
    none = spark.createDataFrame([], "id bigint, vec array<double>")
    assert embed.umap(none).count() == embed.tsne(none).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id bigint, vec array<double>")
    assert embed.umap(two, 2).count() == embed.tsne(two).count() == 2


def test_large_margin_metric(spark):
    df, x, label = groups(spark, skew=4, noise=0.9)
    mean, m = vectors.fit_lmnn(df, "vec", "label")
    assert purity((x - mean) @ m, label) > purity(x, label) + 0.1
    alone = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 1), (3, [0.0, 1.0], 2)], "id bigint, vec array<double>, label int")
    assert vectors.fit_lmnn(alone, "vec", "label")[1].shape[0] == 2  # nothing to pull together: discriminant axes


def test_svm_is_unsure_between_classes(spark):
    df, _, _ = groups(spark, sizes=(30, 30))
    middle = df.groupBy().agg(F.lit(999).cast("bigint").alias("id"), F.array(*[F.avg(F.col("vec")[i]) for i in range(12)]).alias("vec"), F.lit(None).cast("int").alias("label"))
    got = {r.id: r.uncertainty for r in select.svm_uncertainty(df.unionByName(middle), "label").collect()}
    assert len(got) == 61 and got[999] > np.median([u for i, u in got.items() if i != 999]) and all(-1e-9 <= u <= 0.5 + 1e-9 for u in got.values())


def test_third_choice_where_centre_is_least_certain(spark):
    x = [(0, 0.0), (1, 1.0), (2, -1.0), (3, 2.0), (4, -2.5), (5, 6.0), (6, 7.0)]
    df = spark.createDataFrame([(i, [v, 0.0], 1, 0.1 if i == 3 else 0.9) for i, v in x], "id bigint, vec array<double>, label int, prob double")
    got = {(r.id, r.reason) for r in select.select_for_labelling(df, "label", "prob").collect()}
    centre = np.mean([v for _, v in x])
    nearest = min(x, key=lambda p: abs(p[1] - centre))[0]
    sure = spark.createDataFrame([(i, [v, 0.0], 1, 0.1 if i == nearest else 0.9) for i, v in x], "id bigint, vec array<double>, label int, prob double")
    edge = {(r.id, r.reason) for r in select.select_for_labelling(sure, "label", "prob").collect()}
    assert len(got) == 3 and (3, "uncertain") in got or nearest == 3
    far = max((p for p in x if p[0] != nearest), key=lambda p: abs(p[1] - x[nearest][1]))[0]
    mean = {i: np.mean([abs(v - w) for j, w in x if j != i]) for i, v in x}
    left = max((i for i, _ in x if i not in (nearest, far)), key=lambda i: mean[i])
    assert edge == {(nearest, "centroid"), (far, "boundary_diverse"), (left, "edge_boundary")}


def test_anchored_propagation(spark):
    r = np.random.default_rng(1)
    w = r.random((8, 8)) * (r.random((8, 8)) < 0.6)
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    labels = ["a", None, "b", None, None, None, None, "a"]
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(8) for j in range(8) if w[i, j] > 0], "i bigint, j bigint, w double")
    nodes = propagate.initial_scores(spark.createDataFrame(list(enumerate(labels)), "i bigint, label string"), ["a", "b"])
    f, changes = propagate.propagate_anchored(edges, nodes, 2)
    y = np.array([[x == c for c in "ab"] for x in labels], float)
    want, known = y.copy(), np.array([x is not None for x in labels])
    for _ in changes:
        want = 0.5 * w @ want + 0.5 * y
        want[known] = 0.9 * y[known] + 0.1 * want[known]
    got = np.array([x.f for x in f.orderBy("i").collect()])
    assert np.allclose(got, want) and changes[-1] < 1e-6 and len(changes) < 100


def test_persistence_of_clusters(spark):
    df, _, label = groups(spark, sizes=(30, 30, 30), noise=0.15)
    rows = cluster.density_clusters(df.select("id", "vec"), 10, 5, 12)
    profile = {r.cluster: r for r in cluster.density_clusters(df.select("id", "vec"), 10, 5, 12, profile=True).collect()}
    sizes = {r.cluster: r["count"] for r in rows.where("cluster >= 0").groupBy("cluster").count().collect()}
    assert {c: r.size for c, r in profile.items()} == sizes
    assert all(0 < r.persistence <= 1 and r.max_lambda > r.birth_lambda >= 0 and r.stability > 0 for r in profile.values())


def test_soft_memberships_sum_to_one(spark):
    df, _, _ = groups(spark)
    got = vectors.soft_memberships(df, "label").groupBy("id").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n == 3 for r in got) and len(got) == 120
    assert vectors.soft_memberships(df.limit(0), "label").count() == 0


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, float("nan"), 5.0), (3, 4.0, None), (4, None, 5.0)], "id bigint, a double, b double")
    assert [(r.a, r.b) for r in vectors.min_max(df, ["a", "b"]).orderBy("id").collect()] == [(0.0, 0.0), (None, 0.0), (1.0, None), (None, 0.0)]
    assert vectors.min_max(df.limit(0), ["a"]).count() == 0
    lists = spark.createDataFrame([(["x", "y", "x", "z"], ["y"]), (["x"], None), (None, ["y"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(scalars.list_difference(F.col("a"), F.col("b"))).collect()] == [["x", "x", "z"], ["x"], None, []]
    maps = spark.createDataFrame([({"k": 1, "l": 1, "m": 2},)], "m map<string,int>")
    got = maps.select(scalars.map_invert(F.col("m")).alias("i"), scalars.map_get(F.col("m"), F.lit("q"), F.lit(-1)).alias("g")).first()
    assert got.i == {1: "l", 2: "m"} and got.g == -1


def test_detection_cut_to_the_recording(spark):
    ddl = "rec_id string, start_ms bigint, end_ms bigint"
    gt = spark.createDataFrame([("a", -500, 1000), ("a", 500, 1500), ("a", 9000, 12000), ("b", 0, 10), (None, 0, 10)], ddl)
    pred = spark.createDataFrame([("a", 1000, 2000), ("c", 0, 5)], ddl)
    dur = spark.createDataFrame([("a", 10_000), ("c", 100)], "rec_id string, duration_ms bigint")
    got = {r.rec_id: r for r in metrics.speech_detection(gt, pred, ["rec_id"], dur).collect()}
    a = got["a"]
    assert (a.gt_ms, a.pred_ms, a.both_ms, a.miss_ms, a.false_alarm_ms) == (2500, 1000, 500, 2000, 500)
    assert a.error_rate == 1.0 and a.accuracy == 0.75 and got["b"].accuracy is None and got["c"].error_rate is None and set(got) == {"a", "b", "c"}
    assert metrics.speech_detection(gt.limit(0), pred.limit(0), ["rec_id"]).count() == 0


def test_three_folders(spark):
    a = spark.createDataFrame([("x", "1", "Ann"), ("x", "2", "Bo")], "base string, speaker_number string, speaker_name string")
    b, c = a.where("speaker_number = 1"), a.withColumn("speaker_name", F.lower("speaker_name"))
    got = {(r.left, r.right, r.speaker_number, r.what) for r in readers.compare_directories({"p": a, "q": b, "r": c}).collect()}
    assert got == {("p", "q", "2", "missing in b"), ("p", "r", "1", "other name"), ("p", "r", "2", "other name"), ("q", "r", "1", "other name"), ("q", "r", "2", "missing in a")}
    with pytest.raises(ValueError):
        readers.compare_directories({"p": a})


def test_adaptive_graph_is_joined(spark):
    df, _, _ = groups(spark, sizes=(12, 12), noise=0.05)
    v = df.select("id", "vec")
    near = vectors.exact_neighbours(v, v, 3, "cosine")
    apart = graphs.graph_stats(graphs.adaptive_graph(near, 3)).first()
    whole = graphs.graph_stats(graphs.adaptive_graph(near, 3, vectors=v)).first()
    assert apart.n_components > 1 == whole.n_components


def test_wav_files_are_read_and_cut(spark, tmp_path):
    import wave

    rate, x = 1000, np.sin(np.arange(2000) / 7)
    kinds = {"a": (1, ((x + 1) * 127.5).astype(np.uint8).tobytes()), "b": (2, (x * 32767).astype("<i2").tobytes()), "d": (4, (x * (2**31 - 1)).astype("<i4").tobytes())}
    kinds["c"] = (3, b"".join(int(v).to_bytes(4, "little", signed=True)[:3] for v in (x * (2**23 - 1)).astype(int)))
    for name, (width, raw) in kinds.items():
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(rate), w.writeframes(raw)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    audio = readers.read_wav(spark, str(tmp_path))
    got = {r.rec_id: r for r in audio.collect()}
    assert got["bad"].samples is None and all(got[n].rate == rate and np.allclose(got[n].samples, x, atol=0.02 if n == "a" else 1e-4) for n in "abcd")
    cuts = spark.createDataFrame([("b", 100, 200), ("c", 1900, 2500), ("b", -50, 3)], "rec_id string, start_ms bigint, end_ms bigint")
    made = {r.cut_no: (r.rec_id, len(r.samples), r.samples[0]) for r in readers.cut_audio(audio, cuts, ["rec_id", "start_ms"]).collect()}
    assert [made[k][:2] for k in range(3)] == [("b", 3), ("b", 100), ("c", 100)] and abs(made[1][2] - x[100]) < 1e-4
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.wav").write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        readers.read_wav(spark, f"{tmp_path}/{{*.wav,sub/*.wav}}")


def test_many_classes_are_summed_flat(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i + 1) % 5, 0.5) for i in range(5)] + [(i, (i + 2) % 5, 0.5) for i in range(5)], "i bigint, j bigint, w double")
    scores = spark.createDataFrame([(i, [float(i == c) for c in range(4)]) for i in range(5)], "i bigint, f array<double>")
    plain = {r.i: r.s for r in propagate.spread(edges, scores, 4).collect()}
    monkeypatch.setattr(propagate, "WIDE", 1)
    flat = {r.i: r.s for r in propagate.spread(edges, scores, 4).collect()}
    assert all(np.allclose(plain[i], flat.get(i, [0.0] * 4)) for i in plain)


def test_frame_energies():
    from voxloom.operators import dsp

    x = np.sin(np.arange(800) / 3)
    e = dsp.frame_energies(x)
    assert len(e) == len(dsp.filterbank(x)) and (e > 0).all() and dsp.frame_energies(np.zeros(800)).min() > 0


def test_tree_of_the_complete_graph(spark):
    df, x, _ = groups(spark, sizes=(15, 15), noise=0.2)
    d = vectors.distances(x, x, "euclidean")
    inside, total = {0}, 0.0
    while len(inside) < len(x):  # Prim
        a, b = min(((i, j) for i in inside for j in range(len(x)) if j not in inside), key=lambda e: d[e])
        inside.add(b)
        total += d[a, b]
    got = graphs.spanning_tree(df.select("id", "vec"), 3).collect()
    assert len(got) == len(x) - 1 and abs(sum(r.d for r in got) - total) < 1e-6


def test_grid_of_parameters(spark):
    df, _, _ = groups(spark, sizes=(25, 25), noise=0.2)
    rows = cluster.score_grid(df.select("id", "vec"), [{"k": 2}, {"k": 4}], 2, lambda v, seed, k: cluster.kmeans(v, k, 1, seed))
    assert [(r["k"], r["seed"], r["n_clusters"]) for r in rows] == [(2, 0, 2), (2, 1, 2), (4, 0, 4), (4, 1, 4)]
    assert rows[0]["silhouette"] > 0.6 > 0 < rows[0]["membership_pct"] == 100.0


def test_log_is_appended(spark, tmp_path):
    from voxloom.sources import sinks

    sinks.append_log(spark, str(tmp_path / "log"), ["one", "two"])
    sinks.append_log(spark, str(tmp_path / "log"), ["three"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["one", "three", "two"]
