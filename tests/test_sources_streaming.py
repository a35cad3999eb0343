"""Readers and writers by round trip, speech features, streaming."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import dsp
from voxloom.sources import readers as R
from voxloom.sources import sinks as K
from voxloom.streaming import live


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_vad_text(spark, tmp_path):
    p = put(tmp_path / "v", "a.yaml", "- {duration: 1.5, offset: 2.25, rW: 1, speaker_id: s1, uW: 0, wav: /x/room_b.wav}\njunk\n- {duration: bad, offset: 1}\n")
    assert [tuple(r) for r in R.read_vad_text(spark, p).collect()] == [("room_b", "s1", 2.25, 3.75)]


def test_ground_truth_layouts(spark, tmp_path):
    six = put(tmp_path / "g6", "rec_1_GT.csv", "Ana\ten\t0.5\t1.5\tf.wav\t3\nBob\ten\tx\t2\tf.wav\tq\n")
    assert [tuple(r) for r in R.read_gt(spark, six).orderBy("speaker").collect()] == [("rec_1", "Ana", "en", 0.5, 1.5, "f.wav", 3), ("rec_1", "Bob", "en", None, 2.0, "f.wav", None)]
    three = put(tmp_path / "g3", "r.csv", "0\t1\tAna\n")
    assert tuple(R.read_gt(spark, three, 3).first()) == ("r", "Ana", None, 0.0, 1.0, None, None)
    sb = put(tmp_path / "sb", "r.txt", "1\t0\t1\tSPEECH\n2\t1\t2\tNON_SPEECH\n")
    assert [tuple(r) for r in R.read_hypothesis(spark, sb, "speechbrain").collect()] == [("r", 0.0, 1.0)]
    with pytest.raises(ValueError):
        R.read_hypothesis(spark, sb, "other")


def test_azure_edits_json(spark, tmp_path):
    az = put(tmp_path / "az", "r.txt", '1\t0.0\t1.0\tsay "hi"\t0.9\ten\n2\tx\t2\tb\t0.1\ten\n')
    assert [tuple(r) for r in R.read_azure(spark, az).collect()] == [("r", "1", 0.0, 1.0, 'say "hi"', 0.9, "en")]
    ed = put(tmp_path / "ed", "rec_2024-05-01T10-20-30.tsv", "SampleIndex\tSpeakerLP\tStartTime\tEndTime\tClusterPred\n4\tAna\t1.0\t2.0\t7\n")
    assert tuple(R.read_human_edits(spark, ed).first()) == ("rec_2024-05-01T10-20-30", "rec", 4, "Ana", 1.0, 2.0, 7)
    hl = put(tmp_path / "hl", "h.json", json.dumps({"a": "Ana", "zz": "Bob"}))
    assert [tuple(r) for r in R.read_human_labels(spark, hl, spark.createDataFrame([("a",)], "id string")).collect()] == [("a", "Ana")]
    book = {"b1": {"speakers": [{"speaker_name": n, "speaker_number": k, "image_64": ""} for n, k in (("Ana", "1"), ("Bob", "2"), ("Eve", "2"))]}}
    sp = put(tmp_path / "sp", "s.json", json.dumps(book, indent=1))
    got = R.read_speakers(spark, sp)
    assert sorted(tuple(r) for r in got.collect()) == [("b1", "Ana", "1"), ("b1", "Bob", "2")]
    other = spark.createDataFrame([("b1", "Ana", "1"), ("b1", "Eva", "2"), ("b2", "Ana", "9")], "base string, speaker_name string, speaker_number string")
    assert sorted((r.base, r.speaker_number, r.what) for r in R.directory_differences(got, other).collect()) == [("b1", "2", "other name"), ("b2", "9", "missing in a")]
    assert [tuple(r) for r in R.name_conflicts(other).collect()] == [("Ana", 2)]


def test_pairing_and_index(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [tuple(r) for r in R.pair_files(f("/g/a_gt.csv", "/g/b_GT.csv"), f("/p/a.txt", "/p/c.txt")).collect()] == [("a", "/g/a_gt.csv", "/p/a.txt")]
    with pytest.raises(ValueError):
        R.pair_files(f("/g/a_gt.csv", "/h/a.csv"), f("/p/a.txt"))
    names = R.speaker_index(f(*[f"x/{s}_{i}.wav" for s, n in (("z", 5), ("m", 6), ("q", 2)) for i in range(n)]), 5)
    assert sorted({(r.speaker, r.label) for r in names.collect()}) == [("m", 0), ("z", 1)]
    cuts = R.running_cuts(f(*[f"{i:03d}" for i in range(40)]).repartition(7), ["path"])
    assert [(r.path, r.cut_no) for r in cuts.orderBy("path").collect()] == [(f"{i:03d}", i) for i in range(40)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r2", 5, None, 1500, 2500), ("r1", -1, "Ana", 0, 1234)], "rec_id string, cluster_label int, lp_label string, start_ms bigint, end_ms bigint")
    K.write_predictions(df.coalesce(1), str(tmp_path / "p"))
    back = sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).collect())
    assert back == [("r1", "Ana", "0.000", "1.234"), ("r2", "5", "1.500", "2.500")]
    K.write_by_recording(df, str(tmp_path / "b"))
    assert {r.rec_id for r in spark.read.csv(str(tmp_path / "b")).withColumnRenamed("rec_id", "rec_id").collect()} == {"r1", "r2"}
    K.write_dataset(df, str(tmp_path / "d"))
    K.write_dataset(df.limit(1), str(tmp_path / "d"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    with pytest.raises(Exception, match="already exists"):
        K.write_dataset(df, str(tmp_path / "d"))
    K.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    K.write_selection(df, str(tmp_path / "s"))
    src = put(tmp_path / "t", "x.tsv", "1\t2\n")
    K.rewrite_delimited(spark, src, str(tmp_path / "c"), "a int, b int")
    assert tuple(K.add_constants(spark.read.csv(str(tmp_path / "c"), header=True), lang="en").first()) == ("1", "2", "en")
    m = spark.createDataFrame([("update", 90.0, True), ("update", 100.0, False)], "action string, overlap_pct double, time_modified boolean")
    assert tuple(K.matching_report(m).first()) == ("update", 2, 95.0, 1)
    assert "n: 2" in K.render_report(K.matching_report(m), "matches")


def test_speech_features(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    e = dsp.filterbank(x)
    assert e.shape == (99, 40)
    centre = dsp.mel_to_hz(np.linspace(dsp.hz_to_mel(0), dsp.hz_to_mel(8000), 42))[1:-1]
    assert abs(centre[e.mean(0).argmax()] - 1000) < 120
    assert np.allclose(dsp.log_filterbank(x).mean(0), 0)
    assert dsp.frames(np.arange(5.0), 3, 2).tolist() == [[0, 1, 2], [2, 3, 4]]
    df = spark.createDataFrame([("a", [0.0, 1.0] * 400), ("b", None)], "id string, x array<double>")
    got = {r.id: r.f for r in df.select("id", dsp.log_filterbanks(F.col("x")).alias("f")).collect()}
    assert got["b"] is None and len(got["a"][0]) == 40
    vec = {r.id: r.vec for r in dsp.embed(df, lambda xs: np.array([[len(v), 1.0] for v in xs]), "id", "x").collect()}
    assert vec["b"] is None and abs(np.linalg.norm(vec["a"]) - 1) < 1e-9
    f = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [3.0, 4.0], 5)], "k int, v array<double>, l int")
    got = {r.k: (r.vec, r.label) for r in dsp.recomputed(spark.createDataFrame([(1,), (2,), (3,)], "k int"), f, "k", "v", "l", 2).collect()}
    assert got == {1: ([1.0, 2.0], 77), 2: ([3.0, 4.0], 5), 3: ([0.0, 0.0], 0)}


def run(spark, make, schema, batches, tmp_path, name, mode="append"):
    """Feed batches of rows one by one through a stream; the rows it emitted."""
    src = tmp_path / f"{name}-in"
    src.mkdir()
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        for k, rows in enumerate(batches):
            (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}"


def test_streams(spark, tmp_path):
    schema = "t timestamp, k string, l string"
    rows = [{"t": at(s), "k": "a", "l": x} for s, x in ((0, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "y"))]
    flush = [[{"t": at(600), "k": "z", "l": "x"}], [{"t": at(1200), "k": "z", "l": "x"}]]
    got = run(spark, lambda s: live.live_runs(s, "t", "k", "l"), schema, [rows, *flush], tmp_path, "runs")
    assert sorted((r.k, r.label, r.n) for r in got if r.k == "a") == [("a", "x", 2), ("a", "y", 3)]
    got = run(spark, lambda s: live.live_sessions(s, "t", "k", "2 seconds"), schema, [rows, *flush], tmp_path, "sessions")
    assert [r.n for r in got if r.k == "a"] == [5]
    got = run(spark, lambda s: live.hopping_counts(s, "t", "k", "2 seconds", "1 second"), schema, [rows, *flush], tmp_path, "hops")
    assert sorted(r.n for r in got if r.k == "a") == [1, 1, 2, 2, 2, 2]
