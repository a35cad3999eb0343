"""Metrics on small cases and their known properties."""

from __future__ import annotations

import math

from voxloom.operators import assign, metrics as M


def table(spark, pairs):
    return M.contingency(spark.createDataFrame(pairs, "y string, p string"), "y", "p")


def test_perfect_and_null(spark):
    t = table(spark, [("a", "1"), ("a", "1"), ("b", "2"), (None, "2"), ("a", None)])
    s = M.pair_scores(t).first()
    assert (s.ari, s.nmi, s.fmi) == (1.0, 1.0, 1.0)
    assert M.purity(t).first().purity == 1.0 and tuple(M.bcubed(t).first())[1:] == (1.0, 1.0)


def test_report_counts_labels_of_both_sides(spark):
    rep = {r.label: (r.precision, r.recall, r.support) for r in M.class_report(table(spark, [("a", "a"), ("a", "c"), ("b", "a")])).collect()}
    assert rep == {"a": (0.5, 0.5, 2), "b": (0.0, 0.0, 1), "c": (0.0, 0.0, 0)}


def test_entropy_and_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, float("nan")), ("a", None), ("b", 4.0)], "l string, x double")
    e = M.label_entropy(df, "l").first()
    assert (e.n_labels, e.entropy, e.normalized) == (2, round(math.log(2), 6), 1.0)
    s = M.distribution_stats(df, "x").first()
    assert (s.n, s.min, s.median, s.max) == (3, 1.0, 2.0, 4.0)
    assert M.distribution_stats(df.limit(0), "x").where("n > 0").count() == 0


def test_eer(spark):
    good = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0), (None, 1)], "s double, l int")
    assert M.equal_error_rate(good, "s", "l").first().eer == 0.0
    swapped = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.2, 0), (0.1, 1)], "s double, l int")
    assert M.equal_error_rate(swapped, "s", "l").first().eer == 0.5


def test_hungarian_beats_greedy(spark):
    m = spark.createDataFrame([("r", "x", "A", 5), ("r", "x", "B", 4), ("r", "y", "A", 4)], "rec_id string, sys_label string, gt_label string, overlap_ms bigint")
    assert sorted((r.sys_label, r.gt_label, r.overlap_ms) for r in assign.map_speakers(m).collect()) == [("x", "B", 4), ("y", "A", 4)]


def test_speech_detection(spark):
    iv = lambda rows: spark.createDataFrame(rows, "rec_id string, start_ms bigint, end_ms bigint")
    got = M.speech_detection(iv([("r", 0, 10), ("r", 5, 20)]), iv([("r", 15, 30), ("q", 0, 5)]), ["rec_id"])
    assert {r.rec_id: (r.gt_ms, r.pred_ms, r.both_ms) for r in got.collect()} == {"r": (20, 15, 5), "q": (0, 5, 0)}
