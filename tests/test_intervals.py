"""Hand-computed cases of the interval operators."""

from __future__ import annotations

import pytest

from voxloom.operators import intervals as I


def test_chunks(spark):
    rows = spark.createDataFrame([(1, 0, 1950), (2, 0, 850), (3, 0, 900), (4, None, 5)], "id int, start_ms bigint, stop_ms bigint")
    got = [(r.id, r.chunk_start, r.chunk_stop) for r in I.sliding_chunks(rows).orderBy("id", "chunk_no").collect()]
    assert got == [(1, s, min(s + 1000, 1950)) for s in (0, 200, 400, 600, 800, 1000)] + [(3, 0, 900)]


def test_gap_merge_uses_previous_stop(spark):
    rows = [("n", 1, 0, 10_000), ("n", 2, 1000, 2000), ("n", 3, 5000, 6000), ("g", 4, 0, 1000), ("g", 5, 1200, 2200), ("g", 6, 2401, 2500)]
    got = I.gap_merge(spark.createDataFrame(rows, "k string, id int, s bigint, e bigint"), ["k"], "s", "e", "id")
    assert sorted(map(tuple, got.collect())) == [("g", 0, 2200, 2), ("g", 2401, 2500, 1), ("n", 0, 2000, 2), ("n", 5000, 6000, 1)] or sorted(map(tuple, got.collect())) == [("g", 0, 2200, 2), ("g", 2401, 2500, 1), ("n", 0, 2000, 2), ("n", 5000, 6000, 1)]


def pair(spark, gt, pred):
    g = spark.createDataFrame([(i, "r", *x) for i, x in enumerate(gt)], "seg_id int, rec_id string, speaker_label string, start_ms bigint, end_ms bigint")
    p = spark.createDataFrame([(i, "r", *x) for i, x in enumerate(pred)], "merged_id int, rec_id string, start_ms bigint, end_ms bigint")
    return g, p


def test_best_overlap_ties_and_none(spark):
    g, p = pair(spark, [("b", 0, 5), ("a", 5, 10), ("c", 100_000, 200_000)], [(0, 10), (20, 30), (10, 20), (90_000, 250_000)])
    got = {r.merged_id: (r.matched, r.overlap_ms) for r in I.best_overlap(p, g, "merged_id", ["rec_id"]).collect()}
    assert got == {0: ("b", 5), 1: ("UNKNOWN", 0), 2: ("UNKNOWN", 0), 3: ("c", 100_000)}


@pytest.mark.parametrize(
    ("pred", "matched", "want"),
    [([(0, 8000)], ["A"], (10_000, 2000, 0, 0, 0.2)), ([(0, 10_000), (0, 10_000)], ["A", "B"], (10_000, 0, 10_000, 0, 1.0)), ([], [], (10_000, 10_000, 0, 0, 1.0)), ([(20_000, 21_000)], ["A"], (10_000, 10_000, 0, 1000, 1.1))],
)
def test_diarization_error(spark, pred, matched, want):
    g, p = pair(spark, [("A", 0, 10_000)], pred)
    m = spark.createDataFrame(list(enumerate(matched)), "merged_id int, matched string")
    got = I.diarization_error(p.join(m, "merged_id"), g, ["rec_id"], "merged_id", "seg_id").where("rec_id = 'r'").first()
    assert (got.gt_ms, got.miss_ms, got.error_ms, got.false_alarm_ms, got.der) == want


def test_frames_last_start_wins(spark):
    df = spark.createDataFrame([("r", 1, "a", 0, 35), ("r", 2, "b", 20, 25)], "rec_id string, id int, l string, start_ms bigint, end_ms bigint")
    assert sorted(tuple(r) for r in I.frame_labels(df, ["rec_id"], "l", "id", 10).collect()) == [("r", 0, "a"), ("r", 1, "a"), ("r", 2, "b"), ("r", 3, "a")]
    assert I.frame_labels(df, ["rec_id"], "l", "id", 10, True).count() == 4


def test_edits(spark):
    e = spark.createDataFrame([(1, 7, "x", 0, 1000), (2, 7, "y", 500, 1000), (3, 8, "z", 0, 1005), (4, 8, "z", None, 5), (5, 99, "q", 0, 1), (6, 9, "w", 2, 8)], "edit_id int, sampleindex bigint, speaker string, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame([(7, 0, 1000), (8, 0, 1000), (9, 0, 10)], "merged_id bigint, start_ms bigint, end_ms bigint")
    got = {r.edit_id: (r.split_order, r.overlap_pct, r.time_modified, r.action) for r in I.match_edits(e, s).collect()}
    assert got == {1: (0, 100.0, False, "update"), 2: (1, 50.0, True, "new"), 3: (0, 100.0, False, "update"), 6: (0, 60.0, False, "ignored")}


def test_mode_tie_and_percent(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate([2, 1, 2, 1])] + [("k", None, 9)], "k string, v int, id int")
    assert I.smallest_mode(df, ["k"], "v", "m").first().m == 1
    assert I.keep_top_percent(df, ["k"], "v", "id", 50).count() == 2
    assert {r.v for r in I.keep_frequent(df, "v", 2).collect()} == {1, 2}
