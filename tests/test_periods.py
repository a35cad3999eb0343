"""Problem 1: continuous periods and gaps against brute force, and the defined cases."""

from __future__ import annotations

import random

from voxloom.operators.periods import speaking_periods, sweep_periods

DDL = "who string, s bigint, e bigint, k0 string, t bigint, active bigint"


def brute(rows):
    out, by = set(), {}
    for who, s, e, *_ in rows:
        if who is not None and s is not None and e is not None and e > s:
            by.setdefault(who, []).append((s, e))
    for who, xs in by.items():
        xs.sort()
        now = list(xs[0])
        for s, e in xs[1:]:
            if s <= now[1]:
                now[1] = max(now[1], e)
            else:
                out |= {(who, "covered", *now), (who, "gap", now[1], s)}
                now = [s, e]
        out.add((who, "covered", *now))
    return out


def test_against_brute_force_across_buckets(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "hot", "hot", None]), s := r.randrange(0, 3000), s + r.randrange(-3, 25), "x", 1, 2) for _ in range(600)]
    rows += rows[:50] + [("n", None, 5, "x", 1, 2), ("n", 5, None, "x", 1, 2)]
    for width in (7, 100, 10_000):  # intervals and periods span many buckets
        got = sweep_periods(spark.createDataFrame(rows, DDL), ["who"], "s", "e", width)
        assert {tuple(x) for x in got.collect()} == brute(rows)


def test_touching_nested_empty(spark):
    rows = [("a", 0, 10, "", 0, 0), ("a", 10, 20, "", 0, 0), ("a", 12, 13, "", 0, 0), ("a", 21, 22, "", 0, 0), ("a", 30, 30, "", 0, 0), ("a", 40, 35, "", 0, 0)]
    got = {tuple(x) for x in sweep_periods(spark.createDataFrame(rows, DDL), ["who"], "s", "e").collect()}
    assert got == {("a", "covered", 0, 20), ("a", "gap", 20, 21), ("a", "covered", 21, 22)}
    assert sweep_periods(spark.createDataFrame([], DDL), ["who"], "s", "e").count() == 0


def test_labels_and_dirt(spark):
    ddl = "seg_id bigint, rec_id string, speaker_label string, start_time double, end_time double, loaded_at timestamp_ntz, kind string, start_ms string"
    from datetime import datetime

    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [
        (1, "r", "Spk 01", 0.0, 1.0000000004, t1, "", ""), (2, "r", " SPK__01", 2.0, 3.0, t1, "", ""), (3, "r", " spk 01", 2.5, 4.0, t1, "", ""), (4, "r", "\tspk - 01", 6.0, 7.0, t1, "", ""),
        (5, "r", "UNKNOWN ", 1.0, 9.0, t1, "", ""), (6, "r", "noisebck", 1.0, 9.0, t1, "", ""), (7, "r", "  ", 1.0, 9.0, t1, "", ""), (8, "r", None, 1.0, 9.0, t1, "", ""), (9, "r", "spk_01", float("nan"), 9.0, t1, "", ""),
        (10, "r", "spk_01", 5.0, None, t1, "", ""), (11, None, "spk_01", 1.0, 9.0, t1, "", ""), (2, "r", "spk_01", 0.0, 99.0, t2, "", ""), (None, "r", "spk_02", 0.0, 1.0, t1, "", ""), (None, "r", "spk_02", 5.0, 6.0, None, "", ""),
    ]
    got = {tuple(x) for x in speaking_periods(spark.createDataFrame(rows, ddl)).where("kind = 'gap'").drop("kind").collect()}
    assert got == {("r", "spk_01", 1000, 2000), ("r", "spk_01", 4000, 6000), ("r", "spk_02", 1000, 5000)}
