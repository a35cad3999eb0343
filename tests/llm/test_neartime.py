"""Problem 3 against brute force, with tolerance edges, ties, nulls, copies and clashing columns."""

from __future__ import annotations

import random

import pytest

from voxloom.llm.neartime import edits_to_azure, nearest_in_time

L = "lid bigint, ent string, x bigint, s bigint, tick bigint"
R = "rid bigint, ent string, t bigint, k0 string, best int"


def brute(left, right, tol):
    out = set()
    for i, e, x, *_ in left:
        if None in (i, e, x):
            continue
        near = [(abs(t - x), t, j) for j, f, t, *_ in right if None not in (j, f, t) and f == e and abs(t - x) <= tol]
        if near:
            out.add((e, i, min(near)[2], min(near)[0]))
    return out


@pytest.mark.parametrize("tick", [1, 10, 100, 777])
def test_brute_force(spark, tick):
    r = random.Random(tick)
    left = [(i, r.choice(["hot", "hot", "b", None]), r.choice([None, r.randrange(-500, 5000)]), 1, 2) for i in range(200)] + [(None, "b", 5, 1, 2)]
    right = [(i, r.choice(["hot", "hot", "b", None]), r.choice([None, *[r.randrange(-500, 5000)] * 9]), "x", 1) for i in range(150)] + [(None, "b", 5, "x", 1)]
    right += [(900, "hot", right[0][2] or 1, "x", 1), right[3]]
    got = nearest_in_time(spark.createDataFrame(left + left[:20], L), spark.createDataFrame(right, R), ["ent"], ["ent"], "lid", "rid", "x", "t", 60, tick)
    assert {tuple(v) for v in got.collect()} == brute(left, right, 60) and got.count() == len(brute(left, right, 60))


def test_edges_and_empty(spark):
    left = spark.createDataFrame([(1, "a", 1000, 0, 0), (2, "a", 1401, 0, 0), (3, "a", 599, 0, 0)], L)
    right = spark.createDataFrame([(7, "a", 1000, "", 0), (8, "a", 1800, "", 0)], R)
    got = {(v.lid, v.rid, v.distance_ms) for v in nearest_in_time(left, right, ["ent"], ["ent"], "lid", "rid", "x", "t", 400).collect()}
    assert got == {(1, 7, 0), (2, 8, 399)}  # 599 is 401 away
    tie = spark.createDataFrame([(9, "a", 1400, 0, 0)], L)
    assert nearest_in_time(tie, right, ["ent"], ["ent"], "lid", "rid", "x", "t", 400).first().rid == 7
    assert nearest_in_time(left.limit(0), right, ["ent"], ["ent"], "lid", "rid", "x", "t", 400).count() == 0
    assert nearest_in_time(left, right.limit(0), ["ent"], ["ent"], "lid", "rid", "x", "t", 400).count() == 0


def test_dirty_tables(spark):
    e = spark.createDataFrame([(1, "r", 1.0000000001, "2024-01-01", 0), (1, "r", 9.0, "2024-01-02", 0), (2, "r", float("nan"), "2024-01-01", 0), (3, None, 1.0, "2024-01-01", 0)], "edit_id bigint, rec_id string, starttime double, loaded_at string, rid int")
    a = spark.createDataFrame([(10, "r", 1.4, 2.0, "2024-01-01"), (11, "r", 1.1, None, "2024-01-01"), (12, "r", 1.2, float("nan"), "2024-01-01"), (13, "q", 1.0, 2.0, "2024-01-01")], "az_id bigint, rec_id string, start_time double, end_time double, loaded_at string")
    assert [(v.edit_id, v.az_id, v.distance_ms) for v in edits_to_azure(e, a).collect()] == [(1, 10, 400)]
