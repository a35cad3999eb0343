"""Problem 7: the dynamic programme against all segmentations, and runs against a plain scan."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from voxloom.llm.runs import best_boundaries, cluster_runs, collapse_runs

DDL = "rec string, id bigint, lab int, s bigint, e bigint, b int, stretch string"


def cost(labels, starts, ends, cuts, gap, mismatch, penalty):
    total = 0.0
    for lo, hi in zip(cuts, [*cuts[1:], len(labels)]):
        latest = max(starts[lo], ends[lo])
        for i in range(lo + 1, hi):
            if starts[i] - latest > gap:
                return float("inf")
            latest = max(latest, ends[i])
        other = (hi - lo) - max(list(labels[lo:hi]).count(x) for x in labels[lo:hi])
        total += penalty + (mismatch * other if other else 0.0)
    return total


@pytest.mark.parametrize("mismatch", [float("inf"), 0.4, 2.0])
def test_optimal(mismatch):
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 9)
        s = np.cumsum([r.choice([0, 1, 3, 9]) for _ in range(n)])
        e, lab = s + [r.choice([0, 1, 5, 20]) for _ in range(n)], np.array([r.choice([1, 1, 2, 3]) for _ in range(n)])
        got = best_boundaries(lab, s, e, 4, mismatch, 1.0)
        best = min(cost(lab, s, e, (0, *c), 4, mismatch, 1.0) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert got[0] == 0 and cost(lab, s, e, got, 4, mismatch, 1.0) == pytest.approx(best)


def scan(rows, gap):
    out = []
    by = {}
    for rec, i, lab, s, e, *_ in set(rows):
        if None not in (rec, i, lab, s):
            by.setdefault(rec, []).append((s, i, lab, max(s, s if e is None else e)))
    for rec, xs in by.items():
        now = None
        for s, i, lab, e in sorted(xs):
            if now and now[1] == lab and s - now[6] <= gap:
                now[3], now[4], now[6] = i, now[4] + 1, max(now[6], e)
            else:
                now = [rec, lab, i, i, 1, s, e]
                out.append(now)
    return sorted(tuple([*x, x[6] - x[5]]) for x in out)


@pytest.mark.parametrize("width", [5, 50, 10**6])
def test_runs_span_buckets(spark, width):
    r = random.Random(4)
    t, rows = 0, []
    for i in range(300):
        t += r.choice([0, 1, 2, 2, 9])
        rows.append((r.choice(["hot", "hot", "b", None]), i, r.choice([1, 1, 1, 2, None]), t, r.choice([t + 1, t + 3, t + 40, t - 5, None]), 0, ""))
    df = spark.createDataFrame(rows + rows[:30], DDL)
    got = collapse_runs(df, "rec", "id", "lab", "s", "e", 3, bucket_ms=width)
    assert sorted(tuple(x) for x in got.collect()) == scan(rows, 3)


@pytest.mark.parametrize("mismatch", [0.4, 0.15, 2.0])
def test_buckets_change_nothing(spark, mismatch):
    r = random.Random(5)
    rows, t = [], 0
    for i in range(240):
        t += r.choice([0, 1, 2, 2, 9])
        rows.append((r.choice(["hot", "hot", "b"]), i, r.choice([1, 1, 1, 2, 3]), t, t + r.choice([0, 1, 3, 30]), 0, ""))
    df = spark.createDataFrame(rows, DDL)
    want = []
    for rec in ("hot", "b"):
        ev = sorted((s, i, lab, e) for name, i, lab, s, e, *_ in rows if name == rec)
        cuts = best_boundaries([x[2] for x in ev], [x[0] for x in ev], [x[3] for x in ev], 3, mismatch, 1.0)
        want += [(rec, ev[lo][1], ev[hi - 1][1], hi - lo) for lo, hi in zip(cuts, [*cuts[1:], len(ev)])]
        best = plain_programme(ev, 3, mismatch)
        assert cost([x[2] for x in ev], [x[0] for x in ev], [x[3] for x in ev], cuts, 3, mismatch, 1.0) == pytest.approx(best)
    for width in (7, 60, 10**6):
        got = collapse_runs(df, "rec", "id", "lab", "s", "e", 3, mismatch, 1.0, bucket_ms=width).collect()
        assert sorted((x.rec, x.first_id, x.last_id, x.n_events) for x in got) == sorted(want)
        by = {(x.rec, x.first_id): x.label for x in got}
        for rec, first, last, _ in want:
            labs = [lab for s, i, lab, e in sorted((s, i, lab, e) for name, i, lab, s, e, *_ in rows if name == rec)]
            ids = [i for s, i, lab, e in sorted((s, i, lab, e) for name, i, lab, s, e, *_ in rows if name == rec)]
            own = labs[ids.index(first) : ids.index(last) + 1]
            assert own.count(by[rec, first]) == max(map(own.count, own))


def plain_programme(ev, gap, mismatch):
    """The cheapest segmentation by looking at every (start, end) of a run."""
    n = len(ev)
    best = [0.0] + [float("inf")] * n
    for i in range(n):
        latest, counts = ev[i][3], {}
        for j in range(i, n):
            if ev[j][0] - latest > gap:
                break
            latest = max(latest, ev[j][3])
            counts[ev[j][2]] = counts.get(ev[j][2], 0) + 1
            best[j + 1] = min(best[j + 1], best[i] + 1.0 + mismatch * (j + 1 - i - max(counts.values())))
    return best[n]


def test_project_cases(spark):
    ddl = "merged_id bigint, rec_id string, cluster_labels int, start_times double, end_times double, loaded_at string"
    rows = [(1, "r", 5, 0.0, 1.0, "a"), (2, "r", -1, 1.1, 1.2, "a"), (3, "r", None, 1.1, 1.2, "a"), (4, "r", 5, 2.5, 3.0, "a"), (5, "r", 5, 4.501, 5.0, "a"), (6, "r", 6, 5.0, 6.0, "a"), (6, "r", 6, 5.0, 6.0, "b"), (7, "r", 6, float("nan"), 6.0, "a"), (8, "r", 6, 7.5, None, "a")]
    got = sorted((x.label, x.first_id, x.last_id, x.n_events, x.duration_ms) for x in cluster_runs(spark.createDataFrame(rows, ddl)).collect())
    assert got == [(5, 1, 4, 2, 3000), (5, 5, 5, 1, 499), (6, 6, 8, 2, 2500)]
    assert cluster_runs(spark.createDataFrame([], ddl)).count() == 0
