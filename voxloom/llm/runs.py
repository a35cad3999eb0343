"""Repeated consecutive events as runs with count and duration (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery, internal, to_ms
from voxloom.operators.ordered import BUCKET_MS, bucket_of

INF = float("inf")
#: Costs are counted in whole millionths, so that equal costs compare equal however a sequence is cut.
UNIT = 1_000_000

#: A live run: its label (None while it may still become any label not met so far), latest end, cost of everything up to
#: here, and where it began: (index of its first event, (that place of the run before it, label of that run)), or
#: (-1 - k, None) for the k-th run handed over from the bucket before.
State = tuple[int | None, int, int, tuple]


def advance(states: list[State], j: int, label: int, start: int, end: int, max_gap: int, mismatch: int | None, penalty: int) -> list[State]:
    """One step of the programme: the live runs after event j, oldest first.

    Runs that the event can join go on, at the price of `mismatch` where the label differs (None: they end); a new run
    opens behind the cheapest one. A run is dropped once another of its label, or one still open to any label, costs no
    more and reaches as far: whatever follows, the other one is at least as good. Of equals the oldest stays.
    """
    grown: list[State] = []
    base, before = 0, None
    if states:
        cheapest = min(states, key=lambda s: s[2])
        base, before = cheapest[2], (cheapest[3], cheapest[0])
    for own, latest, cost, place in states:
        if start - latest > max_gap:
            continue
        latest = end if end > latest else latest
        if own == label:
            grown.append((own, latest, cost, place))
        elif own is None:
            grown.append((label, latest, cost, place))
            grown.append((None, latest, cost + mismatch, place))
        elif mismatch is not None:
            grown.append((own, latest, cost + mismatch, place))
    place = (j, before)
    grown.append((label, end, base + penalty, place))
    if mismatch is not None:
        grown.append((None, end, base + penalty + mismatch, place))
    if len(grown) == 1:
        return grown
    kept: list[State] = []
    for state in grown:
        own, latest, cost, _ = state
        if any((o == own or o is None) and c <= cost and at >= latest for o, at, c, _ in kept):
            continue
        if kept:
            kept = [k for k in kept if not ((own == k[0] or own is None) and cost < k[2] and latest >= k[1])]
        kept.append(state)
    return kept


def live_runs(labels: list[int], starts: list[int], ends: list[int], incoming: list[tuple], max_gap: int, mismatch: int | None, penalty: int) -> list[State]:
    """The live runs after the last event of a bucket, from those handed over by the bucket before (none at the beginning)."""
    states: list[State] = [(label, latest, cost, (-1 - k, None)) for k, (label, latest, cost) in enumerate(incoming)]
    for j, (label, start, end) in enumerate(zip(labels, starts, ends, strict=True)):
        states = advance(states, j, label, start, end, max_gap, mismatch, penalty)
    return states


def traced(state: State) -> tuple[list[tuple[int, bool, int | None]], int]:
    """The runs that lead to a live run, in order: (first event in this bucket, whether it opens there, label); and the
    number of the handed-over run they begin with, -1 if none."""
    out, label, place = [], state[0], state[3]
    while True:
        if place[0] < 0:
            if not out or out[-1][0] > 0:
                out.append((0, False, label))
            return out[::-1], -1 - place[0]
        out.append((place[0], True, label))
        if place[1] is None:
            return out[::-1], -1
        place, label = place[1]


def best_boundaries(labels, starts, ends, max_gap: int, mismatch: float = INF, penalty: float = 1.0) -> list[int]:
    """Optimal segmentation of one ordered sequence held in memory; gives the first index of every run.

    Minimises the sum over runs of `penalty` and of `mismatch` for every event whose label differs from the label of
    its run (the one that costs least). An event that starts more than `max_gap` after the latest end in the run so far
    cannot join it. Of equally good segmentations the one whose runs reach back furthest, from the last run on.
    """
    m, p = None if mismatch == INF else round(mismatch * UNIT), round(penalty * UNIT)
    states = live_runs(list(labels), list(starts), [max(s, e) for s, e in zip(starts, ends, strict=True)], [], max_gap, m, p)
    return [at for at, _, _ in traced(min(states, key=lambda s: s[2]))[0]] if states else []


def collapse_runs(
    df: DataFrame, entity: str, event_id: str, label: str, start_ms: str, end_ms: str, max_gap_ms: int,
    mismatch: float = INF, penalty: float = 1.0, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Collapse the runs of each entity's events, ordered by start and id, into one event each.

    The runs are those of `best_boundaries` for the whole sequence of the entity: with a finite `mismatch` near-identical
    events share a run as long as that is cheaper than a boundary, infinite (the default) only equal ones. The programme
    works on (entity, time bucket), so hot entities spread: every bucket starts from the live runs that the bucket before
    hands over, first from none, and again wherever what it is handed has changed, until nothing changes. That is the
    result of one pass along the sequence, whatever `bucket_ms`; runs seldom reach over many buckets, so a few rounds do.
    Then the best chain is followed back over one row for each bucket, and each bucket cuts its runs out.

    Returns entity, label (that of the run), first_id, last_id, n_events, start_ms, end_ms (latest end), duration_ms.
    Rows with a null entity, id, label or start are passed over; a null end counts as the start; repeated rows count
    once; an empty table gives no rows; other columns are dropped.
    """
    if mismatch <= 0 or penalty <= 0:
        raise ValueError("mismatch and penalty must be positive")
    m, p = None if mismatch == INF else round(mismatch * UNIT), round(penalty * UNIT)
    rows = internal(df, entity=F.col(f"`{entity}`").cast("string"), id=F.col(f"`{event_id}`").cast("bigint"), label=F.col(f"`{label}`").cast("bigint"), s=F.col(f"`{start_ms}`").cast("bigint"), e=F.col(f"`{end_ms}`").cast("bigint"))
    rows = rows.dropna(subset=["entity", "id", "label", "s"]).withColumn("e", F.greatest("s", F.coalesce("e", "s"))).withColumn("b", bucket_of(F.col("s"), bucket_ms))
    pieces = checkpoint(rows.groupBy("entity", "b").agg(F.array_sort(F.collect_set(F.struct("s", "id", "label", "e"))).alias("ev")))

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Row number, labels, starts, ends, ids and handed-over runs of every bucket of a batch."""
        ev, size = batch.column("ev"), np.diff(batch.column("ev").offsets.to_numpy())
        flat = ev.flatten()
        at = np.concatenate([[0], np.cumsum(size)])
        label_, s, e, ids = (flat.field(c).to_numpy().tolist() for c in ("label", "s", "e", "id"))
        given = batch.column("inc").to_pylist() if "inc" in batch.schema.names else [None] * batch.num_rows
        for r in range(batch.num_rows):
            lo, hi = at[r], at[r + 1]
            yield r, label_[lo:hi], s[lo:hi], e[lo:hi], ids[lo:hi], [(g["label"], g["latest"], g["cost"]) for g in given[r] or ()]

    run_type = "array<struct<label:bigint,latest:bigint,cost:bigint>>"
    shape = pa.list_(pa.struct([("label", pa.int64()), ("latest", pa.int64()), ("cost", pa.int64())]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, came, opened = [], [], []
            for _, lab, s, e, _, given in unpacked(batch):
                states = live_runs(lab, s, e, given, max_gap_ms, m, p)
                low = min(x[2] for x in states)
                out.append([{"label": x[0], "latest": x[1], "cost": x[2] - low} for x in states])
                chains = [traced(x) for x in states]
                came.append([c for _, c in chains])
                opened.append([sum(o for _, o, _ in chain) for chain, _ in chains])
            given = batch.column("inc") if "inc" in batch.schema.names else pa.nulls(batch.num_rows, shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity"), batch.column("b"), given, pa.array(out, shape), pa.array(came, pa.list_(pa.int32())), pa.array(opened, pa.list_(pa.int32()))], names=["entity", "b", "inc", "out", "came", "opened"]
            )

    solved = f"entity string, b bigint, inc {run_type}, out {run_type}, came array<int>, opened array<int>"
    known = checkpoint(pieces.mapInArrow(solve, solved))
    while True:
        handed = known.withColumn("now", F.lag("out").over(Window.partitionBy("entity").orderBy("b")))
        stale = handed.where(~F.col("now").eqNullSafe(F.col("inc"))).select("entity", "b", F.col("now").alias("inc"))
        fresh = checkpoint(pieces.join(stale, ["entity", "b"]).mapInArrow(solve, solved))
        if fresh.isEmpty():
            break
        known = checkpoint(known.join(fresh.select("entity", "b"), ["entity", "b"], "left_anti").unionByName(fresh))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, after = None, 0, 0
        for batch in batches:
            ks, afters = [], []
            for name, came, opened, out in zip(*(batch.column(c).to_pylist() for c in ("entity", "came", "opened", "out")), strict=True):
                if name != now:  # the last bucket of the entity: its cheapest run, of equals the oldest
                    now, k, after = name, min(range(len(out)), key=lambda i: out[i]["cost"]), 0
                ks.append(k)
                afters.append(after)
                k, after = came[k], after + opened[k]
            yield pa.RecordBatch.from_arrays([batch.column("entity"), batch.column("b"), batch.column("inc"), pa.array(ks, pa.int32()), pa.array(afters, pa.int64())], names=["entity", "b", "inc", "k", "after"])

    back = known.repartition("entity").sortWithinPartitions("entity", F.desc("b")).mapInArrow(follow, f"entity string, b bigint, inc {run_type}, k int, after bigint")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, afters = batch.column("k").to_pylist(), batch.column("after").to_pylist()
            got = []
            for r, lab, s, e, ids, given in unpacked(batch):
                chain, _ = traced(live_runs(lab, s, e, given, max_gap_ms, m, p)[ks[r]])
                for i, (lo, _, own) in enumerate(chain):
                    hi = chain[i + 1][0] if i + 1 < len(chain) else len(ids)
                    got.append((r, afters[r] + sum(o for _, o, _ in chain[i + 1 :]), own, ids[lo], ids[hi - 1], hi - lo, s[lo], s[hi - 1], max(e[lo:hi])))
            cols = list(zip(*got, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column("entity").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["entity", "run", "label", "first_id", "last_id", "n", "s", "last_s", "e"])

    parts = pieces.join(back, ["entity", "b"]).mapInArrow(cut, "entity string, run bigint, label bigint, first_id bigint, last_id bigint, n bigint, s bigint, last_s bigint, e bigint")
    return parts.groupBy("entity", "run").agg(
        F.max("label").alias("label"), F.min_by("first_id", F.struct("s", "first_id")).alias("first_id"), F.max_by("last_id", F.struct("last_s", "last_id")).alias("last_id"),
        F.sum("n").alias("n_events"), F.min("s").alias("start_ms"), F.max("e").alias("end_ms"),
    ).select(F.col("entity").alias(entity), "label", "first_id", "last_id", "n_events", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def cluster_runs(merged: DataFrame, max_gap_ms: int = 1500, mismatch: float = INF, penalty: float = 1.0) -> DataFrame:
    """The runs of merged_samples per recording; labels -1 and null are passed over, first deliveries count."""
    m = first_delivery(merged.select("merged_id", "rec_id", "cluster_labels", "start_times", "end_times", "loaded_at"), "merged_id")
    label: Column = F.when(F.col("cluster_labels") != -1, F.col("cluster_labels"))
    m = m.select("rec_id", "merged_id", label.alias("label"), to_ms(F.col("start_times")).alias("s"), to_ms(F.col("end_times")).alias("e"))
    return collapse_runs(m, "rec_id", "merged_id", "label", "s", "e", max_gap_ms, mismatch, penalty)
