"""Streaming counterparts: hopping counts, sessions and runs over a live feed of events (beyond the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping_counts(events: DataFrame, time: str, key: str, length: str = "1 second", step: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """W1 on a stream: events of each key in hopping windows; later than `late` drops out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length, step), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def live_sessions(events: DataFrame, time: str, key: str, gap: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """W2 on a stream, by running maximum: sessions of each key that end after a gap."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def live_runs(events: DataFrame, time: str, key: str, label: str, late: str = "1 minute") -> DataFrame:
    """W4 on a stream: runs of equal labels of each key, emitted when the next label arrives or the watermark passes the run by `late`.

    The state of a key is its open run only: label, count, first and last time.
    """
    state = "label string, n bigint, first timestamp, last timestamp"
    out = f"{key} string, label string, n bigint, first timestamp, last timestamp"

    def step(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        now = list(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(group[0], *now)], columns=[key, "label", "n", "first", "last"])
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values([time, label])
        for at, what in zip(rows[time], rows[label], strict=True):
            if now and now[0] == what:
                now[1], now[3] = now[1] + 1, max(now[3], at)
            else:
                done += [(group[0], *now)] if now else []
                now = [what, 1, at, at]
        held.update(tuple(now))
        held.setTimeoutTimestamp(max(int(now[3].timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(done, columns=[key, "label", "n", "first", "last"])

    src = events.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), F.col(label).cast("string").alias(label)).dropna()
    return src.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
