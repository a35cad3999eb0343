"""Optimal speaker mapping (X9): assignment of maximum overlap per recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_max(gain: np.ndarray) -> list[int]:
    """Column of each row so that the summed gain is largest (-1 for rows beyond the columns).

    Shortest augmenting paths with potentials, one row at a time, on the negated gains.
    """
    n, m = gain.shape
    size = max(n, m)
    cost = np.zeros((size, size))
    cost[:n, :m] = -gain
    pot_r, pot_c = np.zeros(size), np.zeros(size)
    owner = np.full(size, -1)
    for r in range(size):
        dist, via, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        row, last = r, -1
        while True:
            reduced = cost[row] - pot_r[row] - pot_c + (dist[last] if last >= 0 else 0.0)
            better = ~done & (reduced < dist)
            dist[better], via[better] = reduced[better], last
            last = int(np.argmin(np.where(done, np.inf, dist)))
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
        span = dist[last]
        pot_r[r] += span
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                pot_r[owner[c]] += span - dist[c]
            pot_c[c] -= span - dist[c]
        while last >= 0:
            before = int(via[last])
            owner[last] = r if before < 0 else owner[before]
            last = before
    out = [-1] * n
    for c in range(m):
        if owner[c] < n:
            out[owner[c]] = c
    return out


def map_speakers(matrix: DataFrame, key: str = "rec_id") -> DataFrame:
    """Map system labels to truth labels one to one with the largest total overlap: key, sys_label, gt_label, overlap_ms.

    `matrix` has one row for each pair of labels that overlap, so a group is a recording's label pairs, never its
    rows. Pairs without overlap are not returned; their labels stay unmapped.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf.sys_label.unique()), sorted(pdf.gt_label.unique())
        gain = np.zeros((len(rows), len(cols)))
        gain[[rows.index(x) for x in pdf.sys_label], [cols.index(x) for x in pdf.gt_label]] = pdf.overlap_ms
        got = [(rows[i], cols[j], int(gain[i, j])) for i, j in enumerate(assign_max(gain)) if j >= 0 and gain[i, j] > 0]
        return pd.DataFrame({key: pdf[key].iloc[0], "sys_label": [g[0] for g in got], "gt_label": [g[1] for g in got], "overlap_ms": [g[2] for g in got]})

    return matrix.select(key, "sys_label", "gt_label", F.col("overlap_ms").cast("bigint")).groupBy(key).applyInPandas(solve, f"{key} string, sys_label string, gt_label string, overlap_ms bigint")
