"""Smoothing, frames over arrays, codec and time texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import scalars as S
from voxloom.operators import sequences as Q


def reference_smooth(labels, min_segment=3, most=2):
    runs, out = [], []
    for x in labels:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    keep = [n >= min_segment or n > most for _, n in runs]
    last = None
    for k, (x, n) in enumerate(runs):
        if keep[k]:
            last = x
        nxt = next((runs[j][0] for j in range(k, len(runs)) if keep[j]), None)
        out += [last or nxt or runs[0][0]] * n
    return out


def test_smoothing_sample(spark):
    a, b, c = "Alice", "Bob", "Charlie"
    seq = [a] * 3 + [b] + [a] * 4 + [c] * 4 + [a] + [c] * 2 + [b] * 5 + [a] + [b] * 3
    rows = [("r", i, x) for i, x in enumerate(seq)] + [("s", i, x) for i, x in enumerate([a, b, a])]
    df = spark.createDataFrame(rows, "rec_id string, t bigint, l string").withColumn("b", F.floor(F.col("t") / 5))
    got = Q.smooth_labels(df, ["rec_id"], "b", ["t"], "l", 4).orderBy("rec_id", "t").collect()
    assert [r.smoothed for r in got if r.rec_id == "r"] == [a] * 8 + [c] * 7 + [b] * 9
    assert [r.smoothed for r in got if r.rec_id == "s"] == [a] * 3
    assert reference_smooth(seq, 4) == [r.smoothed for r in got if r.rec_id == "r"]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(Q.array_frames(F.col("x"), 3, 2)).collect()]
    assert got == [[[1, 2, 3], [3, 4, 5]], None, None]
    d = df.select(Q.delta(F.col("x"), 1)).first()[0]
    assert d == [0.5, 1.0, 1.0, 1.0, 0.5]


def test_codec_and_clock(spark):
    df = spark.createDataFrame([("a/room_b_v1_1.50_2.75_0.93.wav",), ("short.wav",), (None,)], "p string")
    f = S.parse_chunk_name(F.col("p"))
    got = [tuple(r) for r in df.select(*[f[k].alias(k) for k in f]).collect()]
    assert got == [("room_b", "v1", 1500, 2750, 0.93), (None,) * 5, (None,) * 5]
    one = spark.createDataFrame([(3_723_456,)], "ms bigint").select(S.clock(F.col("ms")).alias("c"), S.chunk_name(F.lit("r"), F.lit("s"), F.col("ms"), F.lit(5)).alias("n"))
    assert tuple(one.first()) == ("01:02:03.45", "r_s_3723.45_0.00")
    back = one.select(S.parse_clock(F.col("c")).alias("a"), S.parse_clock(F.col("n")).alias("b")).first()
    assert tuple(back) == (3_723_450, None)


def test_curves(spark):
    k = spark.createDataFrame([(0.0, 499), (6.0, 500), (12.0, 1000), (3.0, 1001)], "k double, n int")
    got = [tuple(r) for r in k.select(F.round(S.cluster_count_score(F.col("k")), 3), S.min_cluster_size(F.col("n"))).collect()]
    assert got == [(0.0, 5), (1.0, 12), (0.861, 12), (0.812, 25)]


def test_label_ids_are_dense(spark):
    df = spark.createDataFrame([(i * 60_000, ["x", "y", None][i % 3]) for i in range(30)], "id bigint, l string")
    got = sorted(r.label_id for r in Q.label_ids(df, "l", "id").collect())
    assert got == sorted(f"S{x}_{n:02d}" for x in ("x", "y", "none") for n in range(10))
