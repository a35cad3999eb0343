"""Scans over time buckets equal plain windows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.operators.ordered import bucket_of, carried, exact_quantiles, ranked, run_ids


def test_carried_and_run_ids(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i * 7 % 1000, i, r.choice([None, 1, 2, 3]), r.choice("xyx")) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint, l string").withColumn("b", bucket_of(F.col("t"), 40))
    v = F.col("v")
    got = carried(df, ["k"], "b", ["t", "id"], {"p": ("lag", v), "n": ("lead", v), "s": ("sum", v), "m": ("max_before", v), "f": ("last", v), "g": ("next", v)})
    w = Window.partitionBy("k").orderBy("t", "id")
    up, be, fo = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.max("v").over(be).alias("m"), F.last("v", True).over(up).alias("f"), F.first("v", True).over(fo).alias("g"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    runs = run_ids(df, ["k"], "b", ["t", "id"], "l", "run")
    c = F.coalesce((F.lag("l").over(w) != F.col("l")).cast("int"), F.lit(1))
    plain = df.withColumn("c", c).withColumn("run", F.sum("c").over(up)).drop("c")
    assert sorted(map(repr, runs.collect())) == sorted(map(repr, plain.select(runs.columns).collect()))


def test_ranks_of_a_hot_key(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([0.5, 1.5, 2.5, 7.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id int, v double").repartition(7)
    got = {x.id: (x.place, x.n) for x in ranked(df, ["k"], [F.col("v").desc(), F.col("id")], total="n").collect()}
    for k in ("hot", "b", None):
        mine = sorted((-v, i) for name, i, v in rows if name == k)
        assert [got[i] for _, i in mine] == [(p, len(mine)) for p in range(1, len(mine) + 1)]
    q = {x.k: x.q for x in exact_quantiles(df, ["k"], "v", [0.0, 0.3, 1.0]).collect()}
    for k in ("hot", "b", None):
        want = np.quantile([v for name, _, v in rows if name == k], [0.0, 0.3, 1.0])
        assert np.allclose(q[k], want)
    assert ranked(df.limit(0), [], [F.col("id")]).count() == 0
    assert exact_quantiles(df, [], "v", [0.5]).first().q[0] == np.median([v for _, _, v in rows])
