"""Ordered scans (lag, lead, running sum and maximum) that no hot key can overload.

A window over one key is one task. These scans work on (key, time bucket): rows are ordered within a
bucket only, and what a bucket inherits from those before it comes from one row per bucket. A key that
holds a third of all rows is so spread over all executors; one task holds the rows of one bucket, or
one row per bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint

#: Width of a time bucket in milliseconds (10 minutes).
BUCKET_MS = 600_000


def bucket_of(ms: Column, width: int = BUCKET_MS) -> Column:
    return F.floor(ms / F.lit(width)).cast("bigint")


def carried(df: DataFrame, keys: list[str], bucket: str, order: list[str], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns that look along the whole key, in the order of (bucket, order columns).

    `specs` maps an output name to (kind, expression); kinds: `lag`, `lead` (one row; null where there
    is none), `sum` (running, with this row), `max_before` (running maximum of the rows before this one),
    `last` and `next` (the nearest value that isn't null, of this row and those before, or after).
    The key columns must not be null; the order columns must rise with the bucket and make a total order.
    """
    at = [F.col(c) for c in order]
    w = Window.partitionBy(*keys, bucket).orderBy(*at)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local, per_bucket, inherit = [], [], []
    wb = Window.partitionBy(*keys).orderBy(bucket)
    past = wb.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*at)
    for out, (kind, expr) in specs.items():
        if kind == "lag":
            local.append(F.lag(F.struct(expr.alias("v"))).over(w).alias(f"__l_{out}"))
            per_bucket.append(F.max_by(F.struct(expr.alias("v")), place).alias(f"__b_{out}"))
            inherit.append(F.lag(f"__b_{out}").over(wb).alias(f"__i_{out}"))
        elif kind == "lead":
            local.append(F.lead(F.struct(expr.alias("v"))).over(w).alias(f"__l_{out}"))
            per_bucket.append(F.min_by(F.struct(expr.alias("v")), place).alias(f"__b_{out}"))
            inherit.append(F.lead(f"__b_{out}").over(wb).alias(f"__i_{out}"))
        elif kind == "sum":
            local.append(F.sum(expr).over(upto).alias(f"__l_{out}"))
            per_bucket.append(F.sum(expr).alias(f"__b_{out}"))
            inherit.append(F.sum(f"__b_{out}").over(past).alias(f"__i_{out}"))
        elif kind == "max_before":
            local.append(F.max(expr).over(before).alias(f"__l_{out}"))
            per_bucket.append(F.max(expr).alias(f"__b_{out}"))
            inherit.append(F.max(f"__b_{out}").over(past).alias(f"__i_{out}"))
        elif kind in ("last", "next"):
            pick, side = (F.last, upto) if kind == "last" else (F.first, w.rowsBetween(0, Window.unboundedFollowing))
            local.append(pick(expr, ignorenulls=True).over(side).alias(f"__l_{out}"))
            held = F.when(expr.isNotNull(), F.struct(place.alias("at"), expr.alias("v")))
            per_bucket.append((F.max(held) if kind == "last" else F.min(held))["v"].alias(f"__b_{out}"))
            beyond = past if kind == "last" else wb.rowsBetween(1, Window.unboundedFollowing)
            inherit.append(pick(f"__b_{out}", ignorenulls=True).over(beyond).alias(f"__i_{out}"))
        else:
            raise ValueError(f"unknown kind {kind!r}")
    rows = df.select("*", *local)
    heads = df.groupBy(*keys, bucket).agg(*per_bucket).select(*keys, bucket, *inherit)
    both = rows.join(heads, [*keys, bucket])
    done = []
    for out, (kind, _) in specs.items():
        mine, theirs = F.col(f"__l_{out}"), F.col(f"__i_{out}")
        if kind in ("lag", "lead"):
            done.append(F.coalesce(mine, theirs)["v"].alias(out))
        elif kind in ("last", "next"):
            done.append(F.coalesce(mine, theirs).alias(out))
        elif kind == "sum":
            done.append((F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))).alias(out))
        else:
            done.append(F.greatest(mine, theirs).alias(out))
    return both.select(*df.columns, *done)


def run_ids(df: DataFrame, keys: list[str], bucket: str, order: list[str], label: str, out: str) -> DataFrame:
    """Number the stretches of equal `label` along each key (1, 2, ...), in one pass.

    The change at the head of a bucket is settled between bucket rows, so a run may span any number
    of buckets. `label` must not be null.
    """
    at = [F.col(c) for c in order]
    w = Window.partitionBy(*keys, bucket).orderBy(*at)
    change = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0))
    rows = df.withColumn("__change", change)
    rows = rows.withColumn("__local", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*at)
    heads = rows.groupBy(*keys, bucket).agg(
        F.min_by(label, place).alias("__first"), F.max_by(label, place).alias("__last"), F.sum("__change").alias("__n")
    )
    wb = Window.partitionBy(*keys).orderBy(bucket)
    heads = heads.withColumn("__new", F.coalesce((F.lag("__last").over(wb) != F.col("__first")).cast("int"), F.lit(1)))
    heads = heads.select(
        *keys, bucket,
        (F.coalesce(F.sum(F.col("__n") + F.col("__new")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__new")).alias("__base"),
    )
    return rows.join(heads, [*keys, bucket]).select(*df.columns, (F.col("__base") + F.col("__local")).alias(out))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "place", total: str | None = None) -> DataFrame:
    """Number the rows of each key from 1 in the given order (a total order), with the rows of the key as `total`.

    Rows are cut into ranges of (keys, order); a row's number is its place in its range plus what the ranges before hold of
    its key, so a key of any size is numbered in parallel. Keys may be null; no keys number the whole table.
    """
    rows = checkpoint(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))
    along = Window.partitionBy(*keys).orderBy("__p")
    sizes = rows.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    sizes = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), (F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.withColumn("__l", local).join(sizes, same)
    return joined.select(*df.columns, (F.col("__l") + F.col("__before")).alias(out), *([F.col("__all").alias(total)] if total else []))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Quantiles of `value` (no nulls, no NaN) by key, linearly interpolated between places: keys, q (array in the order of `shares`).
    From places in `ranked` order, so neither a key nor the table gathers its values."""
    rows = ranked(df.select(*keys, F.col(value).alias("__v")).withColumn("__t", F.monotonically_increasing_id()), keys, [F.col("__v"), F.col("__t")], "__r", "__m")
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("__m") - 1) * F.lit(share)
        low = F.floor(at) + 1
        picks += [F.max(F.when(F.col("__r") == low, F.col("__v"))).alias(f"__a{i}"), F.max(F.when(F.col("__r") == low + 1, F.col("__v"))).alias(f"__b{i}"), F.max(at - F.floor(at)).alias(f"__f{i}")]
    got = rows.groupBy(*keys).agg(*picks)
    mix = [F.col(f"__a{i}") + F.when(F.col(f"__f{i}") > 0, F.col(f"__f{i}") * (F.col(f"__b{i}") - F.col(f"__a{i}"))).otherwise(0.0) for i in range(len(shares))]
    return got.select(*keys, F.array(*mix).alias("q"))
