"""Label sequences: runs, smoothing, running ids, frames over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.ordered import carried, run_ids

#: Rows of one bucket where a sequence is ordered by an index instead of a time.
BUCKET_ROWS = 100_000


def label_runs(df: DataFrame, keys: list[str], bucket: str, order: list[str], label: str) -> DataFrame:
    """Stretches of equal labels: keys, run (from 1), label, n, first and last place. `label` must not be null."""
    rows = run_ids(df, keys, bucket, order, label, "run")
    place = F.struct(*order)
    return rows.groupBy(*keys, "run").agg(F.first(label).alias(label), F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))


def smooth_labels(df: DataFrame, keys: list[str], bucket: str, order: list[str], label: str, min_segment: int = 3, max_interjection: int = 2, substantial: int = 5) -> DataFrame:
    """Replace interjections; adds `smoothed`.

    A run shorter than `min_segment` rows and at most `max_interjection` long is an interjection if it
    lies between two runs of one other label, has at most two rows, or is shorter than a third of both
    neighbours that exceed `substantial` rows. Its rows take the last label kept before them, else the
    first kept after them; where nothing is kept, the first label of the sequence.
    """
    runs = label_runs(df, keys, bucket, order, label).withColumn("__rb", F.floor(F.col("run") / BUCKET_ROWS))
    beside = {"__p": ("lag", F.struct(label, "n")), "__q": ("lead", F.struct(label, "n"))}
    runs = carried(runs, keys, "__rb", ["run"], beside)
    p, q, n = F.col("__p"), F.col("__q"), F.col("n")
    same = F.coalesce((p[label] == q[label]) & (p[label] != F.col(label)), F.lit(False))
    between = F.coalesce((p[label] != q[label]) & (n < p["n"] / 3) & (n < q["n"] / 3) & (p["n"] > substantial) & (q["n"] > substantial), F.lit(False))
    out = (n < min_segment) & (n <= max_interjection) & (same | (n <= 2) | between)
    runs = runs.withColumn("__kept", F.when(~out, F.col(label)))
    runs = carried(runs, keys, "__rb", ["run"], {"__left": ("last", F.col("__kept")), "__right": ("next", F.col("__kept")), "__start": ("last", F.when(F.col("run") == 1, F.col(label)))})
    fill = runs.select(*keys, "run", F.coalesce("__left", "__right", "__start").alias("smoothed"))
    return run_ids(df, keys, bucket, order, label, "run").join(fill, [*keys, "run"]).drop("run")


def smoothing_report(df: DataFrame, keys: list[str], bucket: str, order: str, before: str, after: str, tolerance: int = 2, step_s: float = 0.4, brief_s: float = 1.2) -> DataFrame:
    """The runs of `before` that no run of `after` of the same label matches within `tolerance` places at both ends.

    `order` numbers the places of a sequence. Returns keys, label, first, last, n, seconds (n x step_s), brief (at
    most `brief_s`: likely an interjection). A run is offered to the places around its start, so the match is an
    equi-join; runs of one label don't overlap, so few meet.
    """
    one = lambda label: label_runs(df, keys, bucket, [order], label).select(*keys, F.col(label).alias("label"), "n", F.col("first")[order].alias("first"), F.col("last")[order].alias("last"))
    old = one(before)
    new = one(after).select(*keys, "label", F.explode(F.sequence(F.col("first") - tolerance, F.col("first") + tolerance)).alias("first"), F.col("last").alias("__to"))
    kept = old.join(new, [*keys, "label", "first"]).where(F.abs(F.col("last") - F.col("__to")) <= tolerance).select(*keys, "label", "first").distinct()
    gone = old.join(kept, [*keys, "label", "first"], "left_anti")
    return gone.select(*keys, "label", "first", "last", "n", F.round(F.col("n") * step_s, 6).alias("seconds"), (F.round(F.col("n") * step_s, 6) <= brief_s).alias("brief"))


def time_window(df: DataFrame, keys: list[str], from_ms: int, length_ms: int, tie: str) -> DataFrame:
    """The rows that start in a window of time, with their rank in it from 0 (first) to 1 (last) by start, then `tie`."""
    inside = df.where((F.col("start_ms") >= from_ms) & (F.col("start_ms") < from_ms + length_ms))
    return inside.withColumn("place", F.round(F.percent_rank().over(Window.partitionBy(*keys).orderBy("start_ms", tie)), 6))


def label_ids(df: DataFrame, label: str, order: str, prefix: str = "S") -> DataFrame:
    """Running id inside each label, `{prefix}{label}_{number from 0}`, padded to 2, 3 or 4 digits by the number of all rows.

    Numbers of a label come from its range of `order` buckets, so a frequent label is numbered in parallel.
    """
    n = df.count()
    width = 2 if n < 100 else 3 if n < 1000 else 4
    rows = df.withColumn("__b", F.floor(F.col(order) / BUCKET_ROWS)).withColumn("__l", F.coalesce(F.col(label).cast("string"), F.lit("none")))
    rows = carried(rows, ["__l"], "__b", [order], {"__k": ("sum", F.lit(1))})
    k = (F.col("__k") - 1).cast("string")
    return rows.select(*df.columns, F.concat(F.lit(prefix), "__l", F.lit("_"), F.when(F.length(k) < width, F.lpad(k, width, "0")).otherwise(k)).alias("label_id"))


def last_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int = 5) -> DataFrame:
    """Mean of the last `n` values up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("last_mean", F.avg(value).over(w))


def block_scores(df: DataFrame, keys: list[str], position: str, score: str, block: int = 512) -> DataFrame:
    """Mean and maximum of the scores in blocks of `block` positions; the last block counts as padded with zeros."""
    b = F.floor(F.col(position) / block)
    return df.groupBy(*keys, b.alias("block")).agg((F.sum(score) / block).alias("mean"), F.max(score).alias("max"))


def array_frames(samples: Column, size: int, step: int) -> Column:
    """Windows of `size` values every `step`, the last one padded with zeros."""
    n = F.size(samples)
    count = F.greatest(F.ceil((n - size) / step) + 1, F.lit(1)).cast("int")
    padded = F.concat(samples, F.array_repeat(F.lit(0.0), size + step))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(padded, k * step + 1, size)))


def delta(values: Column, n: int = 2) -> Column:
    """Slope over +-n places of an array, edges repeated."""
    size = F.size(values)
    at = lambda i: F.element_at(values, F.greatest(F.lit(1), F.least(i, size)).cast("int"))
    weight = 2 * sum(k * k for k in range(1, n + 1))

    def slope(i: Column) -> Column:
        total = F.lit(0.0)
        for k in range(1, n + 1):
            total = total + k * (at(i + k) - at(i - k))
        return total / weight

    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), slope))
