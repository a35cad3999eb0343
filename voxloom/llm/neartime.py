"""Matching records of two tables by nearest time (problem 3): tick expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.common import first_delivery, internal, to_ms

#: Width of a tick in milliseconds.
TICK_MS = 100


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_id: str, right_id: str,
    left_ms: str, right_ms: str, tolerance_ms: int, tick_ms: int = TICK_MS,
) -> DataFrame:
    """Give every left row the right row of the same entity nearest in time, at most `tolerance_ms` away.

    Tick expansion: each right row is exploded to every tick that lies within the tolerance. Of an
    (entity, tick) the nearest row before the tick, the nearest after it and the instants inside it are
    kept - at most `tick_ms` + 2 candidates whatever the number of rows - and left rows join their own
    tick by equality. The choice inside the tick compares exact distances, so the result doesn't depend
    on the tick width, which only weighs the copies of a right row against the candidates of a tick.

    Returns the left keys, `left_id`, `right_id` and `distance_ms`; left rows without partner are left
    out. Of equally near rows the earlier one wins, then the smaller id. Rows with a null id, key or
    time are ignored; repeated rows give one result row; other columns are dropped; an empty table on
    either side gives no rows. Ids must be of an orderable type.
    """
    k = [f"k{i}" for i in range(len(left_keys))]
    lf = internal(left, **dict(zip(k, left_keys, strict=True)), lid=left_id, x=F.col(f"`{left_ms}`").cast("bigint")).dropna().distinct()
    rt = internal(right, **dict(zip(k, right_keys, strict=True)), rid=right_id, s=F.col(f"`{right_ms}`").cast("bigint")).dropna()
    rt = rt.groupBy(*k, "s").agg(F.min("rid").alias("rid"))
    tick = lambda c: F.floor(c / F.lit(tick_ms)).cast("bigint")
    spread = rt.withColumn("tick", F.explode(F.sequence(tick(F.col("s") - tolerance_ms), tick(F.col("s") + tolerance_ms))))
    own, cand = tick(F.col("s")), F.struct("s", "rid")
    ticks = spread.groupBy(*k, "tick").agg(
        F.max(F.when(own < F.col("tick"), cand)).alias("before"),
        F.min(F.when(own > F.col("tick"), cand)).alias("after"),
        F.collect_list(F.when(own == F.col("tick"), cand)).alias("inside"),
    )
    all_of = F.filter(F.concat(F.array("before", "after"), "inside"), lambda c: c.isNotNull())
    lf = lf.withColumn("tick", tick(F.col("x")))
    hits = lf.join(ticks, [*k, "tick"]).withColumn(
        "best", F.array_min(F.transform(all_of, lambda c: F.struct(F.abs(c["s"] - F.col("x")).alias("d"), c["s"].alias("s"), c["rid"].alias("rid"))))
    )
    return hits.where(F.col("best.d") <= tolerance_ms).select(
        *[F.col(a).alias(b) for a, b in zip(k, left_keys, strict=True)], F.col("lid").alias(left_id), F.col("best.rid").alias(right_id), F.col("best.d").alias("distance_ms")
    )


def edits_to_azure(edits: DataFrame, azure: DataFrame, tolerance_ms: int = 400) -> DataFrame:
    """The azure_diarization row nearest to each human edit: rec_id, edit_id, az_id, distance_ms.

    First deliveries count; edits without a start time and Azure rows lacking one of their times take no part.
    """
    e = first_delivery(edits.select("edit_id", "rec_id", "starttime", "loaded_at"), "edit_id")
    a = first_delivery(azure.select("az_id", "rec_id", "start_time", "end_time", "loaded_at"), "az_id")
    e = e.select("edit_id", "rec_id", to_ms(F.col("starttime")).alias("x"))
    a = a.where(to_ms(F.col("end_time")).isNotNull()).select("az_id", "rec_id", to_ms(F.col("start_time")).alias("s"))
    return nearest_in_time(e, a, ["rec_id"], ["rec_id"], "edit_id", "az_id", "x", "s", tolerance_ms)
