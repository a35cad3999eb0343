"""Overlapping and gapped intervals: continuous periods and the gaps between them (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint, clean_label, first_delivery, internal, is_sentinel, to_ms
from voxloom.operators.ordered import BUCKET_MS, bucket_of, carried


def sweep_periods(df: DataFrame, keys: list[str], start: str, end: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Sweep line over whole numbers: covered periods and zero-count gaps of every key.

    Each interval becomes a plus and a minus event; events of one instant are added up before the
    shuffle, so a bucket holds at most `bucket_ms` instants of a key however many rows it has. The
    prefix sum counts the active intervals; where it leaves zero a period begins, where it returns to
    zero a gap begins that lasts to the next event. Intervals that touch belong to one period.

    Returns the keys, `kind` (`covered` or `gap`), `start_ms`, `end_ms`. Rows with a null key or time,
    and rows whose end is not after their start, are ignored; repeated rows change nothing; an empty
    table gives no rows; other columns are dropped.
    """
    k = [f"k{i}" for i in range(len(keys))]
    src = internal(df, **dict(zip(k, keys, strict=True)), s=F.col(f"`{start}`").cast("bigint"), e=F.col(f"`{end}`").cast("bigint"))
    src = src.where(F.col("e") > F.col("s")).dropna(subset=k)
    events = src.select(*k, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("v"))
    events = events.groupBy(*k, F.col("v.t").alias("t")).agg(F.sum("v.d").alias("d")).where("d <> 0").withColumn("b", bucket_of(F.col("t"), bucket_ms))
    events = checkpoint(events)  # three branches read them
    counted = carried(events, k, "b", ["t"], {"active": ("sum", F.col("d"))})
    edges = counted.where((F.col("active") == 0) | (F.col("active") == F.col("d"))).select(*k, "t", "b", (F.col("active") > 0).alias("opens"))
    paired = carried(edges, k, "b", ["t"], {"next": ("lead", F.col("t"))}).where("next is not null")
    return paired.select(
        *[F.col(a).alias(b) for a, b in zip(k, keys, strict=True)],
        F.when(F.col("opens"), "covered").otherwise("gap").alias("kind"),
        F.col("t").alias("start_ms"), F.col("next").alias("end_ms"),
    )


def speaking_intervals(gt: DataFrame) -> DataFrame:
    """The intervals of gt_segments that count: first deliveries with label and times, in milliseconds.

    Labels are cleaned (`clean_label`); sentinels, missing labels, null or NaN times and ends not
    after the start drop out. Columns: seg_id, rec_id, speaker_label, start_ms, end_ms.
    """
    # cleaned before the first deliveries are told apart: conditions on the result then wait above that window, and labels are cleaned once
    rows = gt.select("seg_id", "rec_id", clean_label(F.col("speaker_label")).alias("speaker_label"), to_ms(F.col("start_time")).alias("start_ms"), to_ms(F.col("end_time")).alias("end_ms"), "loaded_at")
    rows = first_delivery(rows, "seg_id").drop("loaded_at")
    return rows.where("rec_id is not null and speaker_label is not null and end_ms > start_ms").where(~is_sentinel(F.col("speaker_label")))


def speaking_periods(gt: DataFrame) -> DataFrame:
    """Continuous speaking periods and gaps of every speaker of every recording (see `sweep_periods`)."""
    return sweep_periods(speaking_intervals(gt), ["rec_id", "speaker_label"], "start_ms", "end_ms")
