"""Interval operators: sliding chunks, gap merge, overlap joins, frames, human edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.scalars import overlap_ms, overlap_pct
from voxloom.operators.ordered import bucket_of, carried, ranked

#: Width of the time cells of interval joins in milliseconds.
CELL_MS = 60_000


def sliding_chunks(df: DataFrame, start: str = "start_ms", stop: str = "stop_ms", length: int = 1000, step: int = 200, slack: int = 100) -> DataFrame:
    """Windows `[t, min(t + length, stop)]` every `step` while at least `length - slack` is left.

    Adds chunk_no, chunk_start, chunk_stop; intervals shorter than `length - slack` and null times give none.
    """
    least = length - slack
    room = F.col(stop) - F.col(start) - least
    rows = df.where(room >= 0)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(room / step))))
    at = F.col(start) + F.col("chunk_no") * step
    return rows.withColumn("chunk_start", at).withColumn("chunk_stop", F.least(at + length, F.col(stop)))


def gap_islands(df: DataFrame, keys: list[str], start: str, stop: str, tie: str, gap: int) -> DataFrame:
    """Number the islands of each key: a row opens one if it starts more than `gap` after the stop of
    the row before it (not the running maximum). Adds `island`; hot keys spread over time buckets."""
    rows = df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).dropna(subset=keys).withColumn("__b", bucket_of(F.col(start)))
    rows = carried(rows, keys, "__b", [start, tie], {"__prev": ("lag", F.col(stop))})
    rows = rows.withColumn("__open", F.coalesce((F.col(start) - F.col("__prev") > gap).cast("bigint"), F.lit(1).cast("bigint")))
    return carried(rows, keys, "__b", [start, tie], {"island": ("sum", F.col("__open"))}).drop("__b", "__prev", "__open")


def gap_merge(df: DataFrame, keys: list[str], start: str, stop: str, tie: str, gap: int = 200, min_rows: int = 1) -> DataFrame:
    """One row for each island: keys, start_ms (first start), stop_ms (stop of its last row), n."""
    place = F.struct(start, tie)
    got = gap_islands(df, keys, start, stop, tie, gap).groupBy(*keys, "island").agg(F.min(start).alias("start_ms"), F.max_by(stop, place).alias("stop_ms"), F.count("*").alias("n"))
    return got.where(F.col("n") >= min_rows).drop("island")


def smallest_mode(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """A3: most frequent value of each key, ties to the smallest; null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))["v"].alias(out))


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, collar: int = 0, cell: int = CELL_MS) -> DataFrame:
    """Pairs of rows of equal keys with `re > ls - collar` and `rs < le + collar`.

    Both sides are exploded to the time cells they touch and join on (keys, cell); a pair is kept in the
    later one of the two first cells, so it comes once and no distinct is needed. A hot key is so
    spread over its cells. Other column names of the two sides must differ.
    """
    spread = lambda df, a, b: df.withColumn("__first", F.floor(a / cell)).withColumn("__cell", F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell))))
    lf = spread(left.where(F.col(le) >= F.col(ls)), F.col(ls) - collar, F.col(le) + collar).withColumnRenamed("__first", "__lf")
    rt = spread(right.where(F.col(re) >= F.col(rs)), F.col(rs), F.col(re)).withColumnRenamed("__first", "__rf")
    both = lf.join(rt, [*keys, "__cell"])
    keep = (F.col("__cell") == F.greatest("__lf", "__rf")) & (F.col(re) > F.col(ls) - collar) & (F.col(rs) < F.col(le) + collar)
    return both.where(keep).drop("__cell", "__lf", "__rf")


def best_overlap(pred: DataFrame, gt: DataFrame, pred_id: str, keys: list[str], label: str = "speaker_label", unknown: str = "UNKNOWN") -> DataFrame:
    """Each prediction (start_ms, end_ms) with the label it overlaps longest.

    Adds matched, overlap_ms, overlap_pct. No overlap gives `unknown` and 0; equally long overlaps go to
    the ground-truth row that starts first, then to the smaller label.
    """
    g = gt.select(*keys, F.col("start_ms").alias("g_s"), F.col("end_ms").alias("g_e"), F.col(label).alias("g_label"))
    pairs = interval_pairs(pred.select(pred_id, *keys, "start_ms", "end_ms"), g, keys, "start_ms", "end_ms", "g_s", "g_e")
    pairs = pairs.withColumn("ov", overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("g_s"), F.col("g_e"))).where("ov > 0")
    best = pairs.groupBy(pred_id).agg(F.min(F.struct((-F.col("ov")).alias("neg"), "g_s", "g_label")).alias("b"))
    rows = pred.join(best, pred_id, "left")
    ov = F.coalesce(-F.col("b.neg"), F.lit(0).cast("bigint"))
    return rows.select(*pred.columns, F.coalesce("b.g_label", F.lit(unknown)).alias("matched"), ov.alias("overlap_ms"), F.round(F.when(F.col("end_ms") > F.col("start_ms"), ov / (F.col("end_ms") - F.col("start_ms")) * 100).otherwise(0.0), 6).alias("overlap_pct"))


def label_chunks(chunks: DataFrame, gt: DataFrame, chunk_id: str, keys: list[str], least: float = 0.8, margin: float = 0.1, default: str = "spkNoise") -> DataFrame:
    """Label of each chunk (start_ms, end_ms) by overlap ratio, with `ambiguous` if the two best differ by `margin` or less.

    Only ratios of at least `least` count; ties go to the ground truth that starts first, then the smaller label.
    """
    g = gt.select(*keys, F.col("start_ms").alias("g_s"), F.col("end_ms").alias("g_e"), F.col("speaker_label").alias("g_label"))
    pairs = interval_pairs(chunks.select(chunk_id, *keys, "start_ms", "end_ms"), g, keys, "start_ms", "end_ms", "g_s", "g_e")
    ratio = F.least(F.lit(1.0), overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("g_s"), F.col("g_e")) / (F.col("end_ms") - F.col("start_ms")))
    pairs = pairs.withColumn("ratio", ratio).where(F.col("ratio") >= least)
    w = Window.partitionBy(chunk_id).orderBy(F.desc("ratio"), "g_s", "g_label")
    top = pairs.withColumn("second", F.lead("ratio").over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    rows = chunks.join(top.select(chunk_id, "g_label", "ratio", "second"), chunk_id, "left")
    return rows.select(*chunks.columns, F.coalesce("g_label", F.lit(default)).alias("label"), F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("ratio"), F.coalesce(F.round(F.col("ratio") - F.col("second"), 9) <= margin, F.lit(False)).alias("ambiguous"))


def overlap_matrix(system: DataFrame, gt: DataFrame, keys: list[str], sys_label: str, gt_label: str, zeros: bool = False) -> DataFrame:
    """Total overlap in milliseconds of each system label and ground-truth label of a recording.

    Pairs without overlap are left out, or 0 with `zeros`; the labels of a recording, not its rows, are paired then.
    """
    g = gt.select(*keys, F.col("start_ms").alias("g_s"), F.col("end_ms").alias("g_e"), F.col(gt_label).alias("gt_label"))
    s = system.select(*keys, "start_ms", "end_ms", F.col(sys_label).alias("sys_label"))
    pairs = interval_pairs(s, g, keys, "start_ms", "end_ms", "g_s", "g_e")
    ov = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("g_s"), F.col("g_e"))
    found = pairs.groupBy(*keys, "sys_label", "gt_label").agg(F.sum(ov).alias("overlap_ms")).where("overlap_ms > 0")
    if not zeros:
        return found
    names = s.groupBy(*keys).agg(F.collect_set("sys_label").alias("a")).join(g.groupBy(*keys).agg(F.collect_set("gt_label").alias("b")), keys)
    cells = names.select(*keys, F.explode("a").alias("sys_label"), "b").select(*keys, "sys_label", F.explode("b").alias("gt_label"))
    return cells.join(found, [*keys, "sys_label", "gt_label"], "left").na.fill(0, ["overlap_ms"])


def diarization_error(pred: DataFrame, gt: DataFrame, keys: list[str], pred_id: str, gt_id: str, collar: int = 250) -> DataFrame:
    """Diarization error by the project's rule, one row for each key and one overall (null key).

    `pred` has start_ms, end_ms, matched; `gt` start_ms, end_ms, speaker_label. The collar only widens the
    choice of candidates; overlapping predictions count more than once. Columns: gt_ms, miss_ms, error_ms,
    false_alarm_ms, der and the three rates, null without ground truth.
    """
    p = pred.select(*keys, F.col(pred_id).alias("p_id"), F.col("start_ms").alias("p_s"), F.col("end_ms").alias("p_e"), "matched")
    g = gt.select(*keys, F.col(gt_id).alias("g_id"), F.col("start_ms").alias("g_s"), F.col("end_ms").alias("g_e"), "speaker_label")
    pairs = interval_pairs(g, p, keys, "g_s", "g_e", "p_s", "p_e", collar)
    ov = overlap_ms(F.col("g_s"), F.col("g_e"), F.col("p_s"), F.col("p_e"))
    by_gt = pairs.groupBy("g_id").agg(F.sum(ov).alias("total"), F.sum(F.when(F.col("matched") == F.col("speaker_label"), ov).otherwise(F.lit(0).cast("bigint"))).alias("right"))
    by_pred = pairs.groupBy("p_id").agg(F.sum(ov).alias("total"))
    zero = F.lit(0).cast("bigint")
    side_g = g.join(by_gt, "g_id", "left").select(*keys, (F.col("g_e") - F.col("g_s")).alias("gt_ms"), F.greatest(zero, F.col("g_e") - F.col("g_s") - F.coalesce("total", zero)).alias("miss_ms"), (F.coalesce("total", zero) - F.coalesce("right", zero)).alias("error_ms"), zero.alias("false_alarm_ms"))
    side_p = p.join(by_pred, "p_id", "left").select(*keys, zero.alias("gt_ms"), zero.alias("miss_ms"), zero.alias("error_ms"), F.greatest(zero, F.col("p_e") - F.col("p_s") - F.coalesce("total", zero)).alias("false_alarm_ms"))
    sums = [F.sum(c).alias(c) for c in ("gt_ms", "miss_ms", "error_ms", "false_alarm_ms")]
    got = side_g.unionByName(side_p).rollup(*keys).agg(*sums, F.grouping_id().alias("__g")).where(f"__g in (0, {(1 << len(keys)) - 1})").drop("__g")
    rate = lambda c: F.round(F.when(F.col("gt_ms") > 0, c / F.col("gt_ms")), 6)
    return got.select("*", rate(F.col("miss_ms") + F.col("error_ms") + F.col("false_alarm_ms")).alias("der"), rate(F.col("miss_ms")).alias("miss_rate"), rate(F.col("error_ms")).alias("error_rate"), rate(F.col("false_alarm_ms")).alias("false_alarm_rate"))


def frame_labels(df: DataFrame, keys: list[str], label: str, tie: str, width: int = 10, end_inclusive: bool = False) -> DataFrame:
    """Label of each frame of `width` milliseconds (keys, frame, label); the interval that starts last wins.

    `end_inclusive` takes every frame from floor(start) to floor(end); otherwise floor(start) up to but
    without ceil(end).
    """
    last = F.floor(F.col("end_ms") / width) if end_inclusive else F.ceil(F.col("end_ms") / width) - 1
    rows = df.where("end_ms >= start_ms").withColumn("__last", last).withColumn("__first", F.floor(F.col("start_ms") / width)).where("__last >= __first")
    rows = rows.select(*keys, F.col(label).alias("label"), "start_ms", F.col(tie).alias("tie"), F.explode(F.sequence("__first", "__last")).alias("frame"))
    return rows.groupBy(*keys, "frame").agg(F.max(F.struct("start_ms", "tie", "label"))["label"].alias("label"))


def match_edits(edits: DataFrame, segments: DataFrame, least_pct: float = 90.0, moved_ms: int = 10) -> DataFrame:
    """Human edits held against the segment they refer to.

    `edits`: edit_id, sampleindex, speaker, start_ms, end_ms; `segments`: merged_id, start_ms, end_ms. The edits
    of one segment are numbered in the order of edit_id (split_order from 0). Result `action`: `new` for
    later parts of a split, `update` if at least `least_pct` percent of the segment is covered or a time moved
    by more than `moved_ms`, else `ignored`. Edits of unknown segments or without times are left out.
    """
    order = Window.partitionBy("sampleindex").orderBy("edit_id")
    e = edits.where("start_ms is not null and end_ms is not null and sampleindex is not null").withColumn("split_order", F.row_number().over(order) - 1)
    s = segments.select(F.col("merged_id").alias("sampleindex"), F.col("start_ms").alias("m_s"), F.col("end_ms").alias("m_e")).where("m_s is not null and m_e is not null")
    both = e.join(s, "sampleindex")
    pct = overlap_pct(F.col("m_s"), F.col("m_e"), F.col("start_ms"), F.col("end_ms"))
    moved = (F.abs(F.col("start_ms") - F.col("m_s")) > moved_ms) | (F.abs(F.col("end_ms") - F.col("m_e")) > moved_ms)
    action: Column = F.when(F.col("split_order") > 0, "new").when((pct >= least_pct) | moved, "update").otherwise("ignored")
    return both.select("edit_id", "sampleindex", "speaker", "split_order", F.round(pct, 6).alias("overlap_pct"), moved.alias("time_modified"), action.alias("action"))


def keep_frequent(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """rows whose label occurs at least `least` times in the whole table; null labels drop out."""
    often = df.groupBy(label).agg(F.count("*").alias("__n")).where((F.col("__n") >= least) & F.col(label).isNotNull()).select(label)
    return df.join(often, label, "left_semi")


def keep_top_percent(df: DataFrame, keys: list[str], score: str, tie: str, percent: int = 90) -> DataFrame:
    """of each key the floor(n * percent / 100) rows with the highest score (ties by `tie`); null scores come last."""
    rows = ranked(df, keys, [F.col(score).desc_nulls_last(), F.col(tie)], "__rn", "__n")
    return rows.where(F.col("__rn") <= F.floor(F.col("__n") * percent / 100)).drop("__rn", "__n")
