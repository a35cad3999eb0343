"""Queries of the interval, metric, sequence, vector, graph, propagation and selection operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery, table, to_ms
from voxloom.functions import scalars
from voxloom.operators import assign, cluster, graphs, intervals, metrics, propagate, select, sequences, vectors
from voxloom.operators.components import connected_components
from voxloom.operators.ordered import bucket_of
from voxloom.plans.tables import AZ, CHK, EMB, GT, SEG, SMP, azure, chunks, embeddings, first_sql, gt, ms_sql, samples, segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- intervals
@query(f"""WITH {GT}
SELECT seg_id, CAST(k AS BIGINT) AS chunk_no, CAST(s + k * 200 AS BIGINT) AS chunk_start, CAST(least(s + k * 200 + 1000, e) AS BIGINT) AS chunk_stop
FROM (SELECT *, unnest(range(0, CAST(floor((e - s - 900) / 200.0) AS BIGINT) + 1)) AS k FROM gt WHERE e - s >= 900)""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """W1, F11"""
    return intervals.sliding_chunks(gt(spark, d), "start_ms", "end_ms").select("seg_id", "chunk_no", "chunk_start", "chunk_stop")


MERGED = f"""WITH {GT}, m AS (
  SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY rec_id, speaker_label ORDER BY s, seg_id) <= 200 THEN 0 ELSE 1 END AS o FROM gt), i AS (
  SELECT *, sum(o) OVER (PARTITION BY rec_id, speaker_label ORDER BY s, seg_id) AS island FROM m)"""


@query(MERGED + """
SELECT rec_id, speaker_label, min(s) AS start_ms, arg_max(e, struct_pack(s := s, seg_id := seg_id)) AS stop_ms, count(*) AS n FROM i GROUP BY rec_id, speaker_label, island""")
def gap_merge(spark: SparkSession, d: str) -> DataFrame:
    """W2, F10"""
    return intervals.gap_merge(gt(spark, d), ["rec_id", "speaker_label"], "start_ms", "end_ms", "seg_id")


@query(f"""WITH {CHK}, c AS (SELECT * FROM chk WHERE cluster_label IS NOT NULL AND cluster_label <> -1 AND s IS NOT NULL AND e IS NOT NULL AND name_rec IS NOT NULL), m AS (
  SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY cluster_label, name_rec ORDER BY s, sample_id) <= 200 THEN 0 ELSE 1 END AS o FROM c), i AS (
  SELECT *, sum(o) OVER (PARTITION BY cluster_label, name_rec ORDER BY s, sample_id) AS island FROM m), v AS (
  SELECT cluster_label, name_rec, island, gt_label, count(*) AS c FROM i WHERE gt_label IS NOT NULL GROUP BY ALL), mode AS (
  SELECT cluster_label, name_rec, island, gt_label AS gt_mode FROM v QUALIFY row_number() OVER (PARTITION BY cluster_label, name_rec, island ORDER BY c DESC, gt_label) = 1), a AS (
  SELECT cluster_label, name_rec, island, min(s) AS start_ms, arg_max(e, struct_pack(s := s, id := sample_id)) AS stop_ms, count(*) AS n_constituents, round(avg(prob), 6) AS mean_prob, array_to_string(list(unique_id ORDER BY s, sample_id), ',') AS constituent_ids FROM i GROUP BY ALL)
SELECT cluster_label, name_rec, start_ms, stop_ms, n_constituents, mean_prob, gt_mode, constituent_ids FROM a LEFT JOIN mode USING (cluster_label, name_rec, island)""")
def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks merged per cluster and recording, with mean probability, mode of the truth and constituents"""
    keys = ["cluster_label", "name_rec"]
    c = chunks(spark, d).where("cluster_label is not null and cluster_label <> -1")
    isl = intervals.gap_islands(c, keys, "start_ms", "stop_ms", "sample_id", 200)
    place = F.struct("start_ms", "sample_id")
    # an island is a stretch of one voice without a gap, so its list of names is short
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "sample_id", "unique_id"))), lambda x: x["unique_id"]), ",")
    got = isl.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max_by("stop_ms", place).alias("stop_ms"), F.count("*").alias("n_constituents"), F.round(F.avg("prob"), 6).alias("mean_prob"), ids.alias("constituent_ids"))
    return got.join(intervals.smallest_mode(isl, [*keys, "island"], "gt_label", "gt_mode"), [*keys, "island"], "left").drop("island")


OVERLAPS = f"""WITH {GT}, {SEG}, ov AS (
  SELECT seg.merged_id, gt.speaker_label, gt.s AS g_s, gt.e AS g_e, gt.seg_id, least(seg.e, gt.e) - greatest(seg.s, gt.s) AS ov, seg.e - seg.s AS len
  FROM seg JOIN gt ON seg.rec_id = gt.rec_id AND gt.e > seg.s AND gt.s < seg.e)"""
MATCHED = OVERLAPS + """, best AS (
  SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY merged_id ORDER BY ov DESC, g_s, speaker_label) = 1), matched AS (
  SELECT seg.*, coalesce(best.speaker_label, 'UNKNOWN') AS matched, coalesce(best.ov, 0) AS overlap_ms FROM seg LEFT JOIN best USING (merged_id))"""


@query(OVERLAPS + """, r AS (
  SELECT *, least(1.0, ov / len) AS ratio FROM ov WHERE ov / len >= 0.8), k AS (
  SELECT merged_id, speaker_label, ratio, lead(ratio) OVER w AS second, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY merged_id ORDER BY ratio DESC, g_s, speaker_label))
SELECT seg.merged_id, coalesce(k.speaker_label, 'spkNoise') AS label, round(coalesce(ratio, 0.0), 6) AS ratio, coalesce(round(ratio - second, 9) <= 0.1, false) AS ambiguous FROM seg LEFT JOIN (SELECT * FROM k WHERE rn = 1) k USING (merged_id)""")
def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """J1, T1"""
    return intervals.label_chunks(segments(spark, d), gt(spark, d), "merged_id", ["rec_id"]).select("merged_id", "label", "ratio", "ambiguous")


@query(MATCHED + " SELECT merged_id, matched, overlap_ms, round(overlap_ms * 1.0 / (e - s) * 100, 6) AS overlap_pct FROM matched")
def best_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    """J2, J3, J4"""
    return intervals.best_overlap(segments(spark, d), gt(spark, d), "merged_id", ["rec_id"]).select("merged_id", "matched", "overlap_ms", "overlap_pct")


MATRIX = f"""WITH {GT}, {AZ}, mx AS (
  SELECT rec_id, speaker AS sys_label, speaker_label AS gt_label, CAST(sum(least(az.e, gt.e) - greatest(az.s, gt.s)) AS BIGINT) AS overlap_ms
  FROM az JOIN gt USING (rec_id) WHERE gt.e > az.s AND gt.s < az.e GROUP BY ALL)"""


@query(MATRIX + " SELECT * FROM mx")
def overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    """J5"""
    return intervals.overlap_matrix(azure(spark, d), gt(spark, d), ["rec_id"], "speaker", "speaker_label")


@query()
def speaker_mapping(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one mapping of competitor speakers (an assignment, which SQL can't express)"""
    return assign.map_speakers(overlap_matrix(spark, d))


@query(MATCHED + """, g2 AS (
  SELECT gt.seg_id, any_value(gt.rec_id) AS rec_id, any_value(gt.e - gt.s) AS len, sum(CASE WHEN m.s IS NULL OR gt.s IS NULL THEN 0 ELSE greatest(0, least(m.e, gt.e) - greatest(m.s, gt.s)) END) AS total, sum(CASE WHEN m.matched = gt.speaker_label THEN greatest(0, least(m.e, gt.e) - greatest(m.s, gt.s)) ELSE 0 END) AS hit
  FROM gt LEFT JOIN matched m ON m.rec_id = gt.rec_id AND m.e > gt.s - 250 AND m.s < gt.e + 250 GROUP BY gt.seg_id), p2 AS (
  SELECT m.merged_id, any_value(m.rec_id) AS rec_id, any_value(m.e - m.s) AS len, sum(CASE WHEN m.s IS NULL OR gt.s IS NULL THEN 0 ELSE greatest(0, least(m.e, gt.e) - greatest(m.s, gt.s)) END) AS total
  FROM matched m LEFT JOIN gt ON m.rec_id = gt.rec_id AND gt.e > m.s - 250 AND gt.s < m.e + 250 GROUP BY m.merged_id), u AS (
  SELECT rec_id, len AS gt_ms, greatest(0, len - coalesce(total, 0)) AS miss_ms, coalesce(total, 0) - coalesce(hit, 0) AS error_ms, 0 AS false_alarm_ms FROM g2
  UNION ALL SELECT rec_id, 0, 0, 0, greatest(0, len - coalesce(total, 0)) FROM p2), a AS (
  SELECT rec_id, CAST(sum(gt_ms) AS BIGINT) AS gt_ms, CAST(sum(miss_ms) AS BIGINT) AS miss_ms, CAST(sum(error_ms) AS BIGINT) AS error_ms, CAST(sum(false_alarm_ms) AS BIGINT) AS false_alarm_ms FROM u GROUP BY ROLLUP (rec_id))
SELECT *, round((miss_ms + error_ms + false_alarm_ms) * 1.0 / nullif(gt_ms, 0), 6) AS der, round(miss_ms * 1.0 / nullif(gt_ms, 0), 6) AS miss_rate, round(error_ms * 1.0 / nullif(gt_ms, 0), 6) AS error_rate, round(false_alarm_ms * 1.0 / nullif(gt_ms, 0), 6) AS false_alarm_rate FROM a""")
def diarization_error(spark: SparkSession, d: str) -> DataFrame:
    """J6, X6, X22"""
    pred = intervals.best_overlap(segments(spark, d), gt(spark, d), "merged_id", ["rec_id"])
    return intervals.diarization_error(pred, gt(spark, d), ["rec_id"], "merged_id", "seg_id")


@query(f"""WITH {SEG}, e AS (
  SELECT edit_id, sampleindex, speakerlp AS speaker, {ms_sql("starttime")} AS s, {ms_sql("endtime")} AS e FROM {first_sql("human_edits", "edit_id")}), o AS (
  SELECT *, row_number() OVER (PARTITION BY sampleindex ORDER BY edit_id) - 1 AS split_order FROM e WHERE s IS NOT NULL AND e IS NOT NULL AND sampleindex IS NOT NULL), j AS (
  SELECT o.edit_id, o.sampleindex, o.speaker, o.split_order, greatest(0, least(seg.e, o.e) - greatest(seg.s, o.s)) * 1.0 / (seg.e - seg.s) * 100.0 AS pct, abs(o.s - seg.s) > 10 OR abs(o.e - seg.e) > 10 AS moved FROM o JOIN seg ON o.sampleindex = seg.merged_id)
SELECT edit_id, sampleindex, speaker, split_order, round(pct, 6) AS overlap_pct, moved AS time_modified, CASE WHEN split_order > 0 THEN 'new' WHEN pct >= 90 OR moved THEN 'update' ELSE 'ignored' END AS action FROM j""")
def human_edit_match(spark: SparkSession, d: str) -> DataFrame:
    """J13, W6"""
    e = first_delivery(table(spark, d, "human_edits"), "edit_id").select("edit_id", "sampleindex", F.col("speakerlp").alias("speaker"), to_ms(F.col("starttime")).alias("start_ms"), to_ms(F.col("endtime")).alias("end_ms"))
    return intervals.match_edits(e, segments(spark, d)).withColumn("split_order", F.col("split_order").cast("bigint"))


@query(f"WITH {GT}, c AS (SELECT speaker_label FROM gt GROUP BY 1 HAVING count(*) >= 5) SELECT seg_id, speaker_label FROM gt SEMI JOIN c USING (speaker_label)")
def frequent_labels(spark: SparkSession, d: str) -> DataFrame:
    """F3, A1, J11"""
    return intervals.keep_frequent(gt(spark, d), "speaker_label").select("seg_id", "speaker_label")


@query(f"""WITH {SMP}, r AS (SELECT sample_id, rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY prob DESC NULLS LAST, sample_id) AS rn, count(*) OVER (PARTITION BY rec_id) AS n FROM smp WHERE rec_id IS NOT NULL)
SELECT sample_id, rec_id FROM r WHERE rn <= floor(n * 90 / 100.0)""")
def keep_top_percent(spark: SparkSession, d: str) -> DataFrame:
    """F4, A12"""
    return intervals.keep_top_percent(samples(spark, d).where("rec_id is not null"), ["rec_id"], "prob", "sample_id").select("sample_id", "rec_id")


@query(f"""WITH {GT}, {SEG}, x AS (SELECT rec_id, s, e, 'g' AS side FROM gt UNION ALL SELECT rec_id, s, e, 'p' FROM seg), y AS (SELECT rec_id, s, e, side FROM x UNION ALL SELECT rec_id, s, e, 'u' FROM x), r AS (
  SELECT *, max(e) OVER (PARTITION BY rec_id, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM y), c AS (
  SELECT rec_id, CAST(coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'g'), 0) AS BIGINT) AS gt_ms, CAST(coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'p'), 0) AS BIGINT) AS pred_ms,
  CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'u') AS BIGINT) AS u FROM r GROUP BY rec_id), z AS (SELECT rec_id, gt_ms, pred_ms, gt_ms + pred_ms - u AS both_ms FROM c)
SELECT *, gt_ms - both_ms AS miss_ms, pred_ms - both_ms AS false_alarm_ms, CASE WHEN pred_ms = 0 THEN 0.0 ELSE round(both_ms * 1.0 / pred_ms, 6) END AS precision, CASE WHEN gt_ms = 0 THEN 0.0 ELSE round(both_ms * 1.0 / gt_ms, 6) END AS recall FROM z""")
def speech_detection(spark: SparkSession, d: str) -> DataFrame:
    """X10"""
    return metrics.speech_detection(gt(spark, d), segments(spark, d), ["rec_id"])


# ---------------------------------------------------------------- metrics on labels
TABLE = f"""WITH {SMP}, ct AS (SELECT gt_label AS y, cluster_label AS c, count(*) AS n FROM smp WHERE gt_label IS NOT NULL AND cluster_label IS NOT NULL GROUP BY ALL), mj AS (
  SELECT c, y AS major FROM ct QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, y) = 1), t AS (
  SELECT y, major AS p, sum(n) AS n FROM ct JOIN mj USING (c) GROUP BY ALL)"""


def label_table(spark: SparkSession, d: str) -> DataFrame:
    """Contingency of truth and the clusters' majority truth."""
    raw = metrics.contingency(samples(spark, d), "gt_label", "cluster_label")
    major = metrics.majority(raw)
    return raw.join(major, "p").groupBy("y", F.col("major").alias("p")).agg(F.sum("n").alias("n"))


REPORT = TABLE + """, l AS (SELECT y AS label FROM t UNION SELECT p FROM t), rep AS (
  SELECT label, CAST(coalesce((SELECT sum(n) FROM t WHERE y = label AND p = label), 0) AS BIGINT) AS tp, CAST(coalesce((SELECT sum(n) FROM t WHERE y = label), 0) AS BIGINT) AS support, CAST(coalesce((SELECT sum(n) FROM t WHERE p = label), 0) AS BIGINT) AS predicted FROM l), pr AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall FROM rep), f AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


@query(REPORT + " SELECT label, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """X3, U2"""
    r = metrics.class_report(label_table(spark, d))
    return r.select("label", "tp", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(REPORT + """ SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def accuracy_macro(spark: SparkSession, d: str) -> DataFrame:
    """X1, X2"""
    return metrics.accuracy_macro(label_table(spark, d))


@query(TABLE + " SELECT y, p, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY CUBE (y, p)")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """X4"""
    return metrics.confusion(label_table(spark, d))


@query(TABLE + " SELECT rec_id, count(*) AS n, round(avg(CASE WHEN gt_label = major THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM smp JOIN mj ON cluster_label = c WHERE gt_label IS NOT NULL AND rec_id IS NOT NULL GROUP BY ROLLUP (rec_id)")
def accuracy_by_file(spark: SparkSession, d: str) -> DataFrame:
    """X5, A10"""
    s = samples(spark, d)
    major = metrics.majority(metrics.contingency(s, "gt_label", "cluster_label"))
    return metrics.accuracy_by_file(s.join(major, s.cluster_label == major.p), "rec_id", "gt_label", "major")


@query(f"""WITH {AZ} SELECT rec_id, count(conf) AS n, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, round(min(conf), 6) AS min, round(max(conf), 6) AS max, round(quantile_cont(conf, 0.25), 6) AS q25, round(quantile_cont(conf, 0.5), 6) AS median, round(quantile_cont(conf, 0.75), 6) AS q75 FROM az WHERE conf IS NOT NULL GROUP BY rec_id""")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """A7, X7"""
    return metrics.distribution_stats(azure(spark, d), "conf", ["rec_id"])


@query(f"""WITH {SMP}, c AS (SELECT cluster_label, gt_label, count(*) AS n FROM smp WHERE gt_label IS NOT NULL AND cluster_label IS NOT NULL GROUP BY ALL), a AS (SELECT cluster_label, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY 1)
SELECT cluster_label, n_rows, n_labels, round(h / ln(2), 6) AS entropy, round(CASE WHEN n_labels > 1 THEN h / ln(n_labels) ELSE 0.0 END, 6) AS normalized FROM a""")
def cluster_entropy(spark: SparkSession, d: str) -> DataFrame:
    """A8, X8, X21"""
    return metrics.label_entropy(samples(spark, d).where("cluster_label is not null"), "gt_label", ["cluster_label"], 2)


CELLS = f"WITH {SMP}, t AS (SELECT gt_label AS y, cluster_label AS p, count(*) AS n FROM smp WHERE gt_label IS NOT NULL AND cluster_label IS NOT NULL GROUP BY ALL)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contingency(samples(spark, d), "gt_label", "cluster_label")


@query(CELLS + ", b AS (SELECT p, max(n) AS m, sum(n) AS n FROM t GROUP BY p) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(m)::DOUBLE / sum(n), 6) AS purity FROM b")
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    """X14, A11"""
    return metrics.purity(cells(spark, d))


@query(CELLS + ", c AS (SELECT *, sum(n) OVER (PARTITION BY p) AS c, sum(n) OVER (PARTITION BY y) AS t FROM t) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n::DOUBLE * n / c) / sum(n), 6) AS b3_precision, round(sum(n::DOUBLE * n / t) / sum(n), 6) AS b3_recall FROM c")
def bcubed(spark: SparkSession, d: str) -> DataFrame:
    """X15"""
    return metrics.bcubed(cells(spark, d))


@query(CELLS + """, a AS (SELECT sum(n * (n - 1) / 2.0)::DOUBLE AS ij, sum(n * ln(n)) AS lij, sum(n)::DOUBLE AS n FROM t), b AS (SELECT sum(m * (m - 1) / 2.0)::DOUBLE AS ai, sum(m * ln(m)) AS li FROM (SELECT sum(n)::DOUBLE AS m FROM t GROUP BY y)),
c AS (SELECT sum(m * (m - 1) / 2.0)::DOUBLE AS bj, sum(m * ln(m)) AS lj FROM (SELECT sum(n)::DOUBLE AS m FROM t GROUP BY p))
SELECT CAST(n AS BIGINT) AS n, round((ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)), 6) AS ari, round((ln(n) - li / n + ln(n) - lj / n - (ln(n) - lij / n)) / ((ln(n) - li / n + ln(n) - lj / n) / 2), 6) AS nmi, round(ij / sqrt(ai * bj), 6) AS fmi FROM a, b, c""")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """X19"""
    return metrics.pair_scores(cells(spark, d))


@query(CELLS + """, r AS (SELECT y, p AS primary_p, n AS tp, sum(n) OVER (PARTITION BY y) AS total, sum(n) OVER (PARTITION BY p) AS ptotal FROM t QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, p) = 1)
SELECT y, primary_p, round(tp::DOUBLE / ptotal, 6) AS precision, round(tp::DOUBLE / total, 6) AS recall, round(2 * (tp::DOUBLE / ptotal) * (tp::DOUBLE / total) / (tp::DOUBLE / ptotal + tp::DOUBLE / total), 6) AS f1, CAST(total AS BIGINT) AS total FROM r""")
def speaker_report(spark: SparkSession, d: str) -> DataFrame:
    """X20"""
    return metrics.speaker_report(cells(spark, d))


FRAMES = f"""WITH {GT}, {SEG}, gf AS (SELECT rec_id, frame, speaker_label AS y FROM (SELECT *, unnest(range(s // 100, (e + 99) // 100)) AS frame FROM gt) QUALIFY row_number() OVER (PARTITION BY rec_id, frame ORDER BY s DESC, seg_id DESC, speaker_label DESC) = 1), pf AS (
  SELECT rec_id, frame, cluster_label AS p FROM (SELECT *, unnest(range(s // 100, (e + 99) // 100)) AS frame FROM seg WHERE cluster_label IS NOT NULL AND cluster_label <> -1) QUALIFY row_number() OVER (PARTITION BY rec_id, frame ORDER BY s DESC, merged_id DESC, cluster_label DESC) = 1), ft AS (
  SELECT rec_id, y, p, count(*) AS n FROM gf FULL JOIN pf USING (rec_id, frame) GROUP BY ALL), fm AS (
  SELECT rec_id, p, y AS major FROM ft WHERE y IS NOT NULL AND p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id, p ORDER BY n DESC, y) = 1)"""


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames of 100 ms of truth and clusters."""
    pred = segments(spark, d).where("cluster_label is not null and cluster_label <> -1")
    return intervals.frame_labels(gt(spark, d), ["rec_id"], "speaker_label", "seg_id", 100), intervals.frame_labels(pred, ["rec_id"], "cluster_label", "merged_id", 100)


@query(FRAMES + """, a AS (SELECT rec_id, CAST(sum(CASE WHEN y IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS gt_frames, CAST(sum(CASE WHEN ft.p IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS pred_frames, CAST(sum(CASE WHEN major = y THEN n ELSE 0 END) AS BIGINT) AS hits FROM ft LEFT JOIN fm USING (rec_id, p) GROUP BY rec_id)
SELECT *, round(CASE WHEN pred_frames = 0 THEN 0.0 ELSE hits::DOUBLE / pred_frames END, 6) AS precision, round(CASE WHEN gt_frames = 0 THEN 0.0 ELSE hits::DOUBLE / gt_frames END, 6) AS recall, round(CASE WHEN gt_frames = 0 THEN 0.0 ELSE (gt_frames - hits)::DOUBLE / gt_frames END, 6) AS der FROM a""")
def frame_report(spark: SparkSession, d: str) -> DataFrame:
    """J17, X13, X16, U4"""
    truth, pred = frames(spark, d)
    return metrics.frame_report(truth, pred, ["rec_id"])


@query(FRAMES + """, tp AS (SELECT rec_id, y, sum(n) AS tp FROM ft JOIN fm USING (rec_id, p) WHERE major = y GROUP BY ALL), cl AS (SELECT rec_id, major AS y, count(*) AS claimed FROM pf JOIN fm USING (rec_id, p) GROUP BY ALL), g AS (SELECT rec_id, y, count(*) AS frames FROM gf GROUP BY ALL)
SELECT rec_id, y, frames, round(CASE WHEN coalesce(claimed, 0) = 0 THEN 0.0 ELSE coalesce(tp, 0)::DOUBLE / claimed END, 6) AS precision, round(coalesce(tp, 0)::DOUBLE / frames, 6) AS recall, round((frames - coalesce(tp, 0))::DOUBLE / frames, 6) AS der FROM g LEFT JOIN tp USING (rec_id, y) LEFT JOIN cl USING (rec_id, y)""")
def frame_speakers(spark: SparkSession, d: str) -> DataFrame:
    """X17"""
    truth, pred = frames(spark, d)
    return metrics.frame_speakers(truth, pred, ["rec_id"])


@query(f"""WITH {GT}, {SEG}, sc AS (SELECT * FROM seg WHERE cluster_label IS NOT NULL AND cluster_label <> -1), t AS (SELECT rec_id, speaker_label AS y, cluster_label AS p, sum(least(sc.e, gt.e) - greatest(sc.s, gt.s)) AS n FROM sc JOIN gt USING (rec_id) WHERE gt.e > sc.s AND gt.s < sc.e GROUP BY ALL),
b AS (SELECT rec_id, p, max(n) AS m FROM t GROUP BY ALL), c AS (SELECT rec_id, sum(coalesce(m, 0))::DOUBLE / sum(ms) AS purity FROM (SELECT rec_id, cluster_label AS p, sum(e - s) AS ms FROM sc GROUP BY ALL) LEFT JOIN b USING (rec_id, p) GROUP BY rec_id),
v AS (SELECT rec_id, y, sum(n) AS m FROM t GROUP BY ALL), s AS (SELECT rec_id, sum(coalesce(m, 0))::DOUBLE / sum(ms) AS coverage FROM (SELECT rec_id, speaker_label AS y, sum(e - s) AS ms FROM gt GROUP BY ALL) LEFT JOIN v USING (rec_id, y) GROUP BY rec_id)
SELECT rec_id, round(purity, 6) AS purity, round(coverage, 6) AS coverage, round(CASE WHEN purity + coverage > 0 THEN 2 * purity * coverage / (purity + coverage) ELSE 0.0 END, 6) AS f1 FROM c JOIN s USING (rec_id)""")
def purity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """X18"""
    g, s = gt(spark, d), segments(spark, d).where("cluster_label is not null and cluster_label <> -1")
    t = intervals.overlap_matrix(s, g, ["rec_id"], "cluster_label", "speaker_label").select("rec_id", F.col("gt_label").alias("y"), F.col("sys_label").alias("p"), F.col("overlap_ms").alias("n"))
    ms = F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")
    return metrics.purity_coverage(t, s.groupBy("rec_id", F.col("cluster_label").alias("p")).agg(ms), g.groupBy("rec_id", F.col("speaker_label").alias("y")).agg(ms), ["rec_id"])


@query(TABLE + """, x AS (SELECT CAST(round(prob * 10000) AS BIGINT) AS s, CASE WHEN gt_label = major THEN 1 ELSE 0 END AS hit FROM smp JOIN mj ON cluster_label = c WHERE gt_label IS NOT NULL AND prob IS NOT NULL), g AS (SELECT s, sum(hit) AS pos, sum(1 - hit) AS neg FROM x GROUP BY s), k AS (
  SELECT s, sum(pos) OVER (ORDER BY s DESC)::DOUBLE / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY s DESC)::DOUBLE / sum(neg) OVER () AS fpr FROM g)
SELECT (SELECT round(fpr, 6) FROM k ORDER BY round(abs(1 - tpr - fpr), 9), s DESC LIMIT 1) AS eer, (SELECT round(s / 10000.0, 6) FROM k ORDER BY round(abs(1 - tpr - fpr), 9), s DESC LIMIT 1) AS threshold, round(min(100 * (0.01 * (1 - tpr) + 0.99 * fpr)), 6) AS dcf01, round(min(1000 * (0.001 * (1 - tpr) + 0.999 * fpr)), 6) AS dcf001 FROM k""")
def equal_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """X11: the cluster probability as a score for a right label"""
    s = samples(spark, d)
    major = metrics.majority(metrics.contingency(s, "gt_label", "cluster_label"))
    rows = s.join(major, s.cluster_label == major.p).where("gt_label is not null").withColumn("hit", (F.col("gt_label") == F.col("major")).cast("int"))
    return metrics.equal_error_rate(rows, "prob", "hit")


@query(TABLE + """, x AS (SELECT prob, gt_label = major AS truth FROM smp JOIN mj ON cluster_label = c WHERE gt_label IS NOT NULL AND prob IS NOT NULL)
SELECT CASE WHEN prob >= 0.5 AND truth THEN 'TP' WHEN prob >= 0.5 THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n, round(avg(CASE WHEN prob >= 0.5 THEN prob ELSE 1 - prob END), 6) AS confidence FROM x GROUP BY 1""")
def detector_report(spark: SparkSession, d: str) -> DataFrame:
    """X23, F5"""
    s = samples(spark, d)
    major = metrics.majority(metrics.contingency(s, "gt_label", "cluster_label"))
    rows = s.join(major, s.cluster_label == major.p).where("gt_label is not null")
    return metrics.detector_report(rows, "prob", F.col("gt_label") == F.col("major"))


@query(TABLE + " SELECT gt_label, count(*) FILTER (gt_label = major) AS n_right, count(*) FILTER (gt_label <> major) AS n_wrong, round(count(*) FILTER (gt_label = major)::DOUBLE / count(*), 6) AS ratio FROM smp JOIN mj ON cluster_label = c WHERE gt_label IS NOT NULL GROUP BY gt_label")
def speaker_totals(spark: SparkSession, d: str) -> DataFrame:
    """A4, J8, X12"""
    s = samples(spark, d)
    major = metrics.majority(metrics.contingency(s, "gt_label", "cluster_label"))
    return metrics.speaker_totals(s.join(major, s.cluster_label == major.p), "gt_label", F.col("gt_label") == F.col("major"))


@query(f"WITH {SMP} SELECT cluster_label, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(min(prob), 6) AS min_prob, round(max(prob), 6) AS max_prob, round(avg(outlier), 6) AS mean_outlier FROM smp WHERE cluster_label IS NOT NULL AND cluster_label <> -1 GROUP BY 1")
def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """A2, A5, F9"""
    return cluster.cluster_profile(samples(spark, d), "cluster_label", "prob", "outlier")


@query(f"WITH {SMP} SELECT count(DISTINCT CASE WHEN cluster_label <> -1 THEN cluster_label END) AS n_clusters, round(avg(CASE WHEN cluster_label <> -1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS membership_pct FROM smp")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """C3"""
    return cluster.cluster_summary(samples(spark, d), "cluster_label")


@query(f"WITH {GT} SELECT rec_id, count(*) AS n, min(s) AS first_ms, max(e) AS last_ms, count(DISTINCT speaker_label) AS n_speakers, round(sum(e - s) * 100.0 / (SELECT sum(e - s) FROM gt), 6) AS pct FROM gt GROUP BY rec_id")
def recording_profile(spark: SparkSession, d: str) -> DataFrame:
    """A6, A9, A14"""
    rows = checkpoint(gt(spark, d).groupBy("rec_id").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count_distinct("speaker_label").alias("n_speakers"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")))
    total = rows.agg(F.sum("ms")).first()[0]
    return rows.select("rec_id", "n", "first_ms", "last_ms", "n_speakers", F.round(F.col("ms") * 100.0 / total, 6).alias("pct"))


# ---------------------------------------------------------------- sequences and text
SEQ = f"""WITH {SEG}, q AS (SELECT rec_id, merged_id, s, cluster_label AS label FROM seg WHERE cluster_label IS NOT NULL), ch AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY rec_id ORDER BY s, merged_id) THEN 0 ELSE 1 END AS c FROM q), ru AS (
  SELECT *, sum(c) OVER (PARTITION BY rec_id ORDER BY s, merged_id) AS run FROM ch), runs AS (SELECT rec_id, run, any_value(label) AS label, count(*) AS n FROM ru GROUP BY ALL)"""


def label_sequence(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where("cluster_label is not null").select("rec_id", "merged_id", "start_ms", F.col("cluster_label").alias("label")).withColumn("b", bucket_of(F.col("start_ms")))


@query(SEQ + " SELECT rec_id, CAST(run AS BIGINT) AS run, label, n FROM runs")
def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """W4"""
    return sequences.label_runs(label_sequence(spark, d), ["rec_id"], "b", ["start_ms", "merged_id"], "label").select("rec_id", F.col("run").cast("bigint").alias("run"), "label", "n")


@query(SEQ + """, nb AS (SELECT *, lag(label) OVER w AS pl, lag(n) OVER w AS pn, lead(label) OVER w AS ql, lead(n) OVER w AS qn FROM runs WINDOW w AS (PARTITION BY rec_id ORDER BY run)), kp AS (
  SELECT rec_id, run, label, CASE WHEN n < 3 AND n <= 2 AND (coalesce(pl = ql AND pl <> label, false) OR n <= 2 OR coalesce(pl <> ql AND n < pn / 3.0 AND n < qn / 3.0 AND pn > 5 AND qn > 5, false)) THEN NULL ELSE label END AS kept FROM nb), fl AS (
  SELECT rec_id, run, coalesce(last_value(kept IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(kept IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), first_value(label) OVER (PARTITION BY rec_id ORDER BY run)) AS smoothed FROM kp)
SELECT ru.merged_id, ru.rec_id, ru.label, fl.smoothed FROM ru JOIN fl USING (rec_id, run)""")
def smooth_labels(spark: SparkSession, d: str) -> DataFrame:
    """W4, W5"""
    return sequences.smooth_labels(label_sequence(spark, d), ["rec_id"], "b", ["start_ms", "merged_id"], "label").select("merged_id", "rec_id", "label", "smoothed")


@query(f"""WITH {SMP}, k AS (SELECT sample_id, coalesce(CAST(gt_label AS VARCHAR), 'none') AS l, CAST(row_number() OVER (PARTITION BY coalesce(CAST(gt_label AS VARCHAR), 'none') ORDER BY sample_id) - 1 AS VARCHAR) AS k, (SELECT count(*) FROM smp) AS n FROM smp)
SELECT sample_id, 'S' || l || '_' || CASE WHEN length(k) < CASE WHEN n < 100 THEN 2 WHEN n < 1000 THEN 3 ELSE 4 END THEN lpad(k, CASE WHEN n < 100 THEN 2 WHEN n < 1000 THEN 3 ELSE 4 END, '0') ELSE k END AS label_id FROM k""")
def label_ids(spark: SparkSession, d: str) -> DataFrame:
    """W3"""
    return sequences.label_ids(samples(spark, d), "gt_label", "sample_id").select("sample_id", "label_id")


@query(f"WITH {CHK} SELECT sample_id, name_rec, voice, s AS start_ms, e AS stop_ms, prob FROM chk")
def filename_codec(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2, B3, B9"""
    return chunks(spark, d).select("sample_id", "name_rec", "voice", "start_ms", "stop_ms", "prob")


@query(f"""WITH {GT} SELECT seg_id, printf('%02d:%02d:%02d.%02d', s // 3600000, (s // 60000) % 60, (s // 1000) % 60, (s % 1000) // 10) AS clock, s - s % 10 AS parsed_ms,
  rec_id || '_' || speaker_label || '_' || printf('%d.%02d', s // 1000, (s % 1000) // 10) || '_' || printf('%d.%02d', e // 1000, (e % 1000) // 10) AS name FROM gt WHERE s >= 0""")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    """B4, B5, D4"""
    g = gt(spark, d).where("start_ms >= 0").withColumn("clock", scalars.clock(F.col("start_ms")))
    return g.select("seg_id", "clock", scalars.parse_clock(F.col("clock")).alias("parsed_ms"), scalars.chunk_name(F.col("rec_id"), F.col("speaker_label"), F.col("start_ms"), F.col("end_ms")).alias("name"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """B11, B12"""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"""WITH {SMP}, c AS (SELECT rec_id, count(DISTINCT CASE WHEN cluster_label <> -1 THEN cluster_label END)::DOUBLE AS k, avg(CASE WHEN cluster_label <> -1 THEN 1.0 ELSE 0.0 END) * 100 AS w, count(*) AS n FROM smp WHERE rec_id IS NOT NULL GROUP BY rec_id)
SELECT rec_id, round(CASE WHEN k <= 0 THEN 0 WHEN k <= 6 THEN pow(k / 6, 0.3) ELSE exp(-(k - 6) / 40) END, 6) AS count_score, round((1 / (1 + exp(-(w - 60) / 1.5))) * (1 / (1 + exp((w - 95) / 2))) * CASE WHEN w BETWEEN 60 AND 100 THEN 1 + 0.01 * (w - 60) ELSE 1 END - 0.25, 6) AS membership_score,
  CASE WHEN n > 1000 THEN 25 WHEN n >= 500 THEN 12 ELSE 5 END AS min_size FROM c""")
def score_curves(spark: SparkSession, d: str) -> DataFrame:
    """B7, B13, B14, B15"""
    inside = F.coalesce(F.col("cluster_label") != -1, F.lit(False))
    c = samples(spark, d).where("rec_id is not null").groupBy("rec_id").agg(F.count_distinct(F.when(inside, F.col("cluster_label"))).cast("double").alias("k"), (F.avg(F.when(inside, 1.0).otherwise(0.0)) * 100).alias("w"), F.count("*").alias("n"))
    return c.select("rec_id", F.round(scalars.cluster_count_score(F.col("k")), 6).alias("count_score"), F.round(scalars.membership_score(F.col("w")), 6).alias("membership_score"), scalars.min_cluster_size(F.col("n")).alias("min_size"))


# ---------------------------------------------------------------- vectors (queries: ids divisible by 100, against all rows)
def knn(spark: SparkSession, d: str, k: int, metric: str = "euclidean") -> DataFrame:
    e = embeddings(spark, d)
    return vectors.exact_neighbours(e.select("id", "vec"), e.select("id", "vec"), k, metric)


KNN = EMB + """, kn AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.vec, b.vec), 9) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, b.vec), 9), b.id) AS rank FROM emb a JOIN emb b ON a.id <> b.id QUALIFY rank <= 5)"""


@query(f"WITH {EMB}, k AS (SELECT a.id AS i, b.id AS j, round(1 - list_cosine_similarity(a.vec, b.vec), 6) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.vec, b.vec), 9), b.id) AS rank FROM emb a JOIN emb b ON a.id <> b.id AND a.id % 100 = 0) SELECT * FROM k WHERE rank <= 10")
def exact_knn(spark: SparkSession, d: str) -> DataFrame:
    """T6, V14"""
    e = embeddings(spark, d)
    return vectors.exact_neighbours(e.where("id % 100 = 0"), e, 10, "cosine").select("i", "j", F.round("dist", 6).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {EMB} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM emb a JOIN emb b ON b.id = a.id + 1")
def trial_scores(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring ids as trials"""
    e = embeddings(spark, d)
    trials = e.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return vectors.trial_scores(trials, e, "a", "b").select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {EMB}, x AS (SELECT id, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM emb), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY pos) SELECT id, CAST(pos AS INTEGER) AS pos, round((x - m) / sd, 5) AS z FROM x JOIN s USING (pos)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """V10, A15"""
    z = vectors.standardize(embeddings(spark, d), "vec", "z")
    return z.select("id", F.posexplode("z").alias("pos", "x")).select("id", "pos", F.round("x", 5).alias("z"))


CENTRE = EMB + ", x AS (SELECT id, label, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM emb), ce AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL) GROUP BY label), cd AS (SELECT emb.id, emb.label, emb.vec, ce.centroid, list_distance(emb.vec, ce.centroid) AS d FROM emb JOIN ce USING (label))"


@query(f"WITH {CENTRE} SELECT id, label, round(d, 6) AS centroid_dist FROM cd")
def centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    """V15, J9"""
    return vectors.with_centroid_distance(embeddings(spark, d), "label").select("id", "label", F.round("centroid_dist", 6).alias("centroid_dist"))


@query(f"WITH {CENTRE} SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), id) AS rank FROM cd QUALIFY rank <= 3")
def closest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    """T5, W11"""
    return vectors.closest_per_cluster(embeddings(spark, d), "label", 3).select("id", "label", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {CENTRE}, sp AS (SELECT label, any_value(centroid) AS c, avg(d) AS s, sum(d * d) AS w, count(*) AS n FROM cd GROUP BY label), g AS (SELECT list(m ORDER BY pos) AS g FROM (SELECT pos, avg(x) AS m FROM x GROUP BY pos)), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM sp a JOIN sp b ON a.label <> b.label GROUP BY a.label), h AS (SELECT sum(n * pow(list_distance(c, g), 2)) AS bt, sum(w) AS wi, sum(n) AS n, count(*) AS k FROM sp, g)
SELECT CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS n, round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round(bt * (n - k) / (wi * (k - 1)), 4) AS calinski_harabasz FROM h""")
def cluster_indices(spark: SparkSession, d: str) -> DataFrame:
    """C7"""
    return vectors.cluster_indices(embeddings(spark, d), "label")


@query(f"""WITH {EMB}, s AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS t, count(*) AS n FROM emb a JOIN emb b ON true GROUP BY ALL), m AS (SELECT id, label, max(t / (n - 1)) FILTER (label = other AND n > 1) AS a, min(t / n) FILTER (label <> other) AS b FROM s GROUP BY ALL)
SELECT id, CAST(label AS VARCHAR) AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM m""")
def silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """C7"""
    return vectors.silhouettes(embeddings(spark, d), "label")


# ---------------------------------------------------------------- graphs
@query(f"WITH {KNN}, s AS (SELECT i, greatest(max(dist), 1e-8) AS s FROM kn GROUP BY i), w AS (SELECT kn.i, kn.j, exp(-dist * dist / (a.s * b.s + 1e-12)) AS w FROM kn JOIN s a ON kn.i = a.i JOIN s b ON kn.j = b.i) SELECT x.i, x.j, round(x.w * y.w, 6) AS w FROM w x JOIN w y ON x.i = y.j AND x.j = y.i UNION ALL SELECT i, i, 0.1 FROM s")
def local_scaled_graph(spark: SparkSession, d: str) -> DataFrame:
    """G2"""
    return graphs.local_scaled(checkpoint(knn(spark, d, 5))).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {KNN}, m AS (SELECT quantile_cont(dist, 0.5) AS s FROM kn WHERE dist > 0), w AS (SELECT i, j, exp(-dist * dist / (2 * s * s)) AS w FROM kn, m), b AS (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) SELECT i, j, round(sum(w) / 2, 6) AS w FROM b GROUP BY i, j UNION ALL SELECT DISTINCT i, i, 0.1 FROM b")
def rbf_affinity(spark: SparkSession, d: str) -> DataFrame:
    """G1, A13"""
    return graphs.affinity(checkpoint(knn(spark, d, 5))).select("i", "j", F.round("w", 6).alias("w"))


ROWS = KNN + ", m AS (SELECT quantile_cont(dist, 0.5) AS s FROM kn WHERE dist > 0), w AS (SELECT i, j, exp(-dist * dist / (2 * s * s)) AS w FROM kn, m), b AS (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w), aff AS (SELECT i, j, sum(w) / 2 AS w FROM b GROUP BY i, j UNION ALL SELECT DISTINCT i, i, 0.1 FROM b), rs AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM aff)"


def row_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.row_stochastic(graphs.affinity(checkpoint(knn(spark, d, 5))))


@query(f"WITH {ROWS} SELECT i, j, round(w, 6) AS w FROM rs")
def row_stochastic(spark: SparkSession, d: str) -> DataFrame:
    """G7"""
    return row_graph(spark, d).select("i", "j", F.round("w", 6).alias("w"))


@query(f"""WITH RECURSIVE {KNN}, e AS (SELECT i AS a, j AS b FROM kn WHERE dist <= 1.12 UNION SELECT j, i FROM kn WHERE dist <= 1.12), r AS (SELECT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a) SELECT a AS id, min(c) AS component FROM r GROUP BY a""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """G6"""
    near = checkpoint(knn(spark, d, 5)).where("dist <= 1.12")
    return connected_components(near.select(F.col("i").alias("a"), F.col("j").alias("b")))


@query()
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest of the mutual reachability graph"""
    return graphs.minimum_spanning_forest(graphs.mutual_reachability(checkpoint(knn(spark, d, 15)), 5)).select("i", "j", F.round("d", 6).alias("d"))


@query(f"""WITH {KNN}, co AS (SELECT i, max(dist) AS c FROM kn WHERE rank <= 5 GROUP BY i), o AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(dist) AS dist FROM kn GROUP BY ALL) SELECT o.i, o.j, round(greatest(a.c, b.c, o.dist), 6) AS d FROM o JOIN co a ON o.i = a.i JOIN co b ON o.j = b.i""")
def mutual_reachability(spark: SparkSession, d: str) -> DataFrame:
    """G8, G10"""
    return graphs.mutual_reachability(checkpoint(knn(spark, d, 5)), 5).select("i", "j", F.round("d", 6).alias("d"))


@query(f"WITH {KNN}, e AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM kn) SELECT (SELECT count(*) FROM emb) AS n_nodes, count(*) AS n_edges, round(2.0 * count(*) / ((SELECT count(*) FROM emb) * ((SELECT count(*) FROM emb) - 1)), 9) AS density FROM e")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """G9"""
    near = checkpoint(knn(spark, d, 5))
    return graphs.graph_stats(near.select("i", "j", F.col("dist").alias("w"))).select("n_nodes", "n_edges", "density")


@query()
def connected_graph(spark: SparkSession, d: str) -> DataFrame:
    """Scaled graph with tree edges, components joined"""
    near = checkpoint(knn(spark, d, 15))
    graph = graphs.local_scaled(near.where("rank <= 5"), mutual="mean", diagonal=None)
    cand = near.select("i", "j", F.col("dist").alias("d"))
    sigma = near.where("rank = 5").agg(F.avg("dist")).first()[0] or 1.0
    tree = graphs.minimum_spanning_forest(cand)
    return graphs.connect(graphs.add_tree_edges(graph, tree, sigma), cand, vectors=embeddings(spark, d)).select("i", "j", F.round("w", 6).alias("w"))


# ---------------------------------------------------------------- propagation (two lowest ids of each label are labelled)
def seeds(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    from pyspark.sql import Window

    e = embeddings(spark, d).select(F.col("id").alias("i"), F.col("label").cast("string").alias("truth"))
    first = F.row_number().over(Window.partitionBy("truth").orderBy("i")) <= 2
    nodes = e.select("i", F.when(first, F.col("truth")).alias("label"), "truth")
    return nodes, propagate.class_list(nodes)


LP = ROWS + """, nodes AS (SELECT id AS i, label AS truth, row_number() OVER (PARTITION BY label ORDER BY id) <= 2 AS seed FROM emb), cl AS (SELECT DISTINCT truth AS c FROM nodes), f0 AS (SELECT i, c, seed, truth, CASE WHEN seed THEN CASE WHEN truth = c THEN 1.0 ELSE 0.0 END ELSE 0.1 END AS f FROM nodes, cl)"""
STEP = """, g{n} AS (SELECT f.i, f.c, f.seed, f.truth, s.v, CASE WHEN f.seed THEN 0.1 * s.v + CASE WHEN f.truth = f.c THEN 0.9 ELSE 0.0 END ELSE s.v END AS g FROM f{p} f JOIN (SELECT rs.i, f.c, 0.95 * sum(rs.w * f.f) AS v FROM rs JOIN f{p} f ON rs.j = f.i GROUP BY ALL) s USING (i, c)),
f{n} AS (SELECT i, c, seed, truth, g / sum(g) OVER (PARTITION BY i) AS f FROM g{n})"""


@query("WITH " + LP + "".join(STEP.format(n=n, p=n - 1) for n in (1, 2, 3)) + " SELECT i, CAST(c AS VARCHAR) AS class, round(f, 6) AS p FROM f3")
def propagation_steps(spark: SparkSession, d: str) -> DataFrame:
    """L3: three steps of the dense variant (uniform start, anchor 0.9)"""
    nodes, classes = seeds(spark, d)
    start = propagate.initial_scores(nodes, classes, uniform=True)
    f, _ = propagate.propagate(checkpoint(row_graph(spark, d)), start, classes, alpha=0.95, manual=0.9, max_iter=3, tol=0.0)
    names = F.array(*[F.lit(c) for c in classes])
    return f.select("i", F.posexplode("f").alias("pos", "p")).select("i", names[F.col("pos")].alias("class"), F.round("p", 6).alias("p"))


@query()
def propagation_converged(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and cluster priors until settled, decided, with margin confidence and self-training"""
    nodes, classes = seeds(spark, d)
    prior = nodes.withColumn("prior", F.col("truth")).withColumn("conf", F.lit(0.8))
    start = propagate.initial_scores(prior, classes, "prior", "conf")
    f, _ = propagate.propagate(checkpoint(row_graph(spark, d)), start, classes, weak=0.05)
    got = propagate.decide(f, classes)
    return got.join(propagate.margin_confidence(f, len(classes)), "i").join(propagate.self_training(nodes, got, 0.5), "i")


@query(f"WITH {SMP} SELECT cluster_label, arg_max(gt_label, sample_id) AS speaker, count(DISTINCT gt_label) > 1 AS conflict FROM smp WHERE gt_label IS NOT NULL AND cluster_label IS NOT NULL GROUP BY 1")
def cluster_speakers(spark: SparkSession, d: str) -> DataFrame:
    """L7, J15"""
    return propagate.cluster_speakers(samples(spark, d), "cluster_label", "gt_label", "sample_id")


# ---------------------------------------------------------------- clustering and selection
@query()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clustering of the embeddings"""
    e = embeddings(spark, d).select("id", "vec")
    return cluster.density_clusters(e, 5, 5, 15).withColumn("prob", F.round("prob", 6)).withColumn("outlier", F.round("outlier", 6))


@query()
def neighbour_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """C8"""
    near = checkpoint(knn(spark, d, 5))
    return cluster.neighbour_diagnostics(near, embeddings(spark, d).select("id", F.col("label").alias("cluster")))


@query()
def mapper_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links of the Mapper complex of the embeddings"""
    e = embeddings(spark, d).select("id", "vec")
    nodes = checkpoint(cluster.mapper_nodes(e, checkpoint(knn(spark, d, 5))))
    return cluster.mapper_links(nodes)


@query()
def kmeans_representatives(spark: SparkSession, d: str) -> DataFrame:
    """C4, S4"""
    return select.representatives(embeddings(spark, d).select("id", "vec"), 20, 10, 10)


@query()
def hybrid_selection(spark: SparkSession, d: str) -> DataFrame:
    """S2, C10, T4, V11"""
    return select.hybrid_selection(embeddings(spark, d).select("id", "vec"), 20, 10, 10)


@query(f"""WITH {CENTRE}, p AS (SELECT id, label, round(d, 9) AS d, (id % 97) / 97.0 AS p FROM cd), s AS (SELECT label, arg_min(id, struct_pack(d := d, id := id)) AS center, arg_min(id, struct_pack(p := p, id := id)) AS unsure, count(*) AS n FROM p GROUP BY label), f AS (
  SELECT e.label, e.id, round(least(list_distance(e.vec, a.vec), list_distance(e.vec, b.vec)), 9) AS g FROM emb e JOIN s USING (label) JOIN emb a ON a.id = s.center JOIN emb b ON b.id = s.unsure WHERE e.id <> s.center AND e.id <> s.unsure AND s.n > 2),
bd AS (SELECT label, arg_min(id, struct_pack(g := -g, id := id)) AS id FROM f GROUP BY label), av AS (SELECT e.label, e.id, round(sum(list_distance(e.vec, o.vec)) / (count(*) - 1), 9) AS g FROM emb e JOIN s USING (label) JOIN emb o ON o.label = e.label WHERE s.unsure = s.center AND s.n > 5 GROUP BY e.label, e.id),
ed AS (SELECT label, arg_min(id, struct_pack(g := -g, id := id)) AS id FROM av WHERE id NOT IN (SELECT center FROM s) AND id NOT IN (SELECT id FROM bd) GROUP BY label)
SELECT label, center AS id, 'centroid' AS reason FROM s UNION ALL SELECT label, unsure, 'uncertain' FROM s WHERE unsure <> center UNION ALL SELECT label, id, 'boundary_diverse' FROM bd UNION ALL SELECT label, id, 'edge_boundary' FROM ed""")
def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for labelling; the certainty is (id mod 97) / 97"""
    e = embeddings(spark, d).withColumn("p", (F.col("id") % 97) / 97.0)
    return select.select_for_labelling(e, "label", "p")


@query(f"""WITH {SMP}, u AS (SELECT sample_id AS id, cluster_label, round(1 - coalesce(prob, 1), 6) AS score FROM smp WHERE cluster_label IS NOT NULL), g AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY score DESC, id) <= 2), h AS (SELECT *, 'group' AS step FROM g ORDER BY score DESC, id LIMIT 50), r AS (SELECT *, 'global' AS step FROM u ANTI JOIN h USING (id) ORDER BY score DESC, id LIMIT greatest(0, 50 - (SELECT count(*) FROM h)))
SELECT * FROM h UNION ALL SELECT * FROM r""")
def uncertain_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The 50 least certain chunks, two per cluster first"""
    u = samples(spark, d).where("cluster_label is not null").select(F.col("sample_id").alias("id"), "cluster_label", F.round(1 - F.coalesce("prob", F.lit(1.0)), 6).alias("score"))
    return select.top_per_group_then_global(u, "cluster_label", "score", 2, 50)


# ---------------------------------------------------------------- sets and the star schema
@query(f"WITH {GT}, {SEG} SELECT rec_id, 'only_truth' AS side FROM (SELECT rec_id FROM gt EXCEPT SELECT rec_id FROM seg) UNION ALL SELECT rec_id, 'only_segments' FROM (SELECT rec_id FROM seg EXCEPT SELECT rec_id FROM gt)")
def unpaired_recordings(spark: SparkSession, d: str) -> DataFrame:
    """U3, J12, R16"""
    g, s = gt(spark, d).select("rec_id").distinct(), segments(spark, d).select("rec_id").distinct()
    return g.join(s, "rec_id", "left_anti").withColumn("side", F.lit("only_truth")).unionByName(s.join(g, "rec_id", "left_anti").withColumn("side", F.lit("only_segments")))


@query(f"WITH {GT}, t AS (SELECT rec_id, count(*) AS n, sum(e - s)::DOUBLE AS ms FROM gt GROUP BY rec_id) SELECT r.rec_id, r.duration, coalesce(n, 0) AS n, round(ms / 1000.0 / r.duration, 6) AS ratio FROM (SELECT rec_id, CASE WHEN isnan(duration) THEN NULL ELSE duration END AS duration FROM recordings) r LEFT JOIN t USING (rec_id)")
def speech_ratio(spark: SparkSession, d: str) -> DataFrame:
    """J7, J10, R17, X22"""
    r = table(spark, d, "recordings").select("rec_id", F.when(~F.isnan("duration"), F.col("duration")).alias("duration"))
    total = gt(spark, d).groupBy("rec_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return r.join(total, "rec_id", "left").select("rec_id", "duration", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("ms") / 1000.0 / F.col("duration"), 6).alias("ratio"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL""")
def grouped_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2 on the star schema"""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
