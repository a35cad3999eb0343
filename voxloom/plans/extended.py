"""Queries of readers and writers (as round trips through files), signals, reports and model steps, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery, scratch_path, table, to_ms
from voxloom.functions import scalars
from voxloom.operators import cluster, dsp, embed, graphs, intervals, metrics, propagate, select, sequences, vectors
from voxloom.plans.reference import KNN, MERGED, SEQ, TABLE, Query, human_edit_match, knn, label_sequence
from voxloom.plans.reference import SQL as REFERENCE
from voxloom.plans.tables import AZ, CHK, EMB, GT, SEG, SMP, azure, chunks, embeddings, first_sql, gt, ms_sql, samples, segments
from voxloom.sources import readers, sinks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- files: written, read again
def _lines(df: DataFrame, *cols, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("value"))


@query(f"WITH {GT} SELECT rec_id AS rec, speaker_label AS speaker, s / 1000.0 AS start, (e - s) / 1000.0 AS length FROM gt")
def vad_text_files(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth as detector text lines, read back"""
    path, g = scratch_path(spark), gt(spark, d)
    line = F.format_string("duration: %.3f, offset: %.3f, speaker_id: %s, wav: /data/%s.wav", (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("start_ms") / 1000, "speaker_label", "rec_id")
    g.select(line.alias("value")).write.text(path)
    got = readers.read_vad_text(spark, path)
    return got.select("rec", "speaker", F.round("start", 3).alias("start"), F.round(F.col("stop") - F.col("start"), 3).alias("length"))


def _gt_files(spark: SparkSession, d: str, columns: int) -> DataFrame:
    path, g = scratch_path(spark), gt(spark, d)
    start, end, one, two = F.format_string("%.3f", F.col("start_ms") / 1000), F.format_string("%.3f", F.col("end_ms") / 1000), F.col("speaker_label"), F.lit("en")
    layout = {3: (start, end, one), 4: (one, two, start, end), 5: (one, two, start, end, F.lit("x")), 6: (one, two, start, end, F.concat("rec_id", F.lit(".wav")), F.pmod("seg_id", F.lit(100)))}[columns]
    _lines(g, *layout).write.text(path)
    return readers.read_gt(spark, path, columns)


@query(f"WITH {GT} SELECT speaker_label AS speaker, s / 1000.0 AS start, e / 1000.0 AS \"end\", rec_id || '.wav' AS filename, CAST(seg_id % 100 AS INTEGER) AS rnd_idx FROM gt")
def gt_tsv_files(spark: SparkSession, d: str) -> DataFrame:
    """Six-column ground truth, written and read back"""
    return _gt_files(spark, d, 6).select("speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "filename", "rnd_idx")


@query(f"WITH {GT} SELECT speaker_label AS speaker, count(*) AS n, sum(e - s) AS ms FROM gt GROUP BY 1")
def gt_three_column_files(spark: SparkSession, d: str) -> DataFrame:
    """Three-column ground truth"""
    ms = lambda c: F.round(F.col(c).cast("double") * 1000).cast("bigint")
    return _gt_files(spark, d, 3).groupBy("speaker").agg(F.count("*").alias("n"), F.sum(ms("end") - ms("start")).alias("ms"))


@query(f"WITH {SEG} SELECT s / 1000.0 AS start, e / 1000.0 AS stop FROM seg WHERE merged_id % 3 <> 0")
def hypothesis_files(spark: SparkSession, d: str) -> DataFrame:
    """A tagged system's file, of which only the tags that count are read"""
    path, s = scratch_path(spark), segments(spark, d)
    tag = F.when(F.col("merged_id") % 3 == 0, "noEnergy").when(F.col("merged_id") % 3 == 1, "male").otherwise("female")
    _lines(s, tag, F.format_string("%.3f", F.col("start_ms") / 1000), F.format_string("%.3f", F.col("end_ms") / 1000)).write.text(path)
    return readers.read_hypothesis(spark, path, "ina").select("start", "stop")


@query(f"""SELECT speaker_id, s / 1000.0 AS start_time, e / 1000.0 AS end_time, conf FROM (SELECT az_id, regexp_replace(speaker_id, '\\s+', '_', 'g') AS speaker_id, {ms_sql("start_time")} AS s, {ms_sql("end_time")} AS e, round(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 4) AS conf FROM {first_sql("azure_diarization", "az_id")}) WHERE s IS NOT NULL AND e IS NOT NULL AND speaker_id <> ''""")
def azure_txt_files(spark: SparkSession, d: str) -> DataFrame:
    """Competitor text files"""
    path = scratch_path(spark)
    a = first_delivery(table(spark, d, "azure_diarization").select("az_id", "speaker_id", "start_time", "end_time", "confidence", "loaded_at"), "az_id")
    a = a.select(F.regexp_replace("speaker_id", r"\s+", "_").alias("speaker"), to_ms(F.col("start_time")).alias("s"), to_ms(F.col("end_time")).alias("e"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("c")).where("s is not null and e is not null and speaker <> ''")
    _lines(a, F.col("speaker"), F.format_string("%.3f", F.col("s") / 1000), F.format_string("%.3f", F.col("e") / 1000), F.lit("words"), F.format_string("%.4f", F.col("c")), F.lit("en")).write.text(path)
    return readers.read_azure(spark, path).select("speaker_id", "start_time", "end_time", F.col("confidence").alias("conf"))


@query(f"SELECT sampleindex, speakerlp, s / 1000.0 AS starttime FROM (SELECT sampleindex, trim(speakerlp) AS speakerlp, {ms_sql('starttime')} AS s FROM {first_sql('human_edits', 'edit_id')}) WHERE s IS NOT NULL AND sampleindex IS NOT NULL AND speakerlp <> '' AND NOT regexp_matches(speakerlp, '\\s')")
def human_edit_files(spark: SparkSession, d: str) -> DataFrame:
    """Labeller TSV with header"""
    path = scratch_path(spark)
    h = first_delivery(table(spark, d, "human_edits").select("edit_id", "sampleindex", "speakerlp", "starttime", "clusterpred", "loaded_at"), "edit_id")
    h = h.select("sampleindex", F.trim("speakerlp").alias("speaker"), to_ms(F.col("starttime")).alias("s"), "clusterpred").where(r"s is not null and sampleindex is not null and speaker <> ''").where(~F.col("speaker").rlike(r"\s"))
    h.select(F.col("sampleindex").alias("SampleIndex"), F.col("speaker").alias("SpeakerLP"), F.format_string("%.3f", F.col("s") / 1000).alias("StartTime"), F.lit("").alias("EndTime"), F.col("clusterpred").alias("ClusterPred")).write.csv(path, sep="\t", header=True)
    return readers.read_human_edits(spark, path).select("sampleindex", "speakerlp", "starttime")


@query(f"WITH {SMP} SELECT CAST(sample_id AS VARCHAR) AS id, CAST(gt_label AS VARCHAR) AS speaker FROM smp WHERE gt_label IS NOT NULL AND sample_id % 2 = 0")
def human_label_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects of id to speaker, one file for each recording; only known ids are kept"""
    path, s = scratch_path(spark), samples(spark, d).where("gt_label is not null")
    s.groupBy("rec_id", F.pmod("sample_id", F.lit(16)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("sample_id").cast("string"), F.col("gt_label").cast("string"))))).alias("value")).repartition("rec_id", "part").select("value", "rec_id", "part").write.partitionBy("rec_id", "part").text(path)
    known = samples(spark, d).where("sample_id % 2 = 0").select(F.col("sample_id").alias("id"))
    return readers.read_human_labels(spark, f"{path}/*/*", known)


def _directory(spark: SparkSession, d: str, shift: int) -> DataFrame:
    """A speaker directory made of the nations of each region, some names changed and some numbers missing for `shift` > 0."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if shift:
        n = n.where(F.col("n_nationkey") % (5 + shift) != 0).withColumn("n_name", F.when(F.col("n_nationkey") % 7 == shift, F.lower("n_name")).otherwise(F.col("n_name")))
    return n.select(F.col("r_name").alias("base"), F.col("n_name").alias("speaker_name"), F.col("n_nationkey").cast("string").alias("speaker_number"))


@query("SELECT r_name AS base, n_name AS speaker_name, CAST(n_nationkey AS VARCHAR) AS speaker_number FROM nation JOIN region ON n_regionkey = r_regionkey")
def speaker_directory_files(spark: SparkSession, d: str) -> DataFrame:
    """Speaker directory as JSON, written and read back"""
    path = scratch_path(spark)
    s = F.struct("speaker_name", "speaker_number", F.lit("").alias("image_64"))
    _directory(spark, d, 0).groupBy("base").agg(F.collect_list(s).alias("speakers")).select(F.to_json(F.map_from_arrays(F.array("base"), F.array(F.struct("speakers")))).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_speakers(spark, path)


_DIRS = """, a AS (SELECT r_name AS base, n_name AS name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey), b AS (SELECT base, CASE WHEN k % 7 = 1 THEN lower(name) ELSE name END AS name, k FROM a WHERE k % 6 <> 0),
c AS (SELECT base, CASE WHEN k % 7 = 2 THEN lower(name) ELSE name END AS name, k FROM a WHERE k % 7 <> 0), p AS (
  SELECT 'gt' AS l, 'wav' AS r, coalesce(a.base, b.base) AS base, coalesce(a.k, b.k) AS k, a.name AS x, b.name AS y FROM a FULL JOIN b USING (base, k) UNION ALL
  SELECT 'gt', 'mp4', coalesce(a.base, c.base), coalesce(a.k, c.k), a.name, c.name FROM a FULL JOIN c USING (base, k) UNION ALL
  SELECT 'wav', 'mp4', coalesce(b.base, c.base), coalesce(b.k, c.k), b.name, c.name FROM b FULL JOIN c USING (base, k))"""


@query("WITH z AS (SELECT 1)" + _DIRS + " SELECT l AS \"left\", r AS \"right\", base, CAST(k AS VARCHAR) AS speaker_number, CASE WHEN x IS NULL THEN 'missing in a' WHEN y IS NULL THEN 'missing in b' ELSE 'other name' END AS what FROM p WHERE x IS NULL OR y IS NULL OR x <> y")
def directory_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three folders, pair by pair"""
    got = readers.compare_directories({"gt": _directory(spark, d, 0), "wav": _directory(spark, d, 1), "mp4": _directory(spark, d, 2)})
    return got.select("left", "right", "base", "speaker_number", "what")


@query(f"WITH {SEG} SELECT rec_id, CAST(cluster_label AS VARCHAR) AS label, printf('%.3f', s / 1000.0) AS start, printf('%.3f', e / 1000.0) AS \"end\" FROM seg WHERE cluster_label IS NOT NULL")
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Sorted predictions as TSV with header, read back as text"""
    path = scratch_path(spark)
    sinks.write_predictions(segments(spark, d).where("cluster_label is not null"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="rec_id string, label string, start string, `end` string")


@query(f"WITH {SEG} SELECT rec_id, merged_id, s, e FROM seg")
def recording_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder for each recording"""
    path = scratch_path(spark)
    sinks.write_by_recording(segments(spark, d).select("rec_id", "merged_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), path)
    return spark.read.schema("merged_id bigint, s bigint, e bigint, rec_id string").csv(path)


@query(f"WITH {SEG} SELECT merged_id, cluster_label, s, e, 'voice' AS \"system\", 'v1' AS run FROM seg")
def dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """A Parquet dataset, overwritten once, with constant columns"""
    path, s = scratch_path(spark), segments(spark, d).select("merged_id", "cluster_label", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    sinks.write_dataset(s.limit(1), path, mode="overwrite")
    sinks.write_dataset(sinks.add_constants(s, system="voice", run="v1"), path, mode="overwrite")
    return spark.read.parquet(path)


@query(f"WITH {SEG} SELECT merged_id, s, CASE WHEN merged_id % 4 = 1 THEN 'new' ELSE 'old' END AS state, CAST(merged_id % 4 AS INTEGER) AS part FROM seg")
def replaced_groups(spark: SparkSession, d: str) -> DataFrame:
    """K3: one group of a dataset replaced, the others kept"""
    path, s = scratch_path(spark), segments(spark, d).select("merged_id", F.col("start_ms").alias("s"), F.pmod("merged_id", F.lit(4)).cast("int").alias("part"))
    sinks.replace_groups(s.withColumn("state", F.lit("old")), path, ["part"])
    sinks.replace_groups(s.where("part = 1").withColumn("state", F.lit("new")), path, ["part"])
    return spark.read.parquet(path).select("merged_id", "s", "state", "part")


@query(f"WITH {SEG} SELECT CAST(merged_id AS VARCHAR) AS merged_unique_id, gt_label, cluster_label AS hdbscan_label, round(prob, 4) AS hdbscan_prob FROM seg")
def lp_result_files(spark: SparkSession, d: str) -> DataFrame:
    """Propagation results as CSV with header"""
    path, s = scratch_path(spark), segments(spark, d)
    sinks.write_selection(s.select(F.col("merged_id").cast("string").alias("merged_unique_id"), "gt_label", F.col("cluster_label").alias("hdbscan_label"), F.round("prob", 4).alias("hdbscan_prob"), F.lit("a").alias("lp_label"), F.lit(0.5).alias("lp_confidence"), F.lit("").alias("human_label")), path)
    return readers.read_lp_results(spark, path).select("merged_unique_id", "gt_label", "hdbscan_label", "hdbscan_prob")


@query("SELECT DISTINCT rec_id AS base, '/gt/' || rec_id || '_gt.csv' AS gt_path, '/pred/' || rec_id || '.txt' AS pred_path FROM gt_segments JOIN (SELECT DISTINCT rec_id FROM merged_samples) USING (rec_id) WHERE rec_id NOT LIKE '%\\_gt' ESCAPE '\\'")
def paired_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of one base name on both sides"""
    names = lambda t, fmt: table(spark, d, t).select("rec_id").where("rec_id is not null").distinct().select(F.format_string(fmt, "rec_id").alias("path"))
    return readers.pair_files(names("gt_segments", "/gt/%s_gt.csv"), names("merged_samples", "/pred/%s.txt"))


@query(f"WITH {SEG} SELECT merged_id, duration FROM seg LEFT JOIN recordings USING (rec_id)")
def segment_durations(spark: SparkSession, d: str) -> DataFrame:
    """Duration of the recording of each segment"""
    return readers.with_duration(segments(spark, d), table(spark, d, "recordings")).select("merged_id", "duration")


@query(f"""WITH f AS (SELECT DISTINCT wav_path AS path FROM samples WHERE wav_path IS NOT NULL), p AS (SELECT path, string_split(regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[A-Za-z]\\w*$', ''), '_')[1] AS speaker FROM f), o AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS label FROM (SELECT speaker FROM p GROUP BY 1 HAVING count(*) >= 5))
SELECT path, speaker, CAST(label AS INTEGER) AS label FROM p JOIN o USING (speaker)""")
def speaker_index(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of at least five files, numbered"""
    return readers.speaker_index(table(spark, d, "samples").select(F.col("wav_path").alias("path")).where("path is not null").distinct())


@query(f"WITH {GT} SELECT seg_id, row_number() OVER (ORDER BY rec_id, s, seg_id) - 1 AS cut_no FROM gt")
def running_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Intervals numbered through the corpus"""
    return readers.running_cuts(gt(spark, d).select("seg_id", "rec_id", "start_ms"), ["rec_id", "start_ms", "seg_id"]).select("seg_id", "cut_no")


# ---------------------------------------------------------------- intervals and reports
@query(MERGED + " SELECT rec_id, speaker_label, min(s) AS start_ms, count(*) AS n FROM i GROUP BY rec_id, speaker_label, island HAVING count(*) >= 2")
def gap_merge_of_two(spark: SparkSession, d: str) -> DataFrame:
    """merged periods of at least two rows"""
    return intervals.gap_merge(gt(spark, d), ["rec_id", "speaker_label"], "start_ms", "end_ms", "seg_id", min_rows=2).select("rec_id", "speaker_label", "start_ms", "n")


@query(f"""WITH {AZ}, {GT}, sl AS (SELECT DISTINCT rec_id, speaker AS sys_label FROM az), gl AS (SELECT DISTINCT rec_id, speaker_label AS gt_label FROM gt), o AS (
  SELECT az.rec_id, az.speaker AS sys_label, gt.speaker_label AS gt_label, sum(greatest(0, least(az.e, gt.e) - greatest(az.s, gt.s))) AS ms FROM az JOIN gt ON az.rec_id = gt.rec_id AND az.e > gt.s AND az.s < gt.e GROUP BY ALL)
SELECT rec_id, sys_label, gt_label, CAST(coalesce(ms, 0) AS BIGINT) AS overlap_ms FROM sl JOIN gl USING (rec_id) LEFT JOIN o USING (rec_id, sys_label, gt_label)""")
def overlap_matrix_full(spark: SparkSession, d: str) -> DataFrame:
    """With zero cells"""
    return intervals.overlap_matrix(azure(spark, d), gt(spark, d), ["rec_id"], "speaker", "speaker_label", zeros=True)


@query(f"""WITH {GT}, {SEG}, du AS (SELECT rec_id, CAST(round(duration * 1000) AS BIGINT) AS duration_ms FROM recordings), x AS (
  SELECT rec_id, greatest(s, 0) AS s, least(e, coalesce(duration_ms, e)) AS e, side, duration_ms FROM (SELECT rec_id, s, e, 'g' AS side FROM gt UNION ALL SELECT rec_id, s, e, 'p' FROM seg) LEFT JOIN du USING (rec_id)), ok AS (SELECT * FROM x WHERE e > s), y AS (
  SELECT rec_id, s, e, side FROM ok UNION ALL SELECT rec_id, s, e, 'u' FROM ok), r AS (
  SELECT *, max(e) OVER (PARTITION BY rec_id, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM y), c AS (
  SELECT rec_id, CAST(coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'g'), 0) AS BIGINT) AS gt_ms, CAST(coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'p'), 0) AS BIGINT) AS pred_ms,
  CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) FILTER (side = 'u') AS BIGINT) AS u FROM r GROUP BY rec_id), z AS (SELECT rec_id, gt_ms, pred_ms, u - pred_ms AS miss_ms, u - gt_ms AS false_alarm_ms, duration_ms FROM c LEFT JOIN du USING (rec_id))
SELECT rec_id, miss_ms, false_alarm_ms, duration_ms, CASE WHEN gt_ms > 0 THEN round((miss_ms + false_alarm_ms) * 1.0 / gt_ms, 6) END AS error_rate, CASE WHEN duration_ms > 0 THEN round((duration_ms - miss_ms - false_alarm_ms) * 1.0 / duration_ms, 6) END AS accuracy FROM z""")
def detection_within_duration(spark: SparkSession, d: str) -> DataFrame:
    """Cut to [0, duration], with error rate and accuracy"""
    durations = table(spark, d, "recordings").select("rec_id", to_ms(F.col("duration")).alias("duration_ms"))
    return metrics.speech_detection(gt(spark, d), segments(spark, d), ["rec_id"], durations).select("rec_id", "miss_ms", "false_alarm_ms", "duration_ms", "error_rate", "accuracy")


@query(SEQ + """, sm AS (SELECT rec_id, run, label, n, lag(label) OVER w AS pl, lag(n) OVER w AS pn, lead(label) OVER w AS ql, lead(n) OVER w AS qn FROM runs WINDOW w AS (PARTITION BY rec_id ORDER BY run)), kp AS (
  SELECT rec_id, run, label, CASE WHEN n <= 2 THEN NULL ELSE label END AS kept FROM sm), fl AS (
  SELECT rec_id, run, coalesce(last_value(kept IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(kept IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), first_value(label) OVER (PARTITION BY rec_id ORDER BY run)) AS smoothed FROM kp), o AS (
  SELECT merged_id, rec_id, ru.label, smoothed, row_number() OVER (PARTITION BY rec_id ORDER BY s, merged_id) AS k FROM ru JOIN fl USING (rec_id, run)), b1 AS (
  SELECT rec_id, label, k - row_number() OVER (PARTITION BY rec_id, label ORDER BY k) AS g, k FROM o), r1 AS (SELECT rec_id, label, min(k) AS first, max(k) AS last, count(*) AS n FROM b1 GROUP BY rec_id, label, g), b2 AS (
  SELECT rec_id, smoothed AS label, k - row_number() OVER (PARTITION BY rec_id, smoothed ORDER BY k) AS g, k FROM o), r2 AS (SELECT rec_id, label, min(k) AS first, max(k) AS last FROM b2 GROUP BY rec_id, label, g)
SELECT rec_id, label, first, last, n, round(n * 0.4, 6) AS seconds, round(n * 0.4, 6) <= 1.2 AS brief FROM r1 WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.rec_id = r1.rec_id AND r2.label = r1.label AND abs(r2.first - r1.first) <= 2 AND abs(r2.last - r1.last) <= 2)""")
def smoothing_removed(spark: SparkSession, d: str) -> DataFrame:
    """Runs that smoothing took away"""
    rows = sequences.smooth_labels(label_sequence(spark, d), ["rec_id"], "b", ["start_ms", "merged_id"], "label")
    from voxloom.operators.ordered import carried

    rows = carried(checkpoint(rows), ["rec_id"], "b", ["start_ms", "merged_id"], {"k": ("sum", F.lit(1))})
    return sequences.smoothing_report(rows, ["rec_id"], "b", "k", "label", "smoothed").select("rec_id", "label", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n", "seconds", "brief")


@query(f"WITH {SEG} SELECT merged_id, rec_id, round(percent_rank() OVER (PARTITION BY rec_id ORDER BY s, merged_id), 6) AS place FROM seg WHERE s >= 60000 AND s < 80000")
def twenty_seconds(spark: SparkSession, d: str) -> DataFrame:
    """What starts in a window of twenty seconds, with its rank"""
    return sequences.time_window(segments(spark, d), ["rec_id"], 60_000, 20_000, "merged_id").select("merged_id", "rec_id", "place")


@query(f"WITH {SEG} SELECT rec_id, count(*) AS n, min(s) AS first_ms, max(e) AS last_ms, string_agg(CAST(merged_id AS VARCHAR), ' ' ORDER BY merged_id) AS ids FROM seg GROUP BY rec_id")
def recording_index(spark: SparkSession, d: str) -> DataFrame:
    """Count, bounds and the list of rows of each recording"""
    s = segments(spark, d)
    return s.groupBy("rec_id").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.array_join(F.transform(F.array_sort(F.collect_list("merged_id")), lambda x: x.cast("string")), " ").alias("ids"))


@query(f"WITH {SMP}, c AS (SELECT cluster_label, CAST(gt_label AS VARCHAR) AS t, count(*) AS n FROM smp WHERE cluster_label IS NOT NULL AND cluster_label <> -1 AND gt_label IS NOT NULL GROUP BY ALL) SELECT cluster_label, CAST(sum(n) AS BIGINT) AS n, string_agg(t || ':' || n, ' ' ORDER BY t) AS histogram FROM c GROUP BY cluster_label")
def cluster_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A5: true labels in each cluster"""
    got = cluster.cluster_histogram(samples(spark, d), "cluster_label", "gt_label")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    return got.select("cluster_label", "n", text.alias("histogram"))


ENTROPY = """SELECT rec_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS e, round(CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0 END, 6) AS z FROM ({}) GROUP BY rec_id"""


@query(TABLE + ", per AS (SELECT rec_id, gt_label, cluster_label, major FROM smp JOIN mj ON cluster_label = c WHERE rec_id IS NOT NULL), g AS (" + ENTROPY.format("SELECT rec_id, gt_label, count(*) AS n FROM per WHERE gt_label IS NOT NULL GROUP BY ALL") + "), p AS (" + ENTROPY.format("SELECT rec_id, cluster_label, count(*) AS n FROM per GROUP BY ALL") + "), m AS (" + ENTROPY.format("SELECT rec_id, major, count(*) AS n FROM per WHERE major IS NOT NULL GROUP BY ALL") + ") SELECT rec_id, g.e AS gt_entropy, g.z AS gt_normalized, p.e AS pred_entropy, p.z AS pred_normalized, m.e AS matched_entropy, m.z AS matched_normalized FROM p FULL JOIN g USING (rec_id) FULL JOIN m USING (rec_id)")
def recording_entropies(spark: SparkSession, d: str) -> DataFrame:
    """Truth, prediction and matched side by side"""
    s = samples(spark, d).where("rec_id is not null")
    rows = s.join(metrics.majority(metrics.contingency(samples(spark, d), "gt_label", "cluster_label")), s.cluster_label == F.col("p"))
    return metrics.label_entropies(checkpoint(rows.select("rec_id", "gt_label", "cluster_label", "major")), {"gt": "gt_label", "pred": "cluster_label", "matched": "major"}, ["rec_id"])


@query(TABLE + """, tf AS (SELECT rec_id, gt_label AS y, major AS p, count(*) AS n FROM smp JOIN mj ON cluster_label = c WHERE rec_id IS NOT NULL AND gt_label IS NOT NULL GROUP BY ALL), u AS (SELECT * FROM tf UNION ALL SELECT NULL, y, p, sum(n) FROM tf GROUP BY y, p), l AS (
  SELECT rec_id, y AS label, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS pre FROM u UNION ALL SELECT rec_id, p, 0, 0, n FROM u), k AS (SELECT rec_id, label, sum(tp) AS tp, sum(sup) AS sup, sum(pre) AS pre FROM l GROUP BY ALL), q AS (
  SELECT *, CASE WHEN pre > 0 THEN tp * 1.0 / pre ELSE 0.0 END AS pr, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0.0 END AS re FROM k), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM q)
SELECT rec_id, CAST(sum(sup) AS BIGINT) AS n, round(sum(tp) * 1.0 / sum(sup), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY rec_id""")
def file_report(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro scores of each recording and overall"""
    s = samples(spark, d)
    rows = s.join(metrics.majority(metrics.contingency(s, "gt_label", "cluster_label")), s.cluster_label == F.col("p"))
    return metrics.file_report(rows.select("rec_id", "gt_label", "major"), "rec_id", "gt_label", "major").select("rec_id", "n", "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(TABLE + ", e AS (SELECT rec_id, avg(CASE WHEN gt_label = major THEN 1.0 ELSE 0.0 END) AS a FROM smp JOIN mj ON cluster_label = c WHERE rec_id IS NOT NULL AND gt_label IS NOT NULL GROUP BY rec_id) SELECT count(*) AS n_episodes, round(avg(a), 6) AS accuracy, round(stddev_samp(a), 6) AS std, round(1.96 * stddev_samp(a) / sqrt(count(*)), 6) AS ci95 FROM e")
def episode_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Each recording an episode"""
    s = samples(spark, d)
    rows = s.join(metrics.majority(metrics.contingency(s, "gt_label", "cluster_label")), s.cluster_label == F.col("p"))
    return metrics.episode_accuracy(rows, "rec_id", F.col("gt_label") == F.col("major"))


@query(f"WITH h AS (SELECT edit_id FROM {first_sql('human_edits', 'edit_id')}), m AS ({REFERENCE['human_edit_match']}) SELECT edit_id, coalesce(action, 'unmatched') AS action, overlap_pct FROM h LEFT JOIN m USING (edit_id)")
def matching_rows(spark: SparkSession, d: str) -> DataFrame:
    """K8: what became of each edit"""
    edits = first_delivery(table(spark, d, "human_edits").select("edit_id", "loaded_at"), "edit_id")
    return sinks.matching_rows(edits, human_edit_match(spark, d))


@query(f"WITH {SMP} SELECT sample_id, 'above' AS side, round(prob, 6) AS confidence FROM smp WHERE prob >= 0.8 UNION ALL SELECT sample_id, 'below', round(1 - prob, 6) FROM smp WHERE prob < 0.8")
def threshold_split(spark: SparkSession, d: str) -> DataFrame:
    """two outputs with the confidence of the decision"""
    above, below = metrics.threshold_split(samples(spark, d).select("sample_id", "prob"), "prob", 0.8)
    both = above.withColumn("side", F.lit("above")).unionByName(below.withColumn("side", F.lit("below")))
    return both.select("sample_id", "side", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CHK}, r AS (SELECT sample_id AS id, name_rec, round(1 - prob, 6) AS score, s, e, row_number() OVER (PARTITION BY name_rec ORDER BY round(1 - prob, 6) DESC NULLS LAST, sample_id) AS rank FROM chk WHERE name_rec IS NOT NULL) SELECT id, name_rec, score, rank, coalesce(s / 1000.0, 0.0) AS start, coalesce(e / 1000.0, 0.0) AS stop FROM r WHERE rank <= 3")
def selection_by_recording(spark: SparkSession, d: str) -> DataFrame:
    """The three least certain chunks of each recording with the times of their names"""
    c = chunks(spark, d).select(F.col("sample_id").alias("id"), "name_rec", F.round(1 - F.col("prob"), 6).alias("score"), "start_ms", "stop_ms")
    return select.selection_by_recording(c, "name_rec", "score")


# ---------------------------------------------------------------- arrays, maps, ranges
@query("SELECT merged_id, list_filter(constituent_ids, lambda x: NOT list_contains(list_slice(constituent_ids, 1, 2), x)) AS ids FROM " + first_sql("merged_samples", "merged_id") + " WHERE constituent_ids IS NOT NULL")
def list_differences(spark: SparkSession, d: str) -> DataFrame:
    """Constituents without the first two"""
    m = first_delivery(table(spark, d, "merged_samples").select("merged_id", "constituent_ids", "loaded_at"), "merged_id")
    return m.where("constituent_ids is not null").select("merged_id", scalars.list_difference(F.col("constituent_ids"), F.slice("constituent_ids", 1, 2)).alias("ids"))


@query("SELECT n_regionkey, coalesce(max(n_name) FILTER (n_nationkey = 5), 'none') AS fifth, coalesce(max(n_nationkey) FILTER (n_name = 'CHINA'), -1) AS china FROM nation GROUP BY n_regionkey")
def map_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Get with default, and the inverted map"""
    m = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    key = dict(table(spark, d, "nation").dtypes)["n_nationkey"]
    return m.select("n_regionkey", scalars.map_get(F.col("m"), F.lit(5).cast(key), F.lit("none")).alias("fifth"), scalars.map_get(scalars.map_invert(F.col("m")), F.lit("CHINA"), F.lit(-1).cast(key)).alias("china"))


@query(f"WITH {SMP}, r AS (SELECT min(prob) AS lp, max(prob) AS hp, min(outlier) AS lo, max(outlier) AS ho FROM smp) SELECT sample_id, round((prob - lp) / (hp - lp), 6) AS prob, round((outlier - lo) / (ho - lo), 6) AS outlier FROM smp, r")
def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    """B16"""
    return vectors.min_max(samples(spark, d).select("sample_id", "prob", "outlier"), ["prob", "outlier"]).select("sample_id", F.round("prob", 6).alias("prob"), F.round("outlier", 6).alias("outlier"))


@query(f"WITH {EMB}, f AS (SELECT id, vec, unnest(range(0, CAST(ceil((len(vec) - 16) / 8.0) AS BIGINT) + 1)) AS k FROM emb) SELECT id, CAST(k AS INTEGER) AS frame, round(list_sum(list_slice(vec, k * 8 + 1, k * 8 + 16)), 5) AS total FROM f")
def vector_frames(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 16 values every 8"""
    e = embeddings(spark, d).select("id", F.posexplode(sequences.array_frames(F.col("vec"), 16, 8)).alias("frame", "v"))
    return e.select("id", "frame", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {EMB}, p AS (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS t FROM emb) SELECT id, CAST(t - 1 AS INTEGER) AS pos, round((vec[least(t + 1, len(vec))] - vec[greatest(t - 1, 1)] + 2 * (vec[least(t + 2, len(vec))] - vec[greatest(t - 2, 1)])) / 10, 6) AS slope FROM p")
def vector_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Slope over two places to either side"""
    return embeddings(spark, d).select("id", F.posexplode(sequences.delta(F.col("vec"), 2)).alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("slope"))


def _signals(spark: SparkSession, d: str, what) -> DataFrame:
    """Each embedding as a signal, handed to `what` as a matrix with one row for each: id, pos, x."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = what(vectors.as_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "v"])

    return embeddings(spark, d).select("id", "vec").mapInArrow(run, "id bigint, v array<double>").select("id", F.posexplode("v").alias("pos", "x"))


@query(f"WITH {EMB}, p AS (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS t FROM emb) SELECT id, CAST(t - 1 AS INTEGER) AS pos, round(CASE WHEN t = 1 THEN vec[1] ELSE vec[t] - 0.97 * vec[t - 1] END, 6) AS x FROM p")
def pre_emphasis(spark: SparkSession, d: str) -> DataFrame:
    """V1: first differences with factor 0.97"""
    return _signals(spark, d, lambda m: np.stack([dsp.preemphasis(row) for row in m])).select("id", "pos", F.round("x", 6).alias("x"))


@query(f"""WITH {EMB}, v AS (SELECT id, vec[1:64] AS x FROM emb), t AS (SELECT id, unnest(x) AS y, unnest(range(0, 64)) AS t FROM v), k AS (SELECT unnest(range(0, 33)) AS k), c AS (SELECT id, k, sum(y * cos(2 * pi() * k * t / 64)) AS re, sum(y * sin(2 * pi() * k * t / 64)) AS im FROM t, k GROUP BY id, k)
SELECT id, CAST(k AS INTEGER) AS pos, round((re * re + im * im) / 64, 5) AS x FROM c""")
def power_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Power spectrum of a frame of 64 values"""
    return _signals(spark, d, lambda m: np.concatenate([dsp.power_spectrum(dsp.frames(row[:64], 64, 64)[:1], 64) for row in m])).select("id", "pos", F.round("x", 5).alias("x"))


@query(f"WITH {SMP} SELECT sample_id, round(avg(coalesce(prob, 0)) OVER (PARTITION BY rec_id ORDER BY sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS last_mean FROM smp WHERE rec_id IS NOT NULL")
def last_five_mean(spark: SparkSession, d: str) -> DataFrame:
    """W12"""
    s = samples(spark, d).where("rec_id is not null").withColumn("v", F.coalesce("prob", F.lit(0.0)))
    return sequences.last_mean(s, ["rec_id"], "sample_id", "v").select("sample_id", F.round("last_mean", 6).alias("last_mean"))


@query(f"WITH {SMP} SELECT rec_id, CAST(floor(sample_id / 512) AS BIGINT) AS block, round(sum(coalesce(prob, 0)) / 512, 6) AS mean, round(max(coalesce(prob, 0)), 6) AS max FROM smp WHERE rec_id IS NOT NULL GROUP BY ALL")
def block_scores(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 512 places"""
    s = samples(spark, d).where("rec_id is not null").withColumn("v", F.coalesce("prob", F.lit(0.0)))
    return sequences.block_scores(s, ["rec_id"], "sample_id", "v").select("rec_id", "block", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query(f"WITH {EMB} SELECT id, round(list_avg(vec), 6) AS mean FROM emb")
def vector_means(spark: SparkSession, d: str) -> DataFrame:
    """B10"""
    return embeddings(spark, d).select("id", F.round(vectors.vector_mean(F.col("vec")), 6).alias("mean"))


# ---------------------------------------------------------------- graphs and propagation
@query(f"WITH {KNN}, c AS (SELECT i, max(dist) AS core FROM kn GROUP BY i), o AS (SELECT kn.i, kn.j, exp(-greatest(a.core, b.core, dist)) / 2 AS w FROM kn JOIN c a ON a.i = kn.i JOIN c b ON b.i = kn.j), b AS (SELECT i, j, w FROM o UNION ALL SELECT j, i, w FROM o) SELECT i, j, round(sum(w), 6) AS w FROM b GROUP BY i, j UNION ALL SELECT i, i, 0.1 FROM c")
def reachability_kernel(spark: SparkSession, d: str) -> DataFrame:
    """G8"""
    return graphs.reachability_kernel(knn(spark, d, 5), 5).select("i", "j", F.round("w", 6).alias("w"))


def _adaptive(sigma: str) -> str:
    return f"WITH {KNN}, s AS (SELECT i, greatest({sigma}, 1e-8) AS s FROM kn GROUP BY i), o AS (SELECT kn.i, kn.j, exp(-dist * dist / (a.s * b.s + 1e-8)) / 2 AS w FROM kn JOIN s a ON a.i = kn.i JOIN s b ON b.i = kn.j), b AS (SELECT i, j, w FROM o UNION ALL SELECT j, i, w FROM o) SELECT i, j, round(sum(w), 6) AS w FROM b GROUP BY i, j"


@query(_adaptive("median(dist)"))
def adaptive_graph_median(spark: SparkSession, d: str) -> DataFrame:
    """scale = median of a row's neighbour distances"""
    return graphs.adaptive_graph(knn(spark, d, 5), 5, "median").select("i", "j", F.round("w", 6).alias("w"))


@query(_adaptive("avg(dist)"))
def adaptive_graph_mean(spark: SparkSession, d: str) -> DataFrame:
    """scale = mean"""
    return graphs.adaptive_graph(knn(spark, d, 5), 5, "mean").select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {KNN}, g AS (SELECT median(dist) AS s FROM kn), o AS (SELECT i, j, exp(-dist * dist / (s * s + 1e-8)) / 2 AS w FROM kn, g), b AS (SELECT i, j, w FROM o UNION ALL SELECT j, i, w FROM o) SELECT i, j, round(sum(w), 6) AS w FROM b GROUP BY i, j")
def adaptive_graph_global(spark: SparkSession, d: str) -> DataFrame:
    """One scale"""
    return graphs.adaptive_graph(knn(spark, d, 5), 5, "global").select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {EMB}, n AS (SELECT id AS i, CASE WHEN id % 10 = 0 THEN label END AS label, label AS prior, (id % 97) / 97.0 AS conf, (SELECT count(DISTINCT label) FROM emb WHERE id % 10 = 0) AS k, label IN (SELECT label FROM emb WHERE id % 10 = 0) AS known FROM emb) SELECT i, CASE WHEN label IS NOT NULL THEN CAST(label AS VARCHAR) WHEN known AND conf >= 0.7 THEN CASE WHEN 0.5 * conf >= (1 - 0.5 * conf) / greatest(k - 1, 1) THEN CAST(prior AS VARCHAR) ELSE 'other' END ELSE 'unlabeled' END AS decided FROM n")
def initial_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Scores before any step, decided; where another class leads it is named `other`"""
    e = embeddings(spark, d)
    n = e.select(F.col("id").alias("i"), F.when(F.col("id") % 10 == 0, F.col("label").cast("string")).alias("label"), F.col("label").cast("string").alias("prior"), ((F.col("id") % 97) / 97.0).alias("conf"))
    classes = propagate.class_list(n)
    got = propagate.decide(propagate.initial_scores(n, classes, "prior", "conf").select("i", F.col("y").alias("f")), classes).join(n, "i")
    return got.select("i", F.when((F.col("lp_label") == F.coalesce("label", "prior")) | (F.col("lp_label") == "unlabeled"), F.col("lp_label")).otherwise("other").alias("decided"))


@query(f"WITH {SMP} SELECT sample_id AS i, CASE WHEN gt_label IS NOT NULL AND sample_id % 5 = 0 THEN CAST(gt_label AS VARCHAR) WHEN prob > 0.9 AND cluster_label IS NOT NULL THEN CAST(cluster_label AS VARCHAR) END AS label, NOT (gt_label IS NOT NULL AND sample_id % 5 = 0) AND coalesce(prob > 0.9, false) AND cluster_label IS NOT NULL AS added FROM smp")
def self_training(spark: SparkSession, d: str) -> DataFrame:
    """Labels taken over where the decision is confident"""
    s = samples(spark, d)
    nodes = s.select(F.col("sample_id").alias("i"), F.when(F.col("sample_id") % 5 == 0, F.col("gt_label").cast("string")).alias("label"))
    return propagate.self_training(nodes, s.select(F.col("sample_id").alias("i"), F.col("cluster_label").cast("string").alias("lp_label"), F.col("prob").alias("lp_confidence")))


@query(f"WITH {KNN}, m AS (SELECT median(dist) AS s FROM kn WHERE rank <= 3 AND dist > 0), w AS (SELECT i, j, exp(-dist * dist / (2 * s * s)) AS w FROM kn, m WHERE rank <= 3), b AS (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) SELECT i, j, round(sum(w) / 2, 6) AS w FROM b GROUP BY i, j UNION ALL SELECT DISTINCT i, i, 0.1 FROM b")
def sparse_affinity(spark: SparkSession, d: str) -> DataFrame:
    """G1: cut to the three nearest"""
    return graphs.affinity(knn(spark, d, 5), k=3).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {KNN} SELECT i, j, round(1 / (1 + dist), 6) AS w FROM kn UNION ALL SELECT DISTINCT i, i, 0.1 FROM (SELECT i FROM kn UNION SELECT j FROM kn)")
def inverse_affinity(spark: SparkSession, d: str) -> DataFrame:
    """G1: 1 / (1 + d), one-sided"""
    return graphs.affinity(knn(spark, d, 5), "inverse", symmetric=False).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {EMB}, k AS (SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))), 6) AS dist FROM emb a JOIN emb b ON a.id <> b.id AND a.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM k) SELECT i, j, dist, rank FROM r WHERE rank <= 5")
def manhattan_knn(spark: SparkSession, d: str) -> DataFrame:
    """Manhattan distances, for ids divisible by 100"""
    e = embeddings(spark, d)
    return vectors.exact_neighbours(e.where("id % 100 = 0"), e, 5, "manhattan").select("i", "j", F.round("dist", 6).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query()
def complete_tree(spark: SparkSession, d: str) -> DataFrame:
    """Exact spanning tree of the complete graph"""
    return graphs.spanning_tree(embeddings(spark, d).select("id", "vec")).select("i", "j", F.round("d", 6).alias("d"))


@query()
def anchored_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Until the largest change is below 1e-6, with margin confidence"""
    e = embeddings(spark, d).select(F.col("id").alias("i"), F.col("label").cast("string").alias("truth"))
    nodes = e.select("i", F.when(F.row_number().over(Window.partitionBy("truth").orderBy("i")) <= 3, F.col("truth")).alias("label"))
    classes = propagate.class_list(nodes)
    edges = checkpoint(graphs.row_stochastic(graphs.adaptive_graph(knn(spark, d, 5), 5, "kth")))
    f, _ = propagate.propagate_anchored(edges, propagate.initial_scores(nodes, classes, uniform=True), len(classes))
    return propagate.decide(f, classes).join(propagate.margin_confidence(f, len(classes)), "i")


# ---------------------------------------------------------------- clusters, selection, embeddings
@query(f"WITH {EMB}, x AS (SELECT label, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM emb), ce AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL) GROUP BY label), s AS (SELECT id, ce.label, 1 / greatest(list_distance(vec, c), 1e-9) AS w FROM emb, ce), h AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS share FROM s) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(share, 12) DESC, label) AS INTEGER) AS rank, label AS cluster, round(share, 6) AS share FROM h QUALIFY rank <= 5")
def soft_memberships(spark: SparkSession, d: str) -> DataFrame:
    """The five clusters each row belongs to most"""
    return vectors.soft_memberships(embeddings(spark, d), "label").select("id", "rank", "cluster", F.round("share", 6).alias("share"))


@query()
def density_profile(spark: SparkSession, d: str) -> DataFrame:
    """Birth and largest lambda, stability and persistence of each density cluster"""
    return cluster.density_clusters(embeddings(spark, d).select("id", "vec"), 10, 5, 15, profile=True)


@query("SELECT gt_label, n, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS n_test FROM (SELECT gt_label, count(*) AS n FROM (" + f"WITH {SMP} SELECT * FROM smp) WHERE gt_label IS NOT NULL GROUP BY 1)")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and test rows of each label"""
    s = samples(spark, d).where("gt_label is not null").select(F.col("sample_id").alias("id"), "gt_label")
    return select.stratified_split(s, "gt_label").groupBy("gt_label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("bigint")).alias("n_test"))


@query(f"WITH {SMP}, n AS (SELECT count(DISTINCT gt_label) AS n FROM smp WHERE gt_label IS NOT NULL) SELECT k AS subset, k AS n_labels FROM n, unnest(range(2, n.n + 1)) AS t(k)")
def nested_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels in each of the growing subsets"""
    got = select.nested_speakers(samples(spark, d), "gt_label")
    return got.groupBy(F.col("subset").cast("bigint").alias("subset")).agg(F.count("*").alias("n_labels"))


@query()
def svm_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Uncertainty under a kernel machine with calibrated margins"""
    return select.svm_uncertainty(embeddings(spark, d), "label")


@query()
def umap_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates"""
    return embed.umap(embeddings(spark, d).select("id", "vec"), 2).select("id", F.round(F.col("reduced")[0], 6).alias("x"), F.round(F.col("reduced")[1], 6).alias("y"))


@query()
def tsne_embedding(spark: SparkSession, d: str) -> DataFrame:
    """V13"""
    return embed.tsne(embeddings(spark, d).select("id", "vec")).select("id", F.round(F.col("reduced")[0], 6).alias("x"), F.round(F.col("reduced")[1], 6).alias("y"))


@query()
def learned_metric_graph(spark: SparkSession, d: str) -> DataFrame:
    """Large-margin transform, affinities of the neighbours in it, tree edges at 0.1 and more"""
    e = embeddings(spark, d)
    mean, matrix = vectors.fit_lmnn(e, "vec", "label")
    moved = checkpoint(vectors.apply_matrix(e, "vec", mean, matrix, "z").select("id", F.col("z").alias("vec")))
    near = checkpoint(vectors.exact_neighbours(moved, moved, 5, "euclidean"))
    graph = graphs.affinity(near)
    lifted = graphs.connect(graph, near.select("i", "j", F.col("dist").alias("d")), vectors=moved, metric="euclidean")
    return lifted.select("i", "j", F.round("w", 6).alias("w"))
