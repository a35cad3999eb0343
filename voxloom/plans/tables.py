"""The project's tables in the form the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.common import clean_label, first_delivery, table, to_ms
from voxloom.functions.scalars import parse_chunk_name
from voxloom.operators.periods import speaking_intervals
from voxloom.operators.vectors import usable


def gt(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth: seg_id, rec_id, speaker_label, start_ms, end_ms."""
    return speaking_intervals(table(spark, d, "gt_segments"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Merged segments with times: merged_id, rec_id, cluster_label, gt_label, prob, start_ms, end_ms."""
    m = first_delivery(table(spark, d, "merged_samples").select("merged_id", "rec_id", "cluster_labels", "gt_labels", "cluster_probs", "start_times", "end_times", "loaded_at"), "merged_id")
    m = m.select("merged_id", "rec_id", F.col("cluster_labels").alias("cluster_label"), F.col("gt_labels").alias("gt_label"), F.when(~F.isnan("cluster_probs"), F.col("cluster_probs").cast("double")).alias("prob"), to_ms(F.col("start_times")).alias("start_ms"), to_ms(F.col("end_times")).alias("end_ms"))
    return m.where("end_ms > start_ms and rec_id is not null")


def azure(spark: SparkSession, d: str) -> DataFrame:
    """Competitor rows with times and a label in their field: az_id, rec_id, speaker, start_ms, end_ms, conf (0 to 1)."""
    a = first_delivery(table(spark, d, "azure_diarization").select("az_id", "rec_id", "speaker_id", "start_time", "end_time", "confidence", "loaded_at"), "az_id")
    conf = F.when(~F.isnan("confidence"), F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")))
    a = a.select("az_id", "rec_id", clean_label(F.col("speaker_id")).alias("speaker"), to_ms(F.col("start_time")).alias("start_ms"), to_ms(F.col("end_time")).alias("end_ms"), conf.alias("conf"))
    return a.where("end_ms > start_ms and rec_id is not null and speaker is not null")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Chunks: sample_id, rec_id, gt_label, cluster_label, prob, outlier (first deliveries)."""
    s = first_delivery(table(spark, d, "samples").select("sample_id", "rec_id", "gt_labels", "cluster_labels", "cluster_probs", "outlier_scores", "loaded_at"), "sample_id")
    real = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    return s.select("sample_id", "rec_id", F.col("gt_labels").alias("gt_label"), F.col("cluster_labels").alias("cluster_label"), real("cluster_probs").alias("prob"), real("outlier_scores").alias("outlier"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the fields of their file names: sample_id, cluster_label, gt_label, unique_id, name_rec, voice, start_ms, stop_ms, prob."""
    s = first_delivery(table(spark, d, "samples").select("sample_id", "unique_id", "wav_path", "gt_labels", "cluster_labels", "loaded_at"), "sample_id")
    f = parse_chunk_name(F.col("wav_path"))
    return s.select("sample_id", "unique_id", F.col("gt_labels").alias("gt_label"), F.col("cluster_labels").alias("cluster_label"), f["rec"].alias("name_rec"), f["speaker"].alias("voice"), f["start_ms"].alias("start_ms"), f["stop_ms"].alias("stop_ms"), f["prob"].alias("prob"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """id, vec (double), label of the embeddings table."""
    return usable(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def first_sql(name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at) AS rn FROM {name}) WHERE rn = 1)"


def ms_sql(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE TRY_CAST(round({c} * 1000) AS BIGINT) END"


def label_sql(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower({c}), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '[\s\x{{00A0}}_\-]+', '_', 'g'), '')"


GT = f"""gt AS (
  SELECT * FROM (SELECT seg_id, rec_id, {label_sql("speaker_label")} AS speaker_label, {ms_sql("start_time")} AS s, {ms_sql("end_time")} AS e FROM {first_sql("gt_segments", "seg_id")})
  WHERE speaker_label IS NOT NULL AND e > s AND speaker_label NOT IN ('unknown', 'spkx', 'noisebck', 'spknoise', 'noises'))"""
SEG = f"""seg AS (
  SELECT * FROM (SELECT merged_id, rec_id, cluster_labels AS cluster_label, gt_labels AS gt_label, CASE WHEN isnan(cluster_probs) THEN NULL ELSE CAST(cluster_probs AS DOUBLE) END AS prob,
    {ms_sql("start_times")} AS s, {ms_sql("end_times")} AS e FROM {first_sql("merged_samples", "merged_id")}) WHERE e > s AND rec_id IS NOT NULL)"""
AZ = f"""az AS (
  SELECT * FROM (SELECT az_id, rec_id, {label_sql("speaker_id")} AS speaker, {ms_sql("start_time")} AS s, {ms_sql("end_time")} AS e,
    CASE WHEN isnan(confidence) THEN NULL WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf FROM {first_sql("azure_diarization", "az_id")})
  WHERE e > s AND rec_id IS NOT NULL AND speaker IS NOT NULL)"""
SMP = f"""smp AS (
  SELECT sample_id, rec_id, gt_labels AS gt_label, cluster_labels AS cluster_label, CASE WHEN isnan(cluster_probs) THEN NULL ELSE CAST(cluster_probs AS DOUBLE) END AS prob,
    CASE WHEN isnan(outlier_scores) THEN NULL ELSE CAST(outlier_scores AS DOUBLE) END AS outlier FROM {first_sql("samples", "sample_id")})"""
CHK = f"""chk0 AS (
  SELECT *, regexp_replace(list_extract(string_split(wav_path, '/'), -1), '\\.[A-Za-z]\\w*$', '') AS stem FROM {first_sql("samples", "sample_id")}),
chk AS (
  SELECT sample_id, unique_id, gt_labels AS gt_label, cluster_labels AS cluster_label, array_to_string(list_slice(string_split(stem, '_'), 1, -5), '_') AS name_rec, list_extract(string_split(stem, '_'), -4) AS voice,
    CAST(round(TRY_CAST(list_extract(string_split(stem, '_'), -3) AS DOUBLE) * 1000) AS BIGINT) AS s, CAST(round(TRY_CAST(list_extract(string_split(stem, '_'), -2) AS DOUBLE) * 1000) AS BIGINT) AS e,
    TRY_CAST(list_extract(string_split(stem, '_'), -1) AS DOUBLE) AS prob FROM chk0)"""
EMB = "emb AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
