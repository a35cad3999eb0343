"""The queries of the core and their SQL, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.common import table
from voxloom.operators import periods
from voxloom.plans import extended, reference

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = periods.speaking_periods(table(spark, d, "gt_segments")).where("kind = 'gap'")
    return gaps.selectExpr("rec_id", "speaker_label", "start_ms AS gap_start_ms", "end_ms AS gap_end_ms")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods.speaking_periods(table(spark, d, "gt_segments")).where("kind = 'covered'").drop("kind")


SPEAKING = r"""
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY loaded_at) AS rn FROM gt_segments) WHERE rn = 1),
clean AS (
  SELECT rec_id,
    regexp_replace(regexp_replace(lower(speaker_label), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '[\s\x{00A0}_\-]+', '_', 'g') AS speaker_label,
    CASE WHEN isnan(start_time) THEN NULL ELSE CAST(round(start_time * 1000) AS BIGINT) END AS s,
    CASE WHEN isnan(end_time) THEN NULL ELSE CAST(round(end_time * 1000) AS BIGINT) END AS e
  FROM once),
ok AS (
  SELECT * FROM clean WHERE speaker_label <> '' AND e > s
    AND speaker_label NOT IN ('unknown', 'spkx', 'noisebck', 'spknoise', 'noises')),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY rec_id, speaker_label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_e FROM ok)
"""

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_periods": p1_periods, **reference.QUERIES, **extended.QUERIES}

SQL: dict[str, str] = {
    **reference.SQL,
    **extended.SQL,
    "p1_found": SPEAKING + "SELECT rec_id, speaker_label, before_e AS gap_start_ms, s AS gap_end_ms FROM reach WHERE s > before_e",
    "p1_periods": SPEAKING + """, grouped AS (
  SELECT *, sum(CASE WHEN s <= before_e THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, speaker_label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach)
SELECT rec_id, speaker_label, min(s) AS start_ms, max(e) AS end_ms FROM grouped GROUP BY rec_id, speaker_label, g""",
}
