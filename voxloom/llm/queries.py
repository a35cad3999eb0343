"""The queries of the problems tagged llm and their SQL, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.common import table
from voxloom.llm import communities, leakage, mixture, neartime, neighbours, pii, runs, subset, turns
from voxloom.llm.oracle import SQL  # noqa: F401


def p2_subset(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "samples")
    return subset.diverse_subset(samples, "sample_id", "enhanced_features", 256).withColumnRenamed("id", "sample_id")


def p2_cover(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "samples")
    chosen = subset.diverse_subset(samples, "sample_id", "enhanced_features", 256)
    return subset.nearest_pick(samples, "sample_id", "enhanced_features", chosen).select(F.col("id").alias("sample_id"), "pick_id", F.round(F.col("sim").cast("double"), 4).alias("sim"))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the subset: its size, no row twice, gains that never rise, rows with valid vectors only."""
    samples = table(spark, d, "samples")
    chosen = subset.diverse_subset(samples, "sample_id", "enhanced_features", 256)
    valid = neighbours.clean_vectors(samples, "sample_id", "enhanced_features").select("id", F.lit(True).alias("valid"))
    rows = chosen.join(valid, "id", "left").withColumn("before", F.lag("gain").over(Window.orderBy("pick")))  # 256 rows
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_different"), F.bool_and(F.coalesce(F.col("gain") <= F.col("before"), F.lit(True))).alias("falling"), F.bool_and(F.coalesce("valid", F.lit(False))).alias("all_valid"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    hits = neartime.edits_to_azure(table(spark, d, "human_edits"), table(spark, d, "azure_diarization"))
    return hits.select("edit_id", "az_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_vectors(table(spark, d, "recalculated_features"), "merged_id", "dvectors", 3, 0.95)
    return near.select(F.least("a", "b").alias("merged_id_a"), F.greatest("a", "b").alias("merged_id_b")).distinct()


def p4_samples(spark: SparkSession, d: str) -> DataFrame:
    """The 3 nearest of every sample whose id is divisible by 100, among all samples."""
    near = neighbours.nearest_vectors(table(spark, d, "samples"), "sample_id", "enhanced_features", 3, every=100, curves=neighbours.QUERY_CURVES)
    return near.select(F.col("a").alias("sample_id"), "rank", F.col("b").alias("neighbour_id"), F.round(F.col("sim").cast("double"), 4).alias("sim"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 3 nearest of every recalculated vector whose merged_id is divisible by 100, among all, however little similar they are."""
    near = neighbours.nearest_vectors(table(spark, d, "recalculated_features"), "merged_id", "dvectors", 3, every=100, curves=neighbours.FAR_CURVES)
    return near.select(F.col("a").alias("merged_id"), "rank", F.col("b").alias("neighbour_id"))


def p4_narrow(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of `p4_found` by windows of 256 rows, far smaller than any table here, along 12 curves."""
    near = neighbours.nearest_vectors(table(spark, d, "recalculated_features"), "merged_id", "dvectors", 3, 0.95, curves=neighbours.FAR_CURVES, half=128)
    return near.select(F.least("a", "b").alias("merged_id_a"), F.greatest("a", "b").alias("merged_id_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = communities.tight_clusters(table(spark, d, "samples"), "sample_id", "enhanced_features")
    return found.where("id <> community").select(F.col("community").alias("first_sample_id"), F.col("id").alias("sample_id"))


def p5_communities(spark: SparkSession, d: str) -> DataFrame:
    return communities.describe(communities.similarity_communities(table(spark, d, "samples"), "sample_id", "enhanced_features"), table(spark, d, "samples"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "azure_diarization"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = turns.turn_bounds(turns.speaker_turns(table(spark, d, "azure_diarization"), texts=False))
    return found.where("speaker_no is not null").select("rec_id", "speaker_no", "first_az_id", "last_az_id")


def p6_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speaker number and turn of every utterance."""
    said = turns.speaker_turns(table(spark, d, "azure_diarization"), texts=False)
    return said.where("speaker_no is not null").select("rec_id", "az_id", "speaker_no", F.col("turn_no").cast("bigint").alias("turn_no"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.cluster_runs(table(spark, d, "merged_samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.cluster_runs(table(spark, d, "merged_samples")).where("n_events >= 2")
    return found.select("rec_id", F.col("label").alias("cluster_label"), F.col("first_id").alias("first_merged_id"), F.col("last_id").alias("last_merged_id"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs of near-identical segments: one of another label may stand in a run if that is cheaper than two boundaries."""
    return runs.cluster_runs(table(spark, d, "merged_samples"), mismatch=0.4, penalty=1.0)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.corpus_mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.corpus_mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the mixture for each source: used at most what was wanted; and all of that but less than its largest record, or
    all that max_repeats allows; no record used more often than that."""
    records, shares = mixture.corpus_mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))
    own = records.groupBy("source").agg(F.max("tokens").alias("largest"), F.max("copies").alias("most"))
    s = shares.join(own, "source", "left").na.fill(0, ["largest", "most"])
    used, wanted = F.col("used_tokens"), F.col("wanted_tokens")
    done = (used > wanted - F.greatest("largest", F.lit(1))) | (used == F.col("available_tokens") * F.col("max_repeats"))
    return s.select("source", (used <= wanted).alias("in_budget"), done.alias("used_up"), (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"))


def p9_feasible(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached at the largest total that lets every source have its share."""
    return mixture.corpus_mixture(table(spark, d, "documents"), table(spark, d, "source_targets"), "feasible")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p10_emails(spark: SparkSession, d: str) -> DataFrame:
    """The e-mail addresses written with `@`."""
    return pii.find_pii(table(spark, d, "documents")).where("pii_type = 'email' and contains(pii_text, '@')").select("doc_id", "pii_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_subset": p2_subset,
    "p2_cover": p2_cover,
    "p2_check": p2_check,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_samples": p4_samples,
    "p4_neighbours": p4_neighbours,
    "p4_narrow": p4_narrow,
    "p5_found": p5_found,
    "p5_communities": p5_communities,
    "p6_turns": p6_turns,
    "p6_found": p6_found,
    "p6_speakers": p6_speakers,
    "p7_runs": p7_runs,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p9_feasible": p9_feasible,
    "p10_found": p10_found,
    "p10_emails": p10_emails,
    "p10_redacted": p10_redacted,
}
