"""Writers of the project's formats (K1-K14). `mode` is Spark's save mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A dataset, side table or edge list as Parquet; `overwrite` replaces it whole."""
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def replace_groups(df: DataFrame, path: str, groups: list[str]) -> None:
    """K3: write a dataset partitioned by `groups`, replacing only the groups that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*groups).parquet(path)


def append_log(spark, path: str, lines: list[str]) -> None:
    """Append lines to a log folder, one file for each call."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def write_predictions(df: DataFrame, path: str, places: int = 3, header: bool = True, sep: str = "\t", mode: str = "errorifexists") -> None:
    """rec_id, label, start_ms, end_ms, ... sorted by (rec_id, start_ms) with seconds to fixed places; the label is
    lp_label where there is one, else the cluster's (Q23)."""
    label = F.coalesce(F.col("lp_label"), F.col("cluster_label").cast("string")) if "lp_label" in df.columns else F.col("cluster_label").cast("string")
    sec = lambda c: F.format_string(f"%.{places}f", F.col(c) / 1000.0)
    rows = df.orderBy("rec_id", "start_ms").select("rec_id", label.alias("label"), sec("start_ms").alias("start"), sec("end_ms").alias("end"))
    rows.write.mode(mode).csv(path, header=header, sep=sep)


def write_by_recording(df: DataFrame, path: str, key: str = "rec_id", header: bool = False, sep: str = ",", mode: str = "errorifexists") -> None:
    """One folder per recording (or label). Rows of one key go to few files; Spark splits the task of a key that holds
    much more than the others."""
    df.hint("rebalance", key).write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(key).csv(path, header=header, sep=sep)


def write_selection(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K7: active-learning selection as CSV with header."""
    df.write.mode(mode).csv(path, header=True)


def matching_report(matches: DataFrame) -> DataFrame:
    """K8: counts of each action of `match_edits` with mean overlap, as a table to write or show."""
    return matches.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("overlap_pct"), 6).alias("mean_overlap_pct"), F.sum(F.col("time_modified").cast("int")).alias("n_moved"))


def matching_rows(edits: DataFrame, matches: DataFrame, edit_id: str = "edit_id") -> DataFrame:
    """K8: every edit with what `match_edits` made of it: edit_id, action (`unmatched` for edits it left out), overlap_pct."""
    return edits.select(edit_id).join(matches.select(edit_id, "action", "overlap_pct"), edit_id, "left").select(edit_id, F.coalesce("action", F.lit("unmatched")).alias("action"), "overlap_pct")


def render_report(metrics: DataFrame, title: str) -> str:
    """K9: a small metric table as text, one `name: value` line per column; more than 1000 rows are refused."""
    rows = metrics.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report shows at most 1000 rows; write the table instead")
    lines = [title, "=" * len(title)]
    for r in rows:
        lines += [f"{k}: {'n/a' if v is None else v}" for k, v in r.asDict().items()] + [""]
    return "\n".join(lines)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with nested constituents as JSON lines."""
    df.write.mode(mode).json(path)


def add_constants(df: DataFrame, **values: str) -> DataFrame:
    """Append constant columns."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in values.items()])


def rewrite_delimited(spark, source: str, target: str, ddl: str, sep_in: str = "\t", sep_out: str = ",", mode: str = "errorifexists") -> None:
    """TSV to CSV with header."""
    spark.read.csv(source, schema=ddl, sep=sep_in).write.mode(mode).csv(target, header=True, sep=sep_out)
