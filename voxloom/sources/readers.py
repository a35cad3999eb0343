"""Readers of the project's text formats (R1-R23). All are lazy; nothing infers a schema by reading twice."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.common import checkpoint
from voxloom.functions.scalars import base_name, strip_timestamp


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def _tsv(spark: SparkSession, path: str, ddl: str, header: bool = False, sep: str = "\t") -> DataFrame:
    rows = spark.read.csv(path, schema=ddl, sep=sep, header=header, mode="PERMISSIVE", quote="")
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def read_vad_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `duration: d, offset: d, ..., speaker_id: s, ..., wav: path` as rec, speaker, start, stop (= offset + duration)."""
    line = spark.read.text(path).where(F.col("value").contains("offset"))
    grab = lambda name, what: F.regexp_extract("value", rf"\b{name}:\s*({what})", 1)
    d, o = grab("duration", r"[\d.]+").try_cast("double"), grab("offset", r"[\d.]+").try_cast("double")
    rec = base_name(grab("wav", r"[^\s,}]+"))
    return line.select(rec.alias("rec"), grab("speaker_id", r"[^\s,}]+").alias("speaker"), o.alias("start"), (o + d).alias("stop")).where("start is not null and stop is not null")


def read_gt(spark: SparkSession, path: str, columns: int = 6, header: bool = False) -> DataFrame:
    """Ground truth of 3 to 6 columns: rec_id (file stem without `_gt`), speaker, lang, start, end, filename, rnd_idx.

    Columns that a layout lacks are null, numbers that don't parse too.
    """
    rows = _tsv(spark, path, schemas.GT_COLUMNS[columns], header)
    have = set(rows.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
    return rows.select(base_name(F.col("path")).alias("rec_id"), text("speaker"), text("lang"), _number("start").alias("start"), _number("end").alias("end"), text("filename"), (F.col("rnd_idx").try_cast("int") if "rnd_idx" in have else F.lit(None).cast("int")).alias("rnd_idx"))


def read_hypothesis(spark: SparkSession, path: str, system: str) -> DataFrame:
    """Speech intervals of one of the systems in `schemas.HYPOTHESES`: rec_id, start, stop."""
    if system not in schemas.HYPOTHESES:
        raise ValueError(f"unknown system {system!r}; known: {', '.join(sorted(schemas.HYPOTHESES))}")
    spec = schemas.HYPOTHESES[system]
    rows = _tsv(spark, path, spec["ddl"])
    if "keep" in spec:
        rows = rows.where(F.col("tag").isin(*spec["keep"]))
    return rows.select(base_name(F.col("path")).alias("rec_id"), _number("start").alias("start"), _number("stop").alias("stop")).dropna()


def read_azure(spark: SparkSession, path: str) -> DataFrame:
    """Competitor TXT; rows without a start or end drop out."""
    rows = _tsv(spark, path, schemas.AZURE)
    return rows.select(base_name(F.col("path")).alias("rec_id"), "speaker_id", _number("start").alias("start_time"), _number("end").alias("end_time"), "transcript", _number("confidence").alias("confidence"), F.col("language").alias("lang")).dropna(subset=["start_time", "end_time"])


def read_human_edits(spark: SparkSession, path: str) -> DataFrame:
    """Labeller TSV with header; `source` is the file name, `rec_id` that without its time stamp."""
    rows = _tsv(spark, path, schemas.HUMAN_EDITS, header=True)
    name = base_name(F.col("path"))
    return rows.select(name.alias("source"), strip_timestamp(name).alias("rec_id"), F.col("SampleIndex").try_cast("bigint").alias("sampleindex"), F.col("SpeakerLP").alias("speakerlp"), _number("StartTime").alias("starttime"), _number("EndTime").alias("endtime"), F.col("ClusterPred").try_cast("int").alias("clusterpred"))


def read_human_labels(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """JSON object of id to speaker; with `known` (id) only ids that occur there."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "speaker"))
    return whole if known is None else whole.join(known.select(F.col("id").cast("string")), "id", "left_semi")


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    """Speaker directory: base, speaker_name, speaker_number, one row each (first of equal numbers, U6)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schemas.SPEAKERS)).alias("base", "v"))
    flat = rows.select("base", F.posexplode("v.speakers").alias("pos", "s")).select("base", "pos", "s.speaker_name", "s.speaker_number")
    w = Window.partitionBy("base", "speaker_number").orderBy("pos")
    return flat.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("base", "speaker_name", "speaker_number")


def name_conflicts(speakers: DataFrame) -> DataFrame:
    """Names that carry more than one number."""
    return speakers.groupBy("speaker_name").agg(F.count_distinct("speaker_number").alias("n_numbers")).where("n_numbers > 1")


def directory_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of two speaker directories that differ: base, speaker_number, the two names, what."""
    x, y = a.select("base", "speaker_number", F.col("speaker_name").alias("name_a")), b.select("base", "speaker_number", F.col("speaker_name").alias("name_b"))
    both = x.join(y, ["base", "speaker_number"], "full")
    what = F.when(F.col("name_a").isNull(), "missing in a").when(F.col("name_b").isNull(), "missing in b").when(F.col("name_a") != F.col("name_b"), "other name")
    return both.withColumn("what", what).where("what is not null")


def compare_directories(folders: dict[str, DataFrame]) -> DataFrame:
    """The differences between any two of up to three speaker directories: left, right, and the columns of
    `directory_differences`; entries of a base that one side lacks altogether count as missing there."""
    if not 2 <= len(folders) <= 3:
        raise ValueError("two or three folders can be compared")
    names, got = list(folders), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pair = directory_differences(folders[a], folders[b]).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*")
            got = pair if got is None else got.unionByName(pair)
    return got


def pair_files(gt: DataFrame, pred: DataFrame, path: str = "path") -> DataFrame:
    """Paths of equal base name: base, gt_path, pred_path; a base name that occurs twice on a side is an error."""
    named = lambda df, out: df.select(base_name(F.col(path)).alias("base"), F.col(path).alias(out))
    g, p = named(gt, "gt_path"), named(pred, "pred_path")
    for side, df in (("ground truth", g), ("prediction", p)):
        twice = df.groupBy("base").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"{side} files of one base name: {', '.join(r['base'] for r in twice)}")
    return g.join(p, "base")


def unpaired_names(a: DataFrame, b: DataFrame, name: str = "base") -> DataFrame:
    """Names on one side only, with the side."""
    return a.select(name).distinct().join(b, name, "left_anti").withColumn("side", F.lit("a")).unionByName(b.select(name).distinct().join(a, name, "left_anti").withColumn("side", F.lit("b")))


def with_duration(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Add the duration of the recording, null if unknown."""
    return rows.join(recordings.select("rec_id", "duration").dropDuplicates(["rec_id"]), "rec_id", "left")


def speaker_index(files: DataFrame, least: int = 5, path: str = "path") -> DataFrame:
    """(path, speaker, label) from names whose first `_` part is the speaker; speakers with fewer than `least` files drop
    out, the rest are numbered from 0 in order of name."""
    rows = files.select(path, F.split(base_name(F.col(path)), "_")[0].alias("speaker"))
    often = rows.groupBy("speaker").count().where(F.col("count") >= least).select("speaker")
    numbers = often.withColumn("label", F.row_number().over(Window.partitionBy().orderBy("speaker")) - 1)
    return rows.join(numbers, "speaker").select(path, "speaker", "label")


def read_lp_results(spark: SparkSession, path: str) -> DataFrame:
    """Label propagation results."""
    return spark.read.csv(path, schema=schemas.LP_RESULTS, header=True)


def read_detections(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Overlap detector log."""
    return spark.read.csv(path, schema=schemas.DETECTIONS, sep=sep)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Verification trials."""
    return spark.read.csv(path, schema=schemas.TRIALS, sep=" ")


def read_audio_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, rec_id, bytes; decoding is up to a model plug-in (`operators.dsp.embed`)."""
    return spark.read.format("binaryFile").load(path).select("path", base_name(F.col("path")).alias("rec_id"), F.col("content").alias("bytes"))


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (-1 to 1, channels averaged) of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / 2**23
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float64) / 2 ** (8 * width - 1)
    return rate, x.reshape(-1, channels).mean(axis=1)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """PCM WAV files as rec_id, rate, samples (array<float>); files that can't be decoded give null samples. Two files of one
    base name are refused."""
    files = read_audio_bytes(spark, path)
    twice = files.groupBy("rec_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"audio files of one base name: {', '.join(r['rec_id'] for r in twice)}")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, data in zip(pdf.rec_id, pdf.bytes, strict=True):
                try:
                    rate, x = decode_wav(data)
                    out.append((rec, rate, x.astype(np.float32)))
                except (wave.Error, EOFError):
                    out.append((rec, None, None))
            yield pd.DataFrame(out, columns=["rec_id", "rate", "samples"]).astype({"rate": "Int64"})

    return files.select("rec_id", "bytes").mapInPandas(decode, "rec_id string, rate bigint, samples array<float>")


def cut_audio(audio: DataFrame, intervals: DataFrame, order: list[str]) -> DataFrame:
    """The samples of every interval (rec_id, start_ms, end_ms, ...) of a recording (rec_id, rate, samples), numbered
    through the corpus: adds cut_no, rate, samples; what lies outside the recording is left out."""
    numbered = running_cuts(intervals, order).join(audio.select("rec_id", "rate", "samples"), "rec_id")
    first = F.greatest(F.lit(0), F.floor(F.col("start_ms") * F.col("rate") / 1000)).cast("int")
    last = F.least(F.size("samples"), F.floor(F.col("end_ms") * F.col("rate") / 1000)).cast("int")
    return numbered.withColumn("samples", F.slice("samples", first + 1, F.greatest(F.lit(0), last - first)))


def running_cuts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Intervals numbered through the whole corpus for cutting: adds `cut_no` from 0.

    Rows are sorted into ranges; a row's number is its place in its range plus the sizes of those before.
    """
    ranged = rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    kept = checkpoint(ranged)
    first = kept.groupBy("__p").agg(F.min("__m").alias("__low"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("__p", "__low", before.alias("__before"))
    return kept.join(F.broadcast(first), "__p").select(*rows.columns, (F.col("__m") - F.col("__low") + F.col("__before")).alias("cut_no"))
