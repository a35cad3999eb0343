"""Mixing sources to target weights by hash thresholds (problem 9)."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint, clean_label

#: Folder of the public vocabulary files; the file whose tokens count.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Bits of the hash, and how many of them one histogram resolves.
HASH_BITS, HISTOGRAM_BITS = 60, 12

_ENCODINGS: dict = {}


def vocabulary_parts(folder: str, vocabulary: str) -> tuple[str, bytes]:
    """The pattern that splits texts and the rank file, read on the driver; the folder need not exist on the executors."""
    spec = importlib.util.spec_from_file_location("_vocabularies", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, vocabulary), "rb") as file:
        return module.PATTERN, file.read()


def encoding(name: str, pattern: str, ranks: bytes):
    """The tiktoken encoding of a rank file, built once in each worker."""
    key = (name, len(ranks))
    if key not in _ENCODINGS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines())
        _ENCODINGS[key] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODINGS[key]


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each whole text: id, the columns `keep`, tokens (0 for null). Strings of special tokens are ordinary text.

    The vocabulary, a file of about a megabyte, is broadcast.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), *keep, F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_parts(folder, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, *shared.value)
        for batch in batches:
            tokens = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *keep)], pa.array(tokens, pa.int64())], names=["id", *keep, "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *keep)) + ", tokens bigint")


def mix_to_targets(sized: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 42, bits: int = HISTOGRAM_BITS) -> tuple[DataFrame, DataFrame]:
    """Choose how often each record of (id, source, tokens) is used so that every source reaches its share.

    `targets`: source, target_share, max_repeats. A source is to give target_share of `total_tokens`: a number, by
    default all tokens that the sources have, or "feasible", the largest total at which no source that has records is
    held below its share by max_repeats; all shares are met there, to a record. A source is used whole as often as fits, at most max_repeats
    times, and the rest of its budget is filled by the records whose hash lies below a threshold. The
    threshold comes from token sums by hash bucket: the bucket in which the budget runs out is resolved
    by the next bits, and so on until it holds one record, so nothing is sorted or gathered and a larger
    budget always takes a superset of a smaller one. A source misses its budget by less than one record, or
    by what max_repeats forbids.

    Returns (records, shares). Records: id, source, tokens, copies (>= 1). Shares, one row for each target:
    available, wanted and used tokens, records, target and actual share. Records without id, source or
    tokens, and those of sources without a target, are left out; each row counts as a record, also
    repeated ones; sources without records get 0; an empty mixture has null actual shares.
    """
    goal = targets.select(clean_label(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().dropDuplicates(["source"])
    rows = sized.select("id", "source", "tokens").where("id is not null and tokens > 0").join(F.broadcast(goal.select("source")), "source", "left_semi")
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 64 - HASH_BITS))
    have = rows.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = goal.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available")).toPandas()
    able = [int(a * r / s) for _, s, r, a in plan.itertuples(index=False) if a and s > 0]
    total = int(plan.available.sum()) if total_tokens is None else (min(able) if able else 0) if total_tokens == "feasible" else total_tokens
    spark = sized.sparkSession
    wanted, whole, rest, threshold = {}, {}, {}, {}
    for s, share, repeats, available in plan.itertuples(index=False):
        wanted[s], threshold[s] = round(share * total), 0
        whole[s] = min(int(repeats), wanted[s] // available) if available else 0
        if available and whole[s] < repeats and wanted[s] > whole[s] * available:
            rest[s] = wanted[s] - whole[s] * available
    prefix, depth = dict.fromkeys(rest, 0), 0
    while rest and depth < HASH_BITS:
        step = min(bits, HASH_BITS - depth)
        heads = spark.createDataFrame([(s, prefix[s], rest[s]) for s in sorted(rest)], "source string, prefix bigint, rest bigint")
        near = rows.join(F.broadcast(heads), "source").where(F.shiftright("h", HASH_BITS - depth) == F.col("prefix"))
        bucket = F.shiftright("h", HASH_BITS - depth - step).bitwiseAND((1 << step) - 1)
        sums = near.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where("upto > rest").withColumn("left", F.col("rest") - F.col("upto") + F.col("tokens"))
        depth += step
        for r in over.groupBy("source").agg(F.min(F.struct("bucket", "n", "left")).alias("e")).collect():
            s, e = r["source"], r["e"]
            prefix[s], rest[s] = (prefix[s] << step) | e["bucket"], e["left"]
            threshold[s] = prefix[s] << (HASH_BITS - depth)
            if e["n"] == 1 or rest[s] == 0:
                del rest[s]
    limit = spark.createDataFrame([(s, whole[s], threshold[s]) for s in whole] or [("", 0, 0)], "source string, whole int, threshold bigint")
    used = rows.join(F.broadcast(limit), "source").withColumn("copies", F.col("whole") + (F.col("h") < F.col("threshold")).cast("int"))
    records = used.where("copies > 0").select("id", "source", "tokens", "copies")
    got = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.sum("copies").alias("n_records"))
    wants = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats), int(r.available), int(wanted[r.source])) for r in plan.itertuples(index=False)], "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens bigint")
    shares = wants.join(got, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("n_records", F.lit(0)).alias("n_records"))
    everything = F.sum("used_tokens").over(Window.partitionBy())
    return records, shares.withColumn("actual_share", F.when(everything > 0, F.round(F.col("used_tokens") / everything, 9)))


def corpus_mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixture of the documents table: sources are compared without regard to case, blanks and `-`."""
    named = docs.select("doc_id", clean_label(F.col("source")).alias("source"), "text")
    sized = checkpoint(token_counts(named, "doc_id", "text", ["source"], folder, vocabulary))
    return mix_to_targets(sized, targets, total_tokens, seed)
