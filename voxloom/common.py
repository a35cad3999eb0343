"""Helpers that every operator uses: table access, checkpoints, first deliveries, clean labels."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label sentinels of the project (compared in lower case).
SENTINEL_LABELS = ("unknown", "spkx", "noisebck", "spknoise", "noises")
#: Numeric sentinels. -1 noise cluster, 77 placeholder, 88 spkNoise, 99 noises.
NOISE_CLUSTER = -1
PLACEHOLDER_LABEL = 77
SENTINEL_NUMBERS = (77, 88, 99)

#: Blanks of any kind, among them the no-break spaces, which trim() leaves alone.
BLANK_CHARS = "\t\n\x0b\f\r\u00a0\u2007\u202f\ufeff"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of a session, once; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        home = os.path.dirname(os.path.abspath(__file__))
        tmp = tempfile.mkdtemp(prefix="voxloom-")  # executors fetch the file when they start, so it stays until the end
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        copy = os.path.join(tmp, "copy")
        shutil.copytree(home, os.path.join(copy, os.path.basename(home)), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(tmp, "voxloom"), "zip", copy))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, deleted with the checkpoints."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: a folder of this machine would be lost to them")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxloom-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/voxloom-{uuid.uuid4().hex}"
    _WRITTEN.append((sc, path))
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage: written as Parquet to the session's checkpoint folder, and read again.

    The folder is the one that spark.checkpoint.dir names, which all executors share, so the table
    outlives lost executors; a folder of our own is set only where the session names none and runs in one process (as in tests).
    Compressed columns take less room than checkpointed rows, and readers fetch only what they need.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list = []


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `checkpoint` gave, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clear_checkpoints() -> None:
    """Delete what `checkpoint` wrote so far. Runs at exit; a long session may call it once its results are written."""
    while _WRITTEN:
        sc, path = _WRITTEN.pop()
        if sc._jsc is not None:
            try:
                where = sc._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the gateway may be gone already
                return


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds (half up); null for null, NaN and infinite values."""
    bad = F.isnan(seconds) | (F.abs(seconds) > F.lit(9.0e12))
    return F.when(seconds.isNull() | bad, F.lit(None)).otherwise(F.round(seconds * 1000)).cast("bigint")


def clean_label(label: Column) -> Column:
    """Lower case, outer blanks cut, any separator (blanks, `-`, `_`) as one `_`; null if nothing is left.

    Single characters are mapped; only labels with two separators in a row meet a regular expression.
    """
    s = F.trim(F.translate(F.lower(label), BLANK_CHARS, " " * len(BLANK_CHARS)))
    s = F.translate(s, " -", "__")
    s = F.when(F.contains(s, F.lit("__")), F.regexp_replace(s, "_+", "_")).otherwise(s)
    return F.when(s == "", F.lit(None)).otherwise(s)


def is_sentinel(cleaned: Column) -> Column:
    """Whether a cleaned label stands for a missing speaker."""
    return cleaned.isin(*SENTINEL_LABELS)


def first_delivery(df: DataFrame, key: str, arrived: str = "loaded_at") -> DataFrame:
    """Keep of the rows of one id the one that arrived first (null arrivals last, then by all columns).

    Rows without an id cannot be recognised as re-deliveries and are all kept: each gets a number of its own, which
    also spreads them. Spark limits every group to one row before the shuffle, so one id repeated in a third of the
    rows does no harm. The table is read once.
    """
    order = [F.col(arrived).asc_nulls_last()] if arrived in df.columns else []
    rest = [F.col(c) for c, t in df.dtypes if c not in (key, arrived) and not t.startswith("map")]
    own = df.withColumn("__own", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy(key, "__own").orderBy(*order, *rest)
    return own.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__own")


def valid_vector(v: Column, dim: int | None = None) -> Column:
    """True for vectors without null, NaN or infinite values that are not all zero.

    Built of array functions that Spark compiles; `array_contains` is null where a null may hide the value, and NaN
    counts as the largest value.
    """
    high, low = F.array_max(v), F.array_min(v)
    ok = ~F.array_contains(v, F.lit(float("inf")).cast("float")) & ~F.isnan(high) & (high < F.lit(3.0e38)) & (low > F.lit(-3.0e38)) & ((high != 0) | (low != 0))
    return F.coalesce(ok & (F.size(v) == dim if dim else F.lit(True)), F.lit(False))


def internal(df: DataFrame, **names: str | Column) -> DataFrame:
    """Project to the internal columns of an operator, so that extra columns can't clash with them."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in names.items()])


def named(cols: Iterable[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in cols]
