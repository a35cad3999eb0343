"""Scalar functions as column expressions: file-name codec, time texts, overlap, score curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two score curves and the steps of the smallest cluster size.
COUNT_PEAK, COUNT_POWER, COUNT_DECAY = 6, 0.3, 40.0
MEMBER_LOW, MEMBER_LOW_WIDTH, MEMBER_HIGH, MEMBER_HIGH_WIDTH, MEMBER_SLOPE, MEMBER_OFFSET = 60, 1.5, 95, 2.0, 0.01, 0.25
SIZE_ABOVE_1000, SIZE_FROM_500, SIZE_ELSE = 25, 12, 5


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part of two intervals (J3), 0 if there is none."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_pct(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part in percent of the first interval (J4); 0 for an empty first interval."""
    return F.when(e1 > s1, overlap_ms(s1, e1, s2, e2) / (e1 - s1) * 100.0).otherwise(F.lit(0.0))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def chunk_name(rec: Column, speaker: Column, start_ms: Column, stop_ms: Column) -> Column:
    """`{rec}_{speaker}_{start:.2f}_{stop:.2f}` (B1, B4); milliseconds are cut to hundredths."""
    sec = lambda ms: F.format_string("%d.%02d", F.floor(ms / 1000).cast("bigint"), F.floor(F.pmod(ms, F.lit(1000)) / 10).cast("bigint"))
    return F.concat_ws("_", rec, speaker, sec(start_ms), sec(stop_ms))


def parse_chunk_name(path: Column, parts: int = 5) -> dict[str, Column]:
    """The fields of a chunk name from its end, as the recording may contain `_` (B1).

    With `parts` 5 the name is rec, speaker, start, stop, probability; with 4 the probability is missing.
    Fields that don't parse are null.
    """
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]\w*$", "")
    bits = F.split(stem, "_")
    tail = parts - 1
    enough = F.size(bits) > tail
    at = lambda k: F.when(enough, F.element_at(bits, -k))
    ms = lambda k: F.round(at(k).try_cast("double") * 1000).cast("bigint")
    last = 1 if parts == 5 else 0
    out = {
        "rec": F.when(enough, F.array_join(F.slice(bits, 1, F.greatest(F.size(bits) - tail, F.lit(0))), "_")),
        "speaker": at(3 + last), "start_ms": ms(2 + last), "stop_ms": ms(1 + last),
    }
    return out | ({"prob": at(1).try_cast("double")} if last else {})


def base_name(path: Column) -> Column:
    """File name without folder, extension and a `_gt` mark in any case."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(name, r"(?i)_gt$", "")


def strip_timestamp(name: Column) -> Column:
    """Cut an ISO time stamp from the end of a name."""
    return F.regexp_replace(name, r"[_-]?\d{4}-\d{2}-\d{2}T\d{2}[-:]\d{2}[-:]\d{2}(?:[.-]\d+)?Z?$", "")


def clock(ms: Column) -> Column:
    """`HH:MM:SS.ff`, hundredths cut."""
    s = F.floor(ms / 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(s / 3600).cast("bigint"), F.pmod(F.floor(s / 60), F.lit(60)).cast("bigint"), F.pmod(s, F.lit(60)), F.floor(F.pmod(ms, F.lit(1000)) / 10).cast("bigint"))


def parse_clock(text: Column) -> Column:
    """Milliseconds of `HH:MM:SS[.f]`, null if it doesn't parse."""
    h, m, s = (F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$", g) for g in (1, 2, 3))
    return F.when(h != "", h.cast("bigint") * 3_600_000 + m.cast("bigint") * 60_000 + F.round(s.cast("double") * 1000).cast("bigint"))


def cluster_count_score(k: Column) -> Column:
    """(k/6)^0.3 up to 6 clusters, exp(-(k-6)/40) above, 0 for none."""
    rise = F.pow(k / float(COUNT_PEAK), F.lit(COUNT_POWER))
    return F.when(k <= 0, 0.0).when(k <= COUNT_PEAK, rise).otherwise(F.exp(-(k - COUNT_PEAK) / COUNT_DECAY))


def membership_score(w: Column) -> Column:
    """Score of the percentage of clustered rows: two sigmoids, a slope between 60 and 100, minus 0.25."""
    sig = lambda x: 1.0 / (1.0 + F.exp(-x))
    slope = F.when((w >= MEMBER_LOW) & (w <= 100), 1.0 + MEMBER_SLOPE * (w - MEMBER_LOW)).otherwise(F.lit(1.0))
    return sig((w - MEMBER_LOW) / MEMBER_LOW_WIDTH) * sig(-(w - MEMBER_HIGH) / MEMBER_HIGH_WIDTH) * slope - MEMBER_OFFSET


def min_cluster_size(n: Column) -> Column:
    """25 above 1000 rows, 12 from 500, else 5."""
    return F.when(n > 1000, SIZE_ABOVE_1000).when(n >= 500, SIZE_FROM_500).otherwise(SIZE_ELSE)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def manhattan(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def list_difference(a: Column, b: Column) -> Column:
    """The values of `a` that `b` lacks, in order and with their repetitions; a null `b` takes nothing away."""
    return F.when(b.isNull(), a).otherwise(F.filter(a, lambda x: ~F.coalesce(F.array_contains(b, x), F.lit(False))))


def map_get(m: Column, key: Column, default: Column) -> Column:
    """The value of a key, `default` where the map lacks it."""
    return F.coalesce(F.try_element_at(m, key), default)


def map_invert(m: Column) -> Column:
    """Values to keys; of keys with one value the largest."""
    entries = F.map_entries(m)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["value"])), lambda v: F.struct(v.alias("key"), F.array_max(F.transform(F.filter(entries, lambda e: e["value"] == v), lambda e: e["key"])).alias("value"))))
