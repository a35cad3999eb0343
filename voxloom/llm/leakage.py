"""Evaluation texts that leaked into training text (problem 8): size-partitioned MinHash containment."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint

#: Consecutive words that make a leak, words of a shingle.
RUN_WORDS, SHINGLE = 13, 5
#: Chance that the search misses one leaked run.
MISS = 1e-7
#: Largest filter of item keys, in bits (as a power of two), and bits for each key as long as that suffices.
FILTER_BITS, BITS_PER_KEY = 27, 64

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits without regard to case and accents."""
    if not text:
        return []
    return WORD.findall(MARKS.sub("", unicodedata.normalize("NFD", text.casefold())).casefold())


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), wrapping around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return _mix(h)


def size_classes(run: int, shingle: int) -> list[tuple[int, int]]:
    """(largest number of shingles, hash functions needed) of each size class of text segments.

    A run has q = run - shingle + 1 shingles. Contained in a segment of x shingles its Jaccard similarity is
    q / x, so after b hash functions it goes unseen with (1 - q/x)**b; each class takes b for its largest x.
    """
    q, most = run - shingle + 1, 2 * run - shingle + 1
    out, x = [], q
    while True:
        j = q / x
        out.append((x, 1 if j >= 1 else math.ceil(math.log(MISS) / math.log(1 - j))))
        if x >= most:
            return out
        x = min(most, x + max(1, q // 2))


def band_keys(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash of each segment grams[start:end] under each of `hashes` functions; one key per function."""
    flat = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange((ends - starts).sum())
    local, first = grams[flat], np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    out = np.empty((len(starts), hashes), np.uint64)
    for b in range(hashes):
        salt = _mix(np.full(1, 0x5851F42D4C957F2D + b, np.uint64))
        out[:, b] = _mix(np.minimum.reduceat(_mix(local ^ salt), first) ^ salt)
    return out


def item_keys(items: DataFrame, run: int, shingle: int) -> DataFrame:
    """Keys of every run of `run` consecutive words of the items, under the hash functions of the largest size class: item_id, key."""
    hashes = size_classes(run, shingle)[-1][1]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            for item, text in zip(pdf.item_id, pdf.text, strict=True):
                words = words_of(text)
                n = len(words) - run + 1
                if n > 0:
                    grams = shingles(np.fromiter((cache[w] for w in words), np.uint64, len(words)), shingle)
                    keys = np.unique(band_keys(grams, np.arange(n), np.arange(n) + run - shingle + 1, hashes))
                    yield pd.DataFrame({"item_id": item, "key": keys.view(np.int64)})

    return items.mapInPandas(keyed, "item_id bigint, key bigint")


def key_slots(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The two places of each key in a filter of 2**width bits."""
    shift = np.uint64(64 - width)
    return [(keys >> shift).astype(np.int64), (_mix(keys) >> shift).astype(np.int64)]


def key_filter(keys: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of the keys, of at most 2**bits bits whatever their number: (width, packed bits)."""
    width = max(16, min(bits, math.ceil(math.log2(max(2, keys.count() * BITS_PER_KEY)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(key_slots(batch.column("key").to_numpy().view(np.uint64), width))))], names=["slot"])

    slots = keys.select("key").mapInArrow(places, "slot bigint").distinct()
    held = np.zeros(1 << width, bool)
    for r in slots.groupBy(F.floor(F.col("slot") / 65_536).alias("chunk")).agg(F.collect_list((F.col("slot") % 65_536).cast("int")).alias("at")).toLocalIterator():
        held[r["chunk"] * 65_536 + np.array(r["at"], np.int64)] = True
    return width, np.packbits(held)


def maybe_held(keys: np.ndarray, width: int, bitmap: np.ndarray) -> np.ndarray:
    """Which keys the filter has; all that were put in, and few others."""
    one, two = key_slots(keys, width)
    there = (bitmap[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & 1 > 0
    at = np.flatnonzero(there)
    two = two.reshape(-1)[at]
    there.reshape(-1)[at] = (bitmap[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1 > 0
    return there


def suspicious_segments(docs: DataFrame, run: int, shingle: int, width: int, bitmap: np.ndarray) -> DataFrame:
    """The segments of the documents with a key that may be an item's: doc_id, text (the words of the segment), key.

    Documents of at most two runs are one segment; longer ones are cut into segments of two runs that
    overlap by one, so every run lies whole in some segment however long the document is. Segments are partitioned by
    size: the shorter one is, the fewer hash functions it takes to find a run in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    classes = size_classes(run, shingle)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            ids, words = pdf.doc_id.to_numpy(), [words_of(t) for t in pdf.text]
            doc, first, starts, ends, grams, at = [], [], [], [], [], 0
            for d, own in enumerate(words):
                n = len(own)
                if n < run:
                    continue
                grams.append(shingles(np.fromiter((cache[w] for w in own), np.uint64, n), shingle))
                for s in range(0, max(1, n - run), run):
                    doc.append(d)
                    first.append(s)
                    starts.append(at + s)
                    ends.append(at + min(s + 2 * run, n) - shingle + 1)
                at += n - shingle + 1
            out = []
            if doc:
                starts_, ends_, flat = np.array(starts), np.array(ends), np.concatenate(grams)
                smaller = 0
                for size, hashes in classes:
                    mine = np.flatnonzero((ends_ - starts_ > smaller) & (ends_ - starts_ <= size))
                    smaller = size
                    for lo in range(0, len(mine), 20_000):
                        part = mine[lo : lo + 20_000]
                        keys = band_keys(flat, starts_[part], ends_[part], hashes)
                        row, col = np.nonzero(maybe_held(keys, width, shared.value))
                        out += [(part[r], k) for r, k in zip(row, keys[row, col].view(np.int64).tolist(), strict=True)]
            yield pd.DataFrame([(ids[doc[s]], " ".join(words[doc[s]][first[s] : first[s] + 2 * run]), k) for s, k in out], columns=["doc_id", "text", "key"])

    return docs.mapInPandas(search, "doc_id bigint, text string, key bigint")


def shared_runs(pairs: DataFrame, run: int) -> DataFrame:
    """Exact containment, word by word: where in the item its runs of `run` words lie that a segment holds.

    `pairs`: item_id, doc_id, text, item_text. Gives item_id, doc_id, at (places), n_runs; pairs without a run drop out.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[int, tuple[dict[str, list[int]], int]] = {}
        for pdf in batches:
            out = []
            for item, doc, text, item_text in zip(pdf.item_id, pdf.doc_id, pdf.text, pdf.item_text, strict=True):
                if item not in places:
                    if len(places) > 1000:
                        places.clear()
                    words, where = words_of(item_text), {}
                    for i in range(len(words) - run + 1):
                        where.setdefault(" ".join(words[i : i + run]), []).append(i)
                    places[item] = where, len(words) - run + 1
                where, n = places[item]
                own = text.split(" ")
                at = sorted({p for i in range(len(own) - run + 1) for p in where.get(" ".join(own[i : i + run]), ())})
                if at:
                    out.append((item, doc, at, n))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "at", "n_runs"])

    return pairs.mapInPandas(check, "item_id bigint, doc_id bigint, at array<int>, n_runs int")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN_WORDS, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Documents that share at least `run` consecutive words with an item: item_id, doc_id, shared_runs,
    item_share (part of the item's runs found), longest_words (longest common stretch, in words).

    MinHash keys of the items' runs are a table, and a bitmap of bounded size tells which segments of the documents can
    have one of them; the documents are read once, whole, however many items there are. Segments and items that share a
    key are joined, and the runs themselves, word by word, decide. Null and empty texts share nothing; items shorter
    than a run cannot leak; copies of a document are reported each; rows of one id are one document or item; an empty
    table on either side gives no rows; other columns are dropped.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    todo = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    todo = todo.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " | ").alias("text"))
    keys = checkpoint(item_keys(todo, run, shingle))
    width, bitmap = key_filter(keys, filter_bits)
    hits = suspicious_segments(src, run, shingle, width, bitmap).join(keys, "key").select("item_id", "doc_id", "text").distinct()
    found = shared_runs(hits.join(todo.withColumnRenamed("text", "item_text"), "item_id"), run)
    whole = found.groupBy("item_id", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.max("n_runs").alias("n_runs"))
    stretch = F.aggregate(
        "at", F.struct(F.lit(-9).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1).alias("now"), F.greatest(s["most"], F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1)).alias("most")),
        lambda s: s["most"],
    )
    return whole.select("item_id", "doc_id", F.size("at").alias("shared_runs"), (F.size("at") / F.col("n_runs")).alias("item_share"), (stretch + run - 1).cast("int").alias("longest_words"))
