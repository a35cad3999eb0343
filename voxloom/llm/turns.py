"""Speech transcripts into clean, ordered speaker turns (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.common import checkpoint, first_delivery, to_ms
from voxloom.operators.ordered import bucket_of, run_ids

# How marks are written in transcripts. Time stamps come off first, as they also occur
# inside other marks; a sound annotation may then still hold a duration such as 00:03.
STAMPS = r"(\[\d{1,3}:\d{2}(:\d{2})?([.,]\d+)?\]|\(\d{1,3}:\d{2}(:\d{2})?([.,]\d+)?\)|<\d+([.,]\d+)?\s*s>|\d{1,3}:\d{2}:\d{2}([.,]\d+)?\s*(-->|-(?=\s|$))|\d{1,3}:\d{2}:\d{2}[.,]\d+)"
# The numbers one to twenty in words, in the languages of the transcripts.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(),
    "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig".split(),
    "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split(),
)
WORD_PART = "(?:" + "|".join(w for words in NUMBER_WORDS for w in words) + ")(?!\\p{L})"
ROLE = r"(?:speaker|guest|spk|s)"
HEAD_TAG = rf"(?i)^\s*(?:\[\s*({ROLE}[\s_-]*(?:\d+|{WORD_PART}))\s*\]|<\s*({ROLE}[\s_-]*(?:\d+|{WORD_PART}))\s*>|(?:>>\s*)?({ROLE}[\s_-]*(?:\d+|{WORD_PART}))\s*(?::|-(?=\s|$)))"
SOUND = r"\[[^\[\]]*\]|\(\([^()]*\)\)|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|\*[^*]*\*|[♪♫]"
# Fillers, written so that a place in the text is ruled out by its first letter: `(?i)` would test every place in full.
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])[,.…]*"
_COMMON = r"[Uu]+[Hh]+(?:[Mm]{2,})?|[Ee]+[Hh]+|[Hh]+[Mm]+|[Mm]{2,}|[Aa]+[Hh]+|[Ää]+[Hh]*[Mm]*|[Öö]+[Hh]+"
FILLER = rf"(?=[UuEeHhMmAaÄäÖö]){_EDGE}(?:{_COMMON}|[Uu]+[Hh]*[Mm]+|[Ee]+[Rr]+[Mm]*|[Ee]+[Mm]+){_END}"
#: `um`, `er` and `em` are fillers of the other languages but ordinary German words.
GERMAN_FILLER = rf"(?=[UuEeHhMmAaÄäÖö]){_EDGE}(?:{_COMMON}|[Uu]+[Hh]+[Mm]+|[Ee]+[Rr][Mm]+){_END}"


def bare_text(transcript: Column) -> Column:
    """The transcript without time stamps; only texts with such digits can hold one."""
    return F.when(transcript.rlike("[0-9]:[0-9]|[0-9]\\s*[sS]>"), F.regexp_replace(transcript, STAMPS, " ")).otherwise(transcript)


def head_label(bare: Column) -> Column:
    """The speaker tag at the head of a text without time stamps, null if there is none."""
    found = F.concat(*[F.regexp_extract(bare, HEAD_TAG, g) for g in (1, 2, 3)])
    return F.when(found != "", found)


def words_only(bare: Column) -> Column:
    """A text without time stamps, freed of its speaker tag and of sound annotations (which may stand inside each other)."""
    s = F.regexp_replace(bare, HEAD_TAG, " ")
    return F.when(s.rlike("[\\[(<{*♪♫]"), F.regexp_replace(F.regexp_replace(s, SOUND, " "), SOUND, " ")).otherwise(s)


def has_speech(words: Column) -> Column:
    """Whether a text has a word besides fillers."""
    return F.coalesce(F.regexp_replace(words, FILLER, " ").rlike(r"[\p{L}\p{N}]"), F.lit(False))


def spoken_text(words: Column, lang: Column) -> Column:
    """Only the spoken words, tidied: no fillers, no blanks and marks left over from what was cut.

    `um` and `er` are German words too: in rows marked German they stay as long as the row has another word.
    """
    german = F.coalesce(F.lower(lang).startswith("de"), F.lit(False))
    s = F.when(german, F.regexp_replace(words, GERMAN_FILLER, " ")).otherwise(F.regexp_replace(words, FILLER, " "))
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r" ([,.?!;:])", "$1")
    s = F.regexp_replace(s, r"([,;:])(?:\s*[,;:])+", "$1")
    return F.trim(F.regexp_replace(s, r"^[\s,.;:…-]+", ""))


def plain_variant(label: Column) -> Column:
    """A label's spelling without case, separators and leading zeros of its number: `Guest-02` as `guest 2`."""
    s = F.lower(F.trim(label))
    s = F.regexp_replace(s, r"[\s   _.\-]+", " ")
    s = F.regexp_replace(s, r"(?<=\p{L})(?=\d)", " ")
    s = F.trim(F.regexp_replace(s, r"\b0+(?=\d)", ""))
    return F.when(s != "", s)


_SPELLED = {word: n for words in NUMBER_WORDS for n, word in enumerate(words, 1)}
_TRAILING = re.compile(r"(\d{1,18})\s*$")


def number_of(variant: str) -> int | None:
    """The number a plain variant ends with, in digits or as a number word; None without one."""
    digits = _TRAILING.search(variant)
    return int(digits.group(1)) if digits else _SPELLED.get(variant.rsplit(" ", 1)[-1])


# Titles that a name may carry.
TITLES = frozenset("dr mr mrs ms miss prof professor herr frau señor señora sr sra don doña".split())


def untitled(variant: str) -> list[str]:
    """The words of a variant behind its titles; all of them if there are no others."""
    words = variant.split()
    own = [w for w in words if w not in TITLES]
    return own or words


def forms(variant: str) -> list[str]:
    """The letters of a variant without titles, and from five letters on also with any one of them left out.

    Two variants are alike if they share a form, that is if they are equal once at most one letter of each is left
    out: one letter more, less, changed, or two neighbours swapped. So alike variants meet under a form, and no pairs
    of variants have to be compared.
    """
    s = "".join(untitled(variant))
    return [s, *{s[:i] + s[i + 1 :] for i in range(len(s))}] if len(s) >= 5 else [s]


def initials(variant: str) -> set[str]:
    """The first letters of a name of several words, with and without its titles."""
    return {"".join(w[0] for w in words) for words in (variant.split(), untitled(variant)) if len(words) > 1 and all(w[0].isalpha() for w in words)}


def unite(variants: list[str], counts: list[int]) -> tuple[list[int], list[int | None]]:
    """Union-find over the label variants of one transcript: the index of each variant's canonical one, and the number of
    its component.

    Evidence that joins: the same number; without a number the same form (`forms`), and the initials of a name, if all
    the names of the transcript that have them are one speaker. Numbered and unnumbered variants stay apart. Canonical
    is the most frequent variant of a component, then the first in order. Time and room grow with the number of variants.
    """
    parent = list(range(len(variants)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    numbers = [number_of(v) for v in variants]
    met: dict = {}
    for i, n in enumerate(numbers):
        for key in [n] if n is not None else forms(variants[i]):
            parent[find(i)] = find(met.setdefault(key, i))
    named: dict[str, set[int]] = {}
    for i, n in enumerate(numbers):
        for short in initials(variants[i]) if n is None else ():
            named.setdefault(short, set()).add(find(i))
    for i, n in enumerate(numbers):
        if n is None and len(owners := {find(o) for o in named.get(variants[i].replace(" ", ""), ())}) == 1:
            parent[find(i)] = owners.pop()
    best: dict[int, int] = {}
    number: dict[int, int | None] = {}
    for i in range(len(variants)):
        r = find(i)
        number[r] = numbers[i]
        if r not in best or (-counts[i], variants[i]) < (-counts[best[r]], variants[best[r]]):
            best[r] = i
    return [best[find(i)] for i in range(len(variants))], [number[find(i)] for i in range(len(variants))]


def canonical_speakers(labels: DataFrame) -> DataFrame:
    """Map each label variant of a transcript to its canonical speaker: rec_id, variant, speaker, speaker_no.

    `labels`: rec_id, variant, n (rows with this variant). The union-find of a transcript sees its distinct variants,
    never its rows; transcripts come many to a task, one at a time.
    """

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rec: str, variants: list[str], counts: list[int]) -> tuple:
            to, numbers = unite(variants, counts)
            return [rec] * len(to), variants, [variants[i] for i in to], numbers

        def told(done: list[tuple]) -> pa.RecordBatch:
            cols = [[x for d in done for x in d[c]] for c in range(4)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["rec_id", "variant", "speaker", "speaker_no"])

        now, variants, counts = None, [], []
        for batch in batches:
            done = []
            for rec, variant, n in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "variant", "n")), strict=True):
                if rec != now:
                    if variants:
                        done.append(solve(now, variants, counts))
                    now, variants, counts = rec, [], []
                variants.append(variant)
                counts.append(n)
            if done:
                yield told(done)
        if variants:
            yield told([solve(now, variants, counts)])

    ready = labels.select("rec_id", "variant", "n").repartition("rec_id").sortWithinPartitions("rec_id", "variant")
    return ready.mapInArrow(many, "rec_id string, variant string, speaker string, speaker_no bigint")


def clean_utterances(azure: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each utterance with spoken words and both times: rec_id, az_id, start_ms, end_ms, variant, and with `texts`
    text and confidence.

    First deliveries count. The speaker label is that of the field, else the tag at the head of the
    transcript; rows without either, or without a recording, are passed over. Confidences above 1 are
    taken as percentages; NaN becomes null.
    """
    # texts are cleaned before the first deliveries are told apart: conditions on the result wait above that window, so nothing is done twice
    a = azure.select("az_id", "rec_id", to_ms(F.col("start_time")).alias("start_ms"), to_ms(F.col("end_time")).alias("end_ms"), plain_variant(F.col("speaker_id")).alias("field"), bare_text(F.col("transcript")).alias("bare"), "confidence", "lang", "loaded_at")
    a = a.select("*", F.when(F.col("field").isNull(), plain_variant(head_label(F.col("bare")))).otherwise(F.col("field")).alias("variant"), words_only(F.col("bare")).alias("words")).drop("bare", "field")
    a = a.withColumn("speech", has_speech(F.col("words")))
    conf = F.when(~F.isnan("confidence"), F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")))
    extra = [spoken_text(F.col("words"), F.col("lang")).alias("text"), conf.alias("confidence")] if texts else []
    a = first_delivery(a.select("az_id", "rec_id", "start_ms", "end_ms", "variant", "speech", "loaded_at", *extra), "az_id")
    return a.where("rec_id is not null and start_ms is not null and end_ms is not null and variant is not null and speech").drop("speech", "loaded_at")


def speaker_turns(azure: DataFrame, texts: bool = True) -> DataFrame:
    """Every clean utterance with its canonical speaker and the number of its turn within the recording.

    Columns: rec_id, turn_no, speaker, speaker_no (the number of the speaker's component, null without one), az_id,
    start_ms, end_ms, and with `texts` text and confidence. Order: start_ms, then az_id. A turn is the longest stretch of
    one canonical speaker. An empty table gives no rows; null ids, labels and times see `clean_utterances`.
    """
    rows = checkpoint(clean_utterances(azure, texts))  # the texts are cleaned once, though three branches read them
    names = rows.groupBy("rec_id", "variant").agg(F.count("*").alias("n"))
    rows = rows.join(canonical_speakers(names), ["rec_id", "variant"]).withColumn("b", bucket_of(F.col("start_ms")))
    return run_ids(rows, ["rec_id"], "b", ["start_ms", "az_id"], "speaker", "turn_no").drop("b", "variant")


def turn_bounds(turns: DataFrame) -> DataFrame:
    """The first and last utterance of each turn: rec_id, turn_no, speaker, speaker_no, first_az_id, last_az_id, start_ms, end_ms, n_utterances."""
    place = F.struct("start_ms", "az_id")
    return turns.groupBy("rec_id", "turn_no").agg(
        F.min("speaker").alias("speaker"), F.min("speaker_no").alias("speaker_no"), F.min_by("az_id", place).alias("first_az_id"), F.max_by("az_id", place).alias("last_az_id"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_utterances"),
    )


def turn_summary(turns: DataFrame) -> DataFrame:
    """`turn_bounds` with the number of words and the mean confidence of each turn."""
    said = turns.groupBy("rec_id", "turn_no").agg(F.sum(F.size(F.split("text", " "))).alias("n_words"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return turn_bounds(turns).join(said, ["rec_id", "turn_no"])
