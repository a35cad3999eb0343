"""Problem 6: labels, cleaning, union-find and turns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxloom.llm import turns as T

DDL = "az_id bigint, rec_id string, speaker_id string, start_time double, end_time double, transcript string, confidence double, lang string, loaded_at string, variant string, b int"


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("[00:02:07] maybe erm uh later", "en", "maybe later"), ("<432.6s> >> GUEST 1: uh", "en", None), ("Speaker 2: 00:00:21,773 --> Um, we should [bell [00:00:01] rings] go", "en", "we should go"),
        ("(chair scraping) uh uhh", "en", None), ("♪ ♪ <laugh/>", None, None), ("  ...", "en", None), ("", "en", None), (None, "en", None), ("Four, pick a partner.", "en", "Four, pick a partner."), ("[Guest-3] (02:37.1) yes *clapping* and {breath} go", "en", "yes and go"),
        ("SPK3 - ah we should hm sing", "en", "we should sing"), ("00:01:08 - Four.", None, "Four."), ("er kommt um acht", "de-DE", "er kommt um acht"), ("er", "de", None), ("Ähm, ja genau ähh", "de", "ja genau"), ("speaker 5 : Vamos a contar", "es", "Vamos a contar"), ("a 7 ummm... b", "en", "a 7 b"), ("[inaudible 00:03]", "en", None), ("((inaudible)) thank you", "en", "thank you"),
    ],
)
def test_spoken_text(spark, text, lang, want):
    df = spark.createDataFrame([(text, lang)], "t string, l string")
    words = T.words_only(T.bare_text(F.col("t")))
    got = df.select(T.has_speech(words), T.spoken_text(words, F.col("l"))).first()
    assert (got[1] if got[0] else None) == want


def test_labels(spark):
    spellings = ["2", " 2 ", "02", "S2", "spk_02", "SPEAKER_02", "speaker2", "Speaker 2", "Guest-2", "Guest-02", "GUEST_2", "Guest Two", "Speaker zwei", "Guest dos"]
    df = spark.createDataFrame([(s,) for s in spellings], "s string").select(T.plain_variant(F.col("s")).alias("v"))
    assert [T.number_of(r.v) for r in df.collect()] == [2] * 14
    heads = ["Guest_04: my turn", "SPK3 - ah", "<S2> yes", ">> GUEST 5: the", "[Guest-3] no", "speaker 2 : so", "<5.0s> Speaker 12: x", "Guest sixteen: well", "Four, pick", "sing: now"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in heads], "t string").select(T.plain_variant(T.head_label(T.bare_text(F.col("t"))))).collect()]
    assert [None if g is None else T.number_of(g) for g in got] == [4, 3, 2, 5, 3, 2, 12, 16, None, None]


def test_union_find():
    names = ["teacher", "teachr", "ms jane doe", "mjd", "guest 2", "2", "kate", "cate", "catherine", "katherine", "js", "john smith", "jane stone", "", "guest", "dr smith", "smith"]
    to, numbers = T.unite(names, [5, 1, 3, 1, 1, 4, 1, 2, 2, 3, 1, 1, 1, 1, 1, 1, 2])
    assert [names[i] for i in to] == ["teacher", "teacher", "ms jane doe", "ms jane doe", "2", "2", "kate", "cate", "katherine", "katherine", "js", "john smith", "jane stone", "", "guest", "smith", "smith"]
    assert numbers == [None] * 4 + [2, 2] + [None] * 11
    assert T.unite([], []) == ([], [])


def test_found_comes_from_the_components(spark, small, monkeypatch):
    from voxloom.llm import queries

    rows = [(1, "r", "S1", 0.0, 1.0, "hello", 0.9, "en", "a", "", 0), (2, "r", "Guest-01", 1.0, 2.0, "again", 0.5, "en", "a", "", 0)]
    azure = spark.createDataFrame(rows, DDL)
    assert T.turn_bounds(T.speaker_turns(azure, texts=False)).count() == 1
    monkeypatch.setattr(T, "canonical_speakers", lambda names: names.select("rec_id", "variant", F.col("variant").alias("speaker"), F.lit(1).cast("bigint").alias("speaker_no")))
    assert T.turn_bounds(T.speaker_turns(azure, texts=False)).count() == 2
    assert queries.p6_found(spark, small).count() > 0


def test_turns(spark):
    rows = [
        (1, "r", "S1", 0.0, 1.0, "hello", 90.0, "en", "a", "", 0), (2, "r", None, 1.0, 2.0, "Speaker 1: again", 0.5, "en", "a", "", 0), (3, "r", "2", 1.5, 1.6, "uh", 0.5, "en", "a", "", 0), (4, "r", "2", float("nan"), 1.6, "word", 0.5, "en", "a", "", 0),
        (5, "r", "Guest-01", 900.0, 901.0, "late", None, "en", "a", "", 0), (6, "r", "Guest Two", 901.0, 902.0, "two", float("nan"), "en", "a", "", 0), (6, "r", "2", 0.5, 0.7, "re-delivered", 0.5, "en", "b", "", 0), (7, "q", "2", 0.0, 1.0, "x" * 200_000, 0.5, None, "a", "", 0), (8, "q", None, 2.0, 3.0, "no label", 0.5, "en", "a", "", 0), (9, None, "2", 0.0, 1.0, "no recording", 0.5, "en", "a", "", 0), (10, "q", "Teacher", 5.0, 6.0, "hi", 0.5, "en", "a", "", 0),
    ]
    t = T.speaker_turns(spark.createDataFrame(rows, DDL))
    got = sorted((r.rec_id, r.speaker_no, r.first_az_id, r.last_az_id, r.n_utterances, r.confidence) for r in T.turn_summary(t).where("speaker_no is not null").collect())
    assert got == [("q", 2, 7, 7, 1, 0.5), ("r", 1, 1, 5, 3, 0.7), ("r", 2, 6, 6, 1, None)]
    assert t.where("rec_id = 'q'").orderBy("turn_no").select("speaker").collect()[1][0] == "teacher"
    assert T.speaker_turns(spark.createDataFrame([], DDL)).count() == 0
