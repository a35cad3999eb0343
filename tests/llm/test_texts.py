"""Problems 8, 9 and 10 against brute force, and their defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from voxloom.llm import leakage as K
from voxloom.llm import mixture as M
from voxloom.llm import pii as P


# ---------------------------------------------------------------- leaks
def test_words():
    assert K.words_of("Más ALLÁ, de_la straße 12\n—x") == ["mas", "alla", "de", "la", "strasse", "12", "x"]
    assert K.words_of(None) == K.words_of(" ;: ") == []


def test_leaks(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([12, 13, 14, 30, 60]))), "x") for i in range(12)] + [(50, None, ""), (51, "", "")]
    docs = []
    for i in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([0, 5, 13, 27, 400]))]
        if i % 2:
            src = r.choice(items[:12])[1].split()
            n = r.choice([12, 13, 20])
            at = r.randrange(0, max(1, len(src) - n + 1))
            words[r.randrange(0, len(words) + 1) :] = [w.upper() + r.choice([",", " -", ""]) for w in src[at : at + n]] + words[:7]
        docs.append((1000 + i, " ".join(words), 0))
    docs += [(2000, None, 0), (2001, "", 0), docs[1], (2002, docs[1][1], 0), (2003, "z " * 100_000 + items[4][1], 0), (None, items[4][1], 0)]
    grams = lambda t: {tuple(w[k : k + 13]) for w in [K.words_of(t)] for k in range(len(w) - 12)}
    want = {(i, d) for i, t, _ in items for d, u, _ in docs if d is not None and grams(t) & grams(u)}
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    assert len(want) > 10
    for bits in (27, 10):  # a filter far too small only lets more candidates through
        got = K.leaked_items(dd, ii, filter_bits=bits)
        assert {(x.item_id, x.doc_id) for x in got.collect()} == want and got.count() == len(want)
    assert K.leaked_items(dd.limit(0), ii).count() == 0 and K.leaked_items(dd, ii.limit(0)).count() == 0


def test_miss_bound():
    for size, hashes in K.size_classes(13, 5):
        assert (1 - 9 / size) ** hashes <= K.MISS or size == 9


# ---------------------------------------------------------------- mixtures
def test_mixture(spark):
    r = random.Random(7)
    sized = [(i, r.choice(["a"] * 6 + ["b", "c"]), r.randint(1, 50)) for i in range(3000)] + [(None, "a", 5), (9001, None, 5), (9002, "zz", 5), (9003, "a", 0), (9004, "a", None)]
    have = {s: sum(t for i, x, t in sized if x == s and i is not None and t) for s in "abc"}
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 1), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(sized, "id bigint, source string, tokens bigint")
    taken = {}
    for total in (3000, 20_000, 90_000):
        records, shares = M.mix_to_targets(df, targets, total)
        rows = records.collect()
        used = {s: sum(x.tokens * x.copies for x in rows if x.source == s) for s in "abc"}
        for s, share, most in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 1)):
            want = round(share * total)
            limit = min(want, have[s] * most)
            assert limit - 50 < used[s] <= limit and all(x.copies <= most for x in rows if x.source == s)
        got = {x.source: x for x in shares.collect()}
        assert set(got) == {"a", "b", "c", "gone"} and got["gone"].used_tokens == 0
        assert all(got[s].used_tokens == used[s] and abs(got[s].actual_share - used[s] / sum(used.values())) < 1e-8 for s in "abc")
        now = {x.id for x in rows if x.source == "a"}
        assert taken.get("a", set()) <= now  # nested
        taken["a"] = now


def test_mixture_feasible(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, r.choice("aaaab"), r.randint(1, 9)) for i in range(4000)], "id bigint, source string, tokens bigint")
    have = {x.source: x.t for x in df.groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in M.mix_to_targets(df, t, "feasible")[1].collect()}
    total = int(min(have["a"] / 0.5, have["b"] / 0.4))
    assert abs(got["a"].used_tokens - total * 0.5) < 10 and abs(got["b"].used_tokens - total * 0.4) < 10
    over = {x.source: x.actual_share for x in M.mix_to_targets(df, t)[1].collect()}
    assert over["a"] / over["b"] > 1.3 > got["a"].actual_share / got["b"].actual_share


def test_mixture_few_bits_and_empty(spark):
    df = spark.createDataFrame([(i, "a", 10) for i in range(500)], "id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    records, _ = M.mix_to_targets(df, t, 1234, bits=3)
    assert records.count() == 123
    records, shares = M.mix_to_targets(df.limit(0), t)
    assert records.count() == 0 and shares.first().actual_share is None
    assert M.mix_to_targets(df, t.limit(0))[0].count() == 0


def test_tokens(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x"), (5, "wort " * 50_000, "x")], "doc_id bigint, text string, tokens string")
    got = {x.id: x.tokens for x in M.token_counts(df.drop("tokens"), "doc_id", "text", []).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000


# ---------------------------------------------------------------- personal information
def test_held_out_accuracy():
    """Another seed than the one fitted on. Names off the list that stand in lower case, which the generator of the first round
    did not make, are counted apart: nothing marks them but what stands around."""
    w = P.fitted_weights()
    true = found = hit = bare = bare_hit = 0
    for text, spans in P.invented(600, 991):
        got = {tuple(s[:3]) for s in P.decode(P.segments(text), w)}
        unmarked = {x for x in spans if x[2] == "person_name" and text[x[0] : x[1]].islower() and not P.GIVEN_NAMES & set(P.WORDS.findall(text[x[0] : x[1]]))}
        bare, bare_hit = bare + len(unmarked), bare_hit + len(unmarked & got)
        true, found, hit = true + len(set(spans) - unmarked), found + len(got - unmarked), hit + len(got & (set(spans) - unmarked))
    assert hit / true > 0.97 and hit / found > 0.97
    print(bare, bare_hit, hit / true, hit / found)
    assert bare > 20 and bare_hit / bare > 0.5


def test_another_source():
    """Sentences the generator has no part in; none of the given names is on its list."""
    from tests.llm import heldout

    assert not {g.lower() for g in heldout.GIVEN} & P.GIVEN_NAMES
    w, counts = P.fitted_weights(), {}
    for text, spans in heldout.sentences(1500):
        got = {tuple(s[:3]) for s in P.decode(P.segments(text), w)}
        for k in P.TYPES:
            mine, theirs = {x for x in got if x[2] == k}, {x for x in spans if x[2] == k}
            c = counts.setdefault(k, [0, 0, 0])
            c[0], c[1], c[2] = c[0] + len(theirs), c[1] + len(mine), c[2] + len(mine & theirs)
    print(counts)
    for true, found, hit in counts.values():
        assert hit / true >= 0.9 and hit / found >= 0.9


@pytest.mark.parametrize(
    "text",
    ["Chidi Okonkwo opened the door.", "I spoke with Irina Volkov yesterday.", "Thabo Mbeki was here.", "Jean-Luc Picard sat down.", "We met Brandon Taylor.", "Please ask Ashley Johnson.", "Signed by Adeyemi, Folake", "Bjorn Lindqvist opened the door", "my name is folake adeyemi and i live here", "Peter van Dyk left", "Maria de la Cruz stayed"],
)
def test_names_off_the_list(text):
    got = [s for s in P.decode(P.segments(text), P.fitted_weights()) if s[2] == "person_name"]
    assert len(got) == 1 and len(text[got[0][0] : got[0][1]].split()) >= 2


@pytest.mark.parametrize("text", ["Victor Harbor is a town.", "IBAN DE89 3704 0044 0532 0130 00 is mine.", "Lake Zelmor Park is large.", "The Kordal team met in Room 12."])
def test_what_is_nobody(text):
    assert P.decode(P.segments(text), P.fitted_weights()) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please call Dr. Anna K. Zelmor-Bri at (212) 555-0147.", {("person_name", "Anna K. Zelmor-Bri"), ("phone", "(212) 555-0147")}),
        ("Ship it to Flat 3B, 17 Kelmor St., Zandru. Ticket 123-456 stays.", {("address", "Flat 3B, 17 Kelmor St., Zandru")}),
        ("mail: <ana.lopez@site.test>, passport no. X-1234567-L", {("email", "ana.lopez@site.test"), ("id_number", "X-1234567-L")}),
        ("die familie wohnt in soltraweg 21, 84020 tumoi.", {("address", "soltraweg 21, 84020 tumoi")}),
        ("Checksum 945-883-205 matched. Handle @annot_7 left. Call sign Kor 924 425. 0.2 s. Spoke with the coach.", set()),
        ("write to paul dot stol at moim dot mail dot test about it", {("email", "paul dot stol at moim dot mail dot test")}),
        ("", set()),
    ],
)
def test_cases(text, want):
    got = {(k, text[s:e]) for s, e, k, _ in P.decode(P.segments(text), P.fitted_weights())}
    assert got == want


def test_decode_is_best_and_marginals_sum():
    import itertools

    w = P.fitted_weights()
    text = "Signed by Zelmor, Anna; 212-555-0147; 17 Kelmor Road, Zandru 12345"
    found = P.segments(text)[:12]
    score = lambda segs: sum(sum(w.get(f, 0) for f in s[3]) for s in segs)
    ok = lambda segs: all(a[1] <= b[0] for a, b in zip(sorted(segs), sorted(segs)[1:]))
    sets = [c for k in range(5) for c in itertools.combinations(found, k) if ok(c)]
    assert score(P.decode(found, w)) == pytest.approx(max(map(score, sets)))
    z = sum(np.exp(score(c)) for c in sets)
    for seg, p in zip(found, P._marginals(found, w)):
        assert p == pytest.approx(sum(np.exp(score(c)) for c in sets if seg in c) / z, abs=1e-3)


def test_tables(spark):
    long = "plain words " * 40_000 + "mail a.b@c.test"
    df = spark.createDataFrame([(1, "a.b@c.test and a.b@c.test", 1), (2, None, 1), (3, "  ", 1), (4, long, 1), (None, "a.b@c.test", 1)], "doc_id bigint, text string, start int")
    got = sorted((r.doc_id, r.pii_text, r.start) for r in P.find_pii(df).collect())
    assert got == [(1, "a.b@c.test", 0), (1, "a.b@c.test", 15), (4, "a.b@c.test", len(long) - 10)]
    clean = {r.doc_id: (r.text, r.n_pii) for r in P.redact_pii(df).where("doc_id < 4").collect()}
    assert clean == {1: ("[EMAIL] and [EMAIL]", 2), 2: (None, 0), 3: ("  ", 0)}
    assert P.find_pii(df.limit(0)).count() == 0
