"""Phrase counts and collocations against plain counting, also with an activation table that is far too small."""

import collections
import random
import re

import pytest

from tidelog.llm.collocations import PhraseRule, collocations, phrase_counts, phrase_hash, words_of

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def corpus():
    rng = random.Random(9)
    vocabulary = ["the", "of", "New", "York", "é", "中文", " x", "İs"] + [f"w{i}" for i in range(30)]
    out = [None, "", " \t\n", "...", "one", "a" * 100_000, "the of " * 20_000, "New\tYork  new york;NEW YORK\x0bnew.york"]
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.4:
            words[0:0] = "to be or not to be that is".split()
        out.append("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for w in words))
    out += [out[20]] * 8
    langs = ["en", "en", "de", None]
    return [(i, t, rng.choice(langs), "clash", -1) for i, t in enumerate(out)] + [(None, "to be or not", "xx", None, None), (None, None, None, None, None)]


def plain_counts(rows, longest):
    counts = collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und", ""] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und", " ".join(words[i : i + m])] += 1
    return counts


def plain_collocations(counts, least, top):
    known = {k: v for k, v in counts.items() if k[1] and v >= least}
    candidates = {k: v for k, v in known.items() if " " in k[1]}
    rows = collections.defaultdict(list)
    for (lang, phrase), a in candidates.items():
        if any(lang == other and len(longer) > len(phrase) and f" {phrase} " in f" {longer} " and 100 * f >= 100 * a for (other, longer), f in candidates.items()):
            continue
        words, n = phrase.split(" "), counts[lang, ""]
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        rows[lang].append((-score, -a, phrase.encode(), l, r, n))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, found in rows.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.mark.parametrize("rule", [PhraseRule(5, 40, 3, 1 << 16), PhraseRule(4, 25, 2, 8), PhraseRule(5, 2000, 1, 1 << 12)])
def test_counts_and_scores_equal_plain_counting(spark, docs, rule):
    counts = phrase_counts(docs, rule)
    found = {(r.lang, r.phrase): r.n for r in counts.collect()}
    plain = plain_counts(corpus(), rule.longest)
    # A null or empty text has no words, and a language without any text need not be listed.
    assert found == {k: v for k, v in plain.items() if v >= rule.least or (not k[1] and k in found)}
    assert {k for k, v in plain.items() if not k[1] and v} <= set(found)
    for top in (5, 2000):
        got = sorted(map(tuple, collocations(counts, rule.longest, top).collect()))
        assert got == plain_collocations(plain, rule.least, top)


@pytest.mark.parametrize("rule", [PhraseRule(5, 10, 1, 64), PhraseRule(5, 10, 3, 64)])
def test_shared_slots_change_no_count(spark, rule):
    """Slots that others set early: a phrase looks ripe before its words are, and what it begins must not start before it can be met."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))), rng.choice(["en", "de", None])) for i in range(600)]
    found = {(r.lang, r.phrase): r.n for r in phrase_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6), rule).collect()}
    assert found == {k: v for k, v in plain_counts(rows, rule.longest).items() if v >= rule.least}


def test_no_documents(spark, docs):
    counts = phrase_counts(docs.limit(0), PhraseRule(shards=2))
    assert counts.count() == 0
    assert collocations(counts).count() == 0


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "", 7 * big), ("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)]
    got = collocations(spark.createDataFrame(rows, "lang string, phrase string, n long")).first()
    assert got.score == 1000 * (big - 2) * 7 * big // (big * (big - 1))


def test_words():
    assert words_of("A  b.C\tÉ\r\nd\x0b\x1c".encode()) == [b"a", b"b", b"\xff", b"c", "É".encode(), b"\xff", b"\xff", b"d", b"\xff", b"\x1c", b"\xff"]
    assert phrase_hash("en", b"a b") != phrase_hash("de", b"a b")


def test_rule_is_checked():
    with pytest.raises(ValueError):
        PhraseRule(slots=1000)
