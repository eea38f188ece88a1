"""Lattices: trie and automaton find the same pieces, tokens are cut where no piece reaches across."""

import math
import random

import numpy as np
import pytest

from tidelog.llm import pieces, sampling, token_counts
from tidelog.llm.common import table

TEXTS = ["The words, and more. A.B ,x .com e.g. 1.5, ok)., \n\nNext  line\tz   ", "   lead", "a\nb", "▁ own▁mark▁▁", "é中\U0001f642, l'été.", ",,..", "x" * 300]


@pytest.fixture(scope="module")
def both():
    return pieces.vocabulary(runs=True), pieces.vocabulary(runs=True, automaton=True)


def test_trie_equals_automaton(both, spark):
    texts = TEXTS + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    tokens = sorted({t for x in texts if x for t in pieces.tokens_of(x, both[0])})
    one, two = (pieces.edges_of(tokens, v) for v in both)
    for name in ("base", "before", "node", "level", "piece"):
        assert (getattr(one, name) == getattr(two, name)).all()
    assert one.bare == two.bare


def test_tokens_join_to_the_text_and_no_piece_is_lost(both):
    v = both[0]
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab.,1 \n)é") for _ in range(60)) for _ in range(200)]
    for text in texts:
        tokens = pieces.tokens_of(text, v)
        whole = pieces.MARK + text.replace(" ", pieces.MARK)
        assert "".join(tokens) == whole
        cuts = np.cumsum([0, *map(len, tokens)])
        if pieces.MARK in text:
            continue
        stop, size, _ = v.trie.matches(pieces.code_points(whole))
        # A match that crosses a cut has a mark behind another character, which only the vocabulary's runs may have.
        across = np.searchsorted(cuts, stop - size, side="right") != np.searchsorted(cuts, stop, side="left")
        assert not across.any()


def test_runs_of_spaces_are_drawn_and_lossless(spark):
    sampler = sampling.Sampler(sampling.SamplingRule())
    runs = {i for i, p in enumerate(sampler.v.pieces) if set(p) == {pieces.MARK} and len(p) > 1}
    assert len(runs) == 14 and all(math.isfinite(sampler.v.logp[i]) for i in runs)
    ids = sampler.encode([" " * 15 + "x"] * 200, list(range(200)))
    assert {int(i) for x in ids for i in x} & runs
    for text in [*TEXTS, " ", "  ", "\n \n", "▁", " ▁ ", "▁▁ ▁x"]:
        assert sampler.decode(sampler.encode([text], [1])[0]) == text


def test_a_long_text_without_spaces(both):
    word = "ab" * 20_000
    assert token_counts.piece_counts([pieces.MARK + word], both[1])[0] <= len(word)


def test_growing():
    g, rng = pieces.Growing(np.int64), random.Random(1)
    parts = [np.arange(rng.randint(0, 3000)) for _ in range(20)]
    for x in parts:
        g.append(x)
    assert (g.values == np.concatenate(parts)).all() and g.size == sum(map(len, parts))
