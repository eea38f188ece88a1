"""Short texts in many small batches: a row may be the pivot of all its buckets in one space."""

import itertools
import random

import pytest

from tidelog.llm import jaccard
from tidelog.llm.jaccard import JaccardRule, jaccard_components


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randint(8, 40))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"w{rng.randrange(40)}"], [words[at], "x"]])
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def components(rows, width, num, den):
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (t.split() for t in rows)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if den * len(a & b) >= num * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in range(len(rows))}


@pytest.mark.parametrize("width, num, den, seed", [(4, 85, 100, 1), (2, 60, 100, 2), (1, 50, 100, 3)])
def test_components_equal_brute_force(spark, width, num, den, seed):
    rows = texts(seed)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = {r.doc_id: r.component_id for r in jaccard_components(docs, JaccardRule(width=width, num=num, den=den)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == components(rows, width, num, den)


@pytest.mark.parametrize("shared, edited", [(24, 0), (24, 20), (60, 20)])
def test_rows_around_a_common_passage(spark, monkeypatch, shared, edited):
    """Texts that share a passage, most of them with nothing else; some are near copies of another text that do not link to their hub."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(shared)]
    rows = [passage + [f"w{i}x{j}" for j in range(rng.randint(36, 44))] for i in range(60)]
    for _ in range(edited):
        words = list(rng.choice(rows))
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(shared, len(words))] = f"e{rng.randrange(10**9)}"
        rows.append(words)
    rng.shuffle(rows)
    rows, joined, written = [" ".join(r) for r in rows], [], jaccard.written

    def spy(df):
        out = written(df)
        if {"hub", "column", "at"} <= set(out.columns):
            joined.append(out.groupBy("hub", "node").count().count())
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 2)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, JaccardRule(width=2, num=80, den=100)).collect()}
    assert got == components(rows, 2, 80, 100)
    # Rows that share nothing but the passage are not joined by the columns of their hub that all of them lack.
    assert joined and (edited or not sum(joined))
