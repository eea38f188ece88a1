"""Fill-in-middle against plain slices of Python strings, and back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.fill_middle import ExceptionIndex, FillRule, fill_in_middle, restored


def expected(doc_id, text, rule):
    text = text or ""
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.changed:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < rule.suffix_first:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def rows():
    rng = random.Random(4)
    alphabet = "ab <>PSM\n" + "éß中\U0001f642\U00010000\x00́"
    texts = [None, "", "<P>", "a<S>b", "<M", "<<S>", "x", "é", "\U0001f642", "<", "<P", "<S<M<P"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("ab é") for _ in range(200_000)), "word " * 250_000, *["again é"] * 5]
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id é", "x"), (None, None, "x"), (7, "id again", "x")]


def text_key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("rule", [FillRule(), FillRule(changed=100, suffix_first=50, seed=3), FillRule(changed=0)])
def test_parts_equal_slices_and_come_back(spark, rule):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, form string").repartition(4)
    out = fill_in_middle(docs, rule)
    got = sorted(map(tuple, out.collect()), key=text_key)
    assert got == sorted((expected(i, t, rule) for i, t, _ in rows()), key=text_key)
    back = out.select("doc_id", restored(F.col("form"), F.col("output")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=text_key) == sorted(((i, t or "") for i, t, _ in rows()), key=text_key)
    assert fill_in_middle(docs.limit(0), rule).count() == 0


def test_index_is_exact():
    text = "aé中\U0001f642" * 50 + "z" * 30 + "é"
    data = np.frombuffer(text.encode(), np.uint8)
    index = ExceptionIndex(data)
    places = np.arange(len(text) + 1)
    positions = np.array([len(text[:i].encode()) for i in places])
    assert (index.bytes_of(places) == positions).all()
    assert (index.places_of(positions) == places).all()
    assert len(index.place) == sum(ord(c) > 127 for c in text)


def test_string_ids(spark):
    docs = spark.createDataFrame([("k1", "some text"), ("k2", "déjà vu")], "name string, body string")
    out = fill_in_middle(docs, FillRule(), key="name", text="body").collect()
    assert sorted(map(tuple, out)) == sorted(expected(i, t, FillRule()) for i, t in [("k1", "some text"), ("k2", "déjà vu")])
