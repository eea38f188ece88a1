"""Byte-level BPE against the tiktoken library, also where a merge gives a pair of a lower rank."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from tidelog.llm.byte_bpe import Replay, bpe_decode, bpe_encode, encode_words, merge_word, read_ranks
from tidelog.llm.common import table
from tidelog.llm.queries import byte_bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH, public_tokenizers.PATTERN)


def words(n, seed=5):
    rng = random.Random(seed)
    alphabets = ["ab", "aaab", "é中\U0001f642a", "they in", "0123456789", "andingestions", "".join(map(chr, range(0x20, 0x250)))]
    out = ("".join(rng.choice(a) for _ in range(rng.randint(1, 40))) for a in alphabets for _ in range(n))
    return [w for w in dict.fromkeys(out) if regex.findall(public_tokenizers.PATTERN, w) == [w]]


def test_replay_equals_the_library(ranks):
    own, known = library(PATH), words(400)
    ids, counts = encode_words([w.encode() for w in known], ranks, {t: i for i, t in enumerate(ranks.tokens())})
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [own.encode_ordinary(w) for w in known]
    for word in known[:300]:
        tokens = own.encode_ordinary(word)
        assert len(tokens) == 1 or merge_word(word.encode(), ranks) == tokens


def test_pairs_of_lower_rank_than_the_merge_before(tmp_path):
    # "bc" comes late, but "abc" (from "ab" and "c") early: after b and c are joined, a and bc rank lower.
    tokens = [bytes([b]) for b in range(256)] + [b"xbc", b"abc", b"bc", b"ab", b"bcbc", b"bb", b"bbb"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    ranks, own = read_ranks(str(path), public_tokenizers.PATTERN), library(path)
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 25))) for _ in range(2000)})
    replay = Replay([w.encode() for w in known], ranks)
    replay.run()
    assert replay.odd.any()
    ids, counts = encode_words([w.encode() for w in known], ranks, {t: i for i, t in enumerate(ranks.tokens())})
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [own.encode_ordinary(w) for w in known]


def test_encode_and_decode(spark, ranks):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n  \t x", "don't  we'll", "x" * 70_000, " " * 30_000 + "y", "1 MB " * 210_000, "é中\U0001f642�   z", "<|endoftext|>"]
    texts += [" ".join(rng.choice(words(20)) for _ in range(20_000)), *["same again"] * 3]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "null key", 0), (None, None, 0), (1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int").repartition(3)
    encoded = bpe_encode(docs, ranks)
    assert encoded.dtypes == [("doc_id", "bigint"), ("token_ids", "array<int>")]
    own = library(PATH)
    expected = sorted((str(i), own.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.token_ids) for r in encoded.collect()) == expected
    decoded = bpe_decode(encoded, ranks)
    assert decoded.columns == ["doc_id", "decoded"]
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in decoded.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    assert bpe_encode(docs.limit(0), ranks).count() == 0
    assert bpe_decode(spark.createDataFrame([(1, None), (2, [])], "k int, token_ids array<int>"), ranks).collect() == [(1, b""), (2, b"")]


def test_invalid_bytes_and_unknown_ids(spark, ranks):
    broken = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bpe_encode(broken, ranks).first().token_ids == library(PATH).encode_ordinary("a�b")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_decode(spark.createDataFrame([([60_000],)], "token_ids array<int>"), ranks).collect()


def test_query_equals_the_library(spark):
    own = library(PATH)
    expected = set()
    for r in table(spark, SF, "documents").collect():
        ids = own.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in byte_bpe(spark, SF).collect()} == expected
