"""Byte-level BPE by merge replay over the distinct words of a part of the corpus.

A text is split by the tokenizer's pattern; a match is a *word*, and its tokens do not depend on the words
around it. The distinct words of a part lie in one array of symbols, linked to their neighbours. An inverted
index leads from the rank of a token pair to the positions where it stands. Merges are replayed in the order of
ranks, each at all its positions at once, and only the neighbours of a merged pair get new entries in the index.

A word that is a token by itself gets its id; else the pair whose joined bytes have the lowest rank is merged
first, the leftmost of equal ones. A merge may give a pair of a lower rank than its own (pairs are ranked by their
bytes, not by how these were learnt). Words where that happens leave the replay and are merged one by one.

Null and empty texts give no tokens. Bytes that are not UTF-8 are read as U+FFFD. Every row is one of the
result, repeated rows and null keys included; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts
from tidelog.llm.pieces import Numbering

# Texts of a part, and distinct words whose tokens are kept from part to part.
PART_BYTES, MOST_WORDS = 4 << 20, 200_000
ID_BITS = 20
END, GONE = -1, -2


@dataclass(frozen=True)
class ByteRanks:
    """A rank file as arrays. They are bounded by the vocabulary and travel with the function."""

    flat: np.ndarray  # bytes of all tokens in a row, by id
    starts: np.ndarray
    pairs: np.ndarray  # left << ID_BITS | right, ascending, for all pairs whose joined bytes are a token
    ranks: np.ndarray  # id of that token
    of_byte: np.ndarray
    pattern: str

    def tokens(self) -> list[bytes]:
        whole, at = self.flat.tobytes(), self.starts.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def read_ranks(path: str, pattern: str) -> ByteRanks:
    """The vocabulary in a file with lines of ``base64 rank``; ranks are 0, 1, 2 ..."""
    with open(path, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(known, key=known.get)
    if [known[t] for t in tokens] != list(range(len(tokens))) or len(tokens) >= 1 << ID_BITS:
        raise ValueError(f"{path}: ranks are not 0 to {len(tokens) - 1}")
    found = {}
    for token in tokens:
        for cut in range(1, len(token)):
            left, right = known.get(token[:cut]), known.get(token[cut:])
            if left is not None and right is not None:
                found[left << ID_BITS | right] = known[token]
    pairs = np.array(sorted(found), np.int64)
    return ByteRanks(
        np.frombuffer(b"".join(tokens), np.uint8),
        np.cumsum([0, *map(len, tokens)]),
        pairs,
        np.array([found[p] for p in pairs.tolist()], np.int64),
        np.array([known[bytes([b])] for b in range(256)]),
        pattern,
    )


class Replay:
    """Merges over many words at once."""

    def __init__(self, words: list[bytes], v: ByteRanks):
        self.v = v
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = len(data)
        self.word = np.repeat(np.arange(len(words)), sizes)
        # One place more, so that neighbours beyond a word's ends can be looked up.
        self.symbol = np.append(v.of_byte[data], END)
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)
        self.after[ends - 1] = n
        self.before[ends - sizes] = n
        self.odd = np.zeros(len(words), bool)
        self.index: dict[int, list[np.ndarray]] = {}
        self.due: list[int] = []
        self._enter(np.arange(n), 0)

    def ranks_at(self, places: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; -1 for none."""
        pair = self.symbol[places] << ID_BITS | self.symbol[self.after[places]]
        at = np.minimum(np.searchsorted(self.v.pairs, pair), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[at] == pair, self.v.ranks[at], -1)

    def _enter(self, places: np.ndarray, least: int) -> None:
        """Note the pairs at some places; words with one below ``least`` are no longer replayed."""
        ranks = self.ranks_at(places)
        self.odd[self.word[places[(ranks >= 0) & (ranks < least)]]] = True
        places, ranks = places[ranks >= least], ranks[ranks >= least]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
        stops = np.append(cuts[1:], len(ranks)).tolist()
        for lo, hi, rank in zip(cuts.tolist(), stops, ranks[cuts].tolist(), strict=False):
            if rank in self.index:
                self.index[rank].append(places[lo:hi])
            else:
                self.index[rank] = [places[lo:hi]]
                heapq.heappush(self.due, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and their number per word."""
        n = len(self.word)
        while self.due:
            rank = heapq.heappop(self.due)
            left = np.unique(np.concatenate(self.index.pop(rank)))
            left = left[self.ranks_at(left) == rank]
            right = self.after[left]
            linked = left[1:] == right[:-1]
            if linked.any():
                # Pairs that share a symbol: the first is merged, the second is not, the third is ...
                first = np.flatnonzero(np.append(True, ~linked))
                place = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
                left, right = left[place % 2 == 0], right[place % 2 == 0]
            if len(left):
                beyond = self.after[right]
                self.symbol[left], self.symbol[right] = rank, GONE
                self.after[left], self.before[beyond] = beyond, left
                ahead = self.before[left]
                self._enter(np.concatenate([ahead[ahead < n], left]), rank)
        live = self.symbol[:n] >= 0
        return self.symbol[:n][live], np.bincount(self.word[live], minlength=len(self.odd))


def merge_word(word: bytes, v: ByteRanks) -> list[int]:
    """Tokens of one word, one merge after the other: the lowest rank first, the leftmost of equal ones."""
    symbols = [*v.of_byte[np.frombuffer(word, np.uint8)].tolist(), END]
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))

    def rank_at(i: int) -> int:
        pair = symbols[i] << ID_BITS | symbols[after[i]] if i >= 0 and symbols[i] >= 0 else END
        at = min(int(np.searchsorted(v.pairs, pair)), len(v.pairs) - 1)
        return int(v.ranks[at]) if v.pairs[at] == pair else -1

    due = [(rank, i) for i in range(len(word)) if (rank := rank_at(i)) >= 0]
    heapq.heapify(due)
    while due:
        rank, i = heapq.heappop(due)
        if rank_at(i) != rank:
            continue
        right, symbols[i] = after[i], rank
        after[i] = after[right]
        before[after[i]], symbols[right] = i, GONE
        for j in (before[i], i):
            if (new := rank_at(j)) >= 0:
                heapq.heappush(due, (new, j))
    return [s for s in symbols if s >= 0]


def encode_words(words: list[bytes], v: ByteRanks, whole: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words in a row, and their number per word. ``whole``: ids of the words that are tokens."""
    own = np.fromiter((whole.get(w, -1) for w in words), np.int64, len(words))
    rest = np.flatnonzero(own < 0)
    counts = np.ones(len(words), np.int64)
    if not len(rest):
        return own, counts
    replay = Replay([words[i] for i in rest.tolist()], v)
    ids, counts[rest] = replay.run()
    stops = np.cumsum(counts)
    out = np.empty(stops[-1], np.int64)
    out[stops[own >= 0] - 1] = own[own >= 0]
    out[np.repeat(own < 0, counts)] = ids
    if replay.odd.any():
        parts = np.split(out, stops[:-1])
        for i in rest[replay.odd].tolist():
            parts[i] = np.array(merge_word(words[i], v), np.int64)
        out, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return out, counts


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 for all i in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def bpe_encode(docs: DataFrame, v: ByteRanks, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, token_ids array<int>. Nothing is shuffled: a part of the corpus is replayed where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(v.pattern).findall
        whole = {t: i for i, t in enumerate(v.tokens())}
        number, ids, counts = Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in in_parts(batches, 1, PART_BYTES):
            if len(number) > MOST_WORDS:
                number, ids, counts = Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int64)
            texts = [number.of(split(t.as_py().decode("utf-8", "replace"))) if t.is_valid else np.zeros(0, np.int64) for t in batch.column(1)]
            fresh = [w.encode() for w in list(number)[len(counts) :]]
            if fresh:
                new_ids, new_counts = encode_words(fresh, v, whole)
                ids, counts = np.append(ids, new_ids), np.append(counts, new_counts)
            words = np.concatenate([np.zeros(0, np.int64), *texts])
            sizes = counts[words]
            tokens = ids[spread((np.cumsum(counts) - counts)[words], sizes)].astype(np.int32)
            upto = np.append(0, np.cumsum(sizes))
            stops = upto[np.cumsum([0, *map(len, texts)])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(stops), pa.array(tokens))], names=[key, "token_ids"])

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, token_ids array<int>")


def bpe_decode(encoded: DataFrame, v: ByteRanks, ids: str = "token_ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` (binary, empty without tokens) in place of the ids. An id beyond the vocabulary is an error."""
    kept = [c for c in encoded.columns if c != ids]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*kept).schema.fields) + "decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(v.starts)
        for batch in in_parts(batches, 0, PART_BYTES):
            lists = batch.column(0).fill_null([])
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(sizes)):
                raise ValueError("an id is not in the vocabulary")
            data = v.flat[spread(v.starts[:-1][tokens], sizes[tokens])]
            stops = np.cumsum([0, *lists.value_lengths().to_pylist()])
            offsets = np.append(0, np.cumsum(sizes[tokens]))[stops].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], decoded], names=[*kept, "decoded"])

    return encoded.select(ids, *kept).mapInArrow(run, schema)
