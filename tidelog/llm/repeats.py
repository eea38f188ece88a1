"""Removal of word windows that occur more than once in a corpus.

A window is ``words`` consecutive words. It goes, with every word it covers, when the
same words also start at any other place of the input, in the same document or another.

1. Anchors. In each window the smallest hash among its runs of ``anchor`` words marks one
   anchor. Equal windows have equal anchors, so only windows whose anchor occurs twice can
   repeat. Neighbouring windows share an anchor: about one in twelve words carries one.
   Consecutive windows with one anchor form a *range*, which is known by the hash of all
   its words: an equal range elsewhere settles all its windows at once.
2. Windows of the remaining ranges with a repeated anchor are compared one by one.
3. Runs of repeated windows are merged per document and cut out.

Rows of one anchor or window met in the same batch of documents are settled there, and only
one of them goes on, so a hot passage costs a shuffle one row per batch.

The README says why the corpus, being its own reference, is compared by fingerprints and not by suffix automata.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts, written
from tidelog.llm.words import grams, long_grams, mix, word_hashes

# What is known of a range or window when its batch is done.
# SETTLED and OPEN need no other rows.
ONCE, MARKED, REPEATED, SETTLED, OPEN = range(5)
LENGTH_BITS = 16


@dataclass(frozen=True)
class WindowRule:
    """``words`` per window; ``anchor`` words per anchor, fewer than ``words``."""

    words: int = 50
    anchor: int = 12

    def ranges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first window and number of windows of each range of a document."""
        n = len(ids) - self.words + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        runs = grams(ids, self.anchor)
        # Minima over the runs of each window by doubling, the leftmost of equal ones.
        at, span, width = np.arange(len(runs)), 1, self.words - self.anchor + 1
        while span < width:
            step = min(span, width - span)
            left, right = at[:-step], at[step:]
            at = np.where(runs[right] < runs[left], right, left)
            span += step
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return runs[at[start]], start, np.diff(np.append(start, n))


def _range_hashes(ids: np.ndarray, start: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """Hash of all words a range covers and of how many there are."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(long_grams(ids, words)), dtype=np.uint64)])
    # The windows of a range, each known by a hash of its words, in any order: the range has one order of them only.
    return mix(total[start + count] - total[start] + count.astype(np.uint64))


def _row_id(key: str, text: str) -> Column:
    """Tells rows apart that share a key; null keys and texts are values like others."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), F.col(text))


def _anchor_rows(docs: DataFrame, rule: WindowRule) -> DataFrame:
    """(anchor, content, id, place, state) of ranges; see ``_settle_ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            parts = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_hashes(text.split()) if text else np.zeros(0, np.uint64)
                anchors, start, count = rule.ranges(ids)
                if len(start):
                    parts.append((anchors, _range_hashes(ids, start, count, rule.words), np.full(len(start), row_id), (start << LENGTH_BITS) + count))
            if not parts:
                continue
            anchor, content, ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((content, anchor))
            anchor, content, ids, place = anchor[order], content[order], ids[order], place[order]
            first = np.append(True, anchor[1:] != anchor[:-1])
            new = first | np.append(True, content[1:] != content[:-1])
            group, part = np.cumsum(first) - 1, np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            mixed = np.bincount(group[new])[group] > 1
            again = np.bincount(part)[part] > 1
            # One row per anchor goes on by the anchor; ranges of mixed anchors are looked into anyway.
            yield _batch(anchor, content, ids, place, np.where(mixed, MARKED, np.where(again, REPEATED, ONCE)), first)
            settled = np.flatnonzero(again & (mixed | ~first))
            yield _batch(*(x[settled] for x in (anchor, content, ids, place)), np.full(len(settled), SETTLED), None)
            open_ = np.flatnonzero(many & mixed & new)
            yield _batch(*(x[open_] for x in (anchor, content, ids, place)), np.full(len(open_), OPEN), None)

    return docs.select("__id", F.col("__text").cast("binary")).mapInArrow(run, "anchor long, content long, id long, place long, state int")


def _batch(anchor, content, ids, place, state, use) -> pa.RecordBatch:
    at = slice(None) if use is None else np.flatnonzero(use)
    longs = [x[at].view(np.int64) for x in (anchor, content, ids, place)]
    return pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(state[at].astype(np.int32))], names=["anchor", "content", "id", "place", "state"])


def _settle_ranges(rows: DataFrame) -> DataFrame:
    """(id, place, open): ranges that repeat as a whole (``open`` false) and ranges whose
    windows must be compared (``open`` true).

    Rows come sorted by anchor, one per anchor and batch of documents. An anchor of one
    row that is alone and unmarked is dropped. If an anchor's rows differ in content, one
    of each content is open, since its windows may be those of another range.
    """

    def decide(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        anchor, content, state = t["anchor"], t["content"], t["state"]
        first = np.append(True, anchor[1:] != anchor[:-1])
        new = first | np.append(True, content[1:] != content[:-1])
        group, part = np.cumsum(first) - 1, np.cumsum(new) - 1
        mixed = (np.bincount(group, weights=state == MARKED)[group] > 0) | (np.bincount(group[new])[group] > 1)
        again = (np.bincount(part)[part] > 1) | (np.bincount(part, weights=state == REPEATED)[part] > 0)
        return answer(t, again, mixed & new)

    def answer(t: dict[str, np.ndarray], settled: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
        at = np.append(np.flatnonzero(settled), np.flatnonzero(open_))
        flag = np.arange(len(at)) >= settled.sum()
        return pa.RecordBatch.from_arrays([pa.array(t["id"][at]), pa.array(t["place"][at]), pa.array(flag)], names=["id", "place", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
            yield answer(t, t["state"] == SETTLED, t["state"] == OPEN)
            t = {n: x[t["state"] < SETTLED] for n, x in t.items()}
            if held is not None:
                t = {n: np.concatenate([held[n], t[n]]) for n in t}
            cut = int(np.searchsorted(t["anchor"], t["anchor"][-1])) if len(t["anchor"]) else 0
            held = {n: x[cut:] for n, x in t.items()}
            if cut:
                yield decide({n: x[:cut] for n, x in t.items()})
        if held is not None and len(held["anchor"]):
            yield decide(held)

    route = F.when(F.col("state") < SETTLED, F.col("anchor")).otherwise(F.col("id"))
    return rows.repartition(route).sortWithinPartitions("anchor", "content").mapInArrow(run, "id long, place long, open boolean")


def _window_rows(docs: DataFrame, rule: WindowRule) -> DataFrame:
    """(window, id, start, state) for the windows of open ranges (column ``places``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2):
            parts = []
            for row_id, text, places in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                windows = long_grams(word_hashes(text.split()), rule.words)
                starts = np.concatenate([np.arange(p >> LENGTH_BITS, (p >> LENGTH_BITS) + (p & ((1 << LENGTH_BITS) - 1))) for p in sorted(set(places))])
                starts = starts[starts < len(windows)]
                parts.append((windows[starts], np.full(len(starts), row_id), starts))
            if not parts:
                continue
            window, ids, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, inverse = np.unique(window, return_index=True, return_inverse=True)
            many = np.bincount(inverse)[inverse] > 1
            lead = np.zeros(len(window), bool)
            lead[first] = True
            state = np.where(lead, np.where(many, REPEATED, ONCE), SETTLED)
            for lo in range(0, len(window), 100_000):
                at = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (window, ids, start)), pa.array(state[at].astype(np.int32))], names=["window", "id", "start", "state"])

    return docs.mapInArrow(run, "window long, id long, start long, state int")


def _repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, start) of windows that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held, t, strict=True)]
            if not len(t[0]):
                continue
            # The last row waits: the next batch may go on with its window.
            yield decide(t, len(t[0]) - 1)
            carried = t[3][-1] if len(t[0]) < 2 or t[0][-1] != t[0][-2] or t[3][-1] == SETTLED else REPEATED
            held = [x[-1:] for x in t[:3]] + [np.array([carried], t[3].dtype)]
        if held is not None:
            yield decide(held, 1)

    def decide(t: list[np.ndarray], n: int) -> pa.RecordBatch:
        window, ids, start, state = t
        fresh = state < SETTLED
        same = (window[1:] == window[:-1]) & fresh[1:] & fresh[:-1]
        twice = np.append(False, same) | np.append(same, False) | (state != ONCE)
        at = np.flatnonzero(twice[:n])
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(start[at])], names=["id", "start"])

    route = F.when(F.col("state") < SETTLED, F.col("window")).otherwise(F.col("id"))
    order = [F.col("state") == SETTLED, "window"]
    return rows.repartition(route).sortWithinPartitions(*order).mapInArrow(run, "id long, start long")


def _cut(docs: DataFrame, rule: WindowRule, key: str, schema: str, as_is: bool) -> DataFrame:
    """n_words, n_removed and the kept words of rows (key, id, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split() if text else []
                keep = words
                if places:
                    turn = np.zeros(len(words) + 1, np.int64)
                    for p in places:
                        start, count = p >> LENGTH_BITS, p & ((1 << LENGTH_BITS) - 1)
                        turn[start] += 1
                        turn[min(start + count - 1 + rule.words, len(words))] -= 1
                    keep = [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                kept.append(text if as_is and keep is words else b" ".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=[key, "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, rule: WindowRule, key: str = "doc_id", text: str = "text", as_is: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept (binary, the words left joined by one space;
    with ``as_is``, texts that lose nothing come back unchanged).

    Null and empty texts have no words. Null keys and keys that occur twice are no hindrance: every row
    is a document of its own, so of two equal rows of enough words all words go. Windows are compared by 64-bit
    hashes, rows are known by a 64-bit hash of key and text.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("__key"), _row_id(key, text).alias("__id"), F.col(text).alias("__text"))
    ranges = written(_settle_ranges(_anchor_rows(texts, rule)))

    def with_places(places: DataFrame, how: str) -> DataFrame:
        """Texts with the set of their places. Both uses read the same columns, so one shuffle of the texts serves both."""
        places = places.groupBy("id").agg(F.collect_set("place").alias("places"))
        joined = texts.join(places, F.col("__id") == F.col("id"), how)
        return joined.select("__key", "__id", F.col("__text").cast("binary").alias("__text"), "places")

    windows = _repeated_windows(_window_rows(with_places(ranges.where("open"), "inner"), rule))
    single = F.shiftleft("start", LENGTH_BITS) + 1
    cut = ranges.where("not open").select("id", "place").unionByName(windows.select("id", single.alias("place")))
    return _cut(with_places(cut, "left"), rule, key, f"`{key}` {kind}, n_words long, n_removed long, kept binary", as_is)

