"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. A word's probability
is the sum over all its segmentations into pieces (forward algorithm), a text's the product
over its words. Probabilities are learnt by one step of expectation maximisation from the
vocabulary's own ranks: expected piece counts of each distinct word (forward and backward
sums), weighted by the word's count per language, over all texts learnt from.

The model has at most ``MOST_LANGUAGES`` times the vocabulary's size numbers, whatever the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts
from tidelog.llm.pieces import AT_ONCE, MARK, MODEL, Edges, Growing, Numbering, Vocabulary, edges_of, vocabulary

MOST_LANGUAGES = 200
# Weight of the vocabulary's own probabilities among the counts of a language.
PRIOR = 1000.0
# Runs of letters are scored in parts of this length, which keeps sums above the smallest double.
LONGEST = 32
MOST_WORDS, MOST_AT_ONCE = 200_000, 200_000
# Scores of words (times languages) kept from text to text.
MOST_NUMBERS = 2_000_000
UNKNOWN = 1e-9
RUN = re.compile(r"[^\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    words = RUN.findall(text.lower()) if text else []
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def forward(edges: Edges, p: np.ndarray) -> np.ndarray:
    """Probability of reaching each node; ``p`` has a column per language."""
    alpha = np.zeros((edges.base[-1], p.shape[1]))
    alpha[edges.base[:-1]] = 1.0
    for at in edges.levels():
        node = edges.node[at]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        alpha[node[first]] = np.add.reduceat(alpha[edges.before[at]] * p[edges.piece[at]], first, axis=0)
    return alpha


def _probabilities(v: Vocabulary, p: np.ndarray, edges: Edges) -> np.ndarray:
    return np.concatenate([p, np.full((len(edges.bare), p.shape[1]), UNKNOWN)])


def expected_counts(words: list[str], weight: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Expected pieces (rows) of words that occur ``weight`` times per language (columns)."""
    edges = edges_of([MARK + w for w in words], v)
    p = _probabilities(v, np.exp(v.logp)[:, None], edges)
    alpha = forward(edges, p)[:, 0]
    step, beta = p[edges.piece, 0], np.zeros(len(alpha))
    beta[edges.base[1:] - 1] = 1.0
    for at in reversed(edges.levels()):
        np.add.at(beta, edges.before[at], step[at] * beta[edges.node[at]])
    token = np.searchsorted(edges.base, edges.node, side="right") - 1
    share = alpha[edges.before] * step * beta[edges.node] / alpha[edges.base[1:] - 1][token]
    known = edges.piece < len(v.pieces)
    columns = [np.bincount(edges.piece[known], weights=(share * w[token])[known], minlength=len(v.pieces)) for w in weight.T]
    return np.stack(columns, axis=1)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", model: str = MODEL) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a column per language) from rows with text and language."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(count)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())]
            count.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for batch in in_parts(batches, 1):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count.update((name, w) for w in letter_words(t.as_py()))
            if len(count) > MOST_WORDS:
                yield flush()
        yield flush()

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = vocabulary(model, runs=True), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                names, part, n = (c.to_pylist() for c in batch.slice(lo, AT_ONCE).columns)
                langs = sorted(set(names))
                weight = np.zeros((len(part), len(langs)))
                weight[np.arange(len(part)), [langs.index(x) for x in names]] = n
                for name, column in zip(langs, expected_counts(part, weight, v).T, strict=True):
                    total[name] = total.get(name, 0.0) + column
        for name, column in total.items():
            piece = np.flatnonzero(column)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(piece), pa.string()), pa.array(piece, pa.int64()), pa.array(column[piece])], names=["lang", "piece", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = counted.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    v = vocabulary(model, runs=True)
    found = sums.limit(MOST_LANGUAGES * len(v.pieces) + 1).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    p = PRIOR * np.repeat(np.exp(v.logp)[:, None], len(langs), axis=1)
    column = np.array([langs.index(x) for x in found["lang"].to_pylist()], np.int64)
    np.add.at(p, (found["piece"].to_numpy(), column), found["n"].to_numpy())
    return langs, p / p.sum(axis=0) if langs else p


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score.

    ``score`` is the posterior of the best language with equal priors; of equal ones the first by name is taken. Texts
    that are null or without a letter, and all texts if nothing was learnt, are ``und`` with score 0.
    """
    spread = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = vocabulary(model, runs=True), spread.value
        known, logs = Numbering(), Growing(np.float64, (len(langs),))
        for batch in in_parts(batches, 1):
            texts, preds, scores, lo = batch.column(1), [], [], 0
            while lo < len(texts):
                words, sizes, letters = [], [], []
                while lo < len(texts) and len(words) < MOST_AT_ONCE:
                    own = letter_words(texts[lo].as_py())
                    letters.append(has_letter(own))
                    words += own
                    sizes.append(len(own))
                    lo += 1
                if len(known) * (1 + len(langs)) > MOST_NUMBERS:
                    known, logs = Numbering(), Growing(np.float64, (len(langs),))
                number = known.of(words)
                fresh = list(islice(known, logs.size, None))
                for i in range(0, len(fresh), AT_ONCE):
                    edges = edges_of([MARK + w for w in fresh[i : i + AT_ONCE]], v)
                    alpha = forward(edges, _probabilities(v, p, edges))
                    logs.append(np.log(alpha[edges.base[1:] - 1]))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total = np.stack([np.bincount(owner, weights=c, minlength=len(sizes)) for c in logs.values[number].T], axis=1) if langs else np.zeros((len(sizes), 1))
                best = total.argmax(axis=1)
                posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                usable = np.array(letters) & bool(langs)
                preds += [langs[b] if u else "und" for b, u in zip(best.tolist(), usable.tolist(), strict=True)]
                scores.append(np.where(usable, posterior, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")
