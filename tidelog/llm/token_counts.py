"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces in each distinct token of a batch.
The best path then carries two numbers per position, the score and the number of pieces.

Tie rules are those of unigram tokenizers: a path replaces another only with a strictly
better score, and paths are tried in order of the start of their last piece, so the longest
last piece wins. A character without a piece of its own costs ``UNKNOWN_PENALTY`` more
than the rarest piece and counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts
from tidelog.llm.pieces import AT_ONCE, MODEL, Growing, Numbering, Vocabulary, edges_of, tokens_of, vocabulary

MOST_TOKENS = 500_000
# Texts are gathered up to this many tokens.
MOST_AT_ONCE = 60_000


def piece_counts(tokens: list[str], v: Vocabulary) -> np.ndarray:
    """Pieces of the best path over each token; all tokens advance by one position at a time."""
    if not tokens:
        return np.zeros(0, np.int64)
    edges = edges_of(tokens, v)
    sizes = np.array([len(c.encode("utf-8", "surrogatepass")) for c in edges.bare], np.int64)
    logp = np.append(v.logp, np.full(len(sizes), v.unknown))
    pieces = np.append(np.ones(len(v.pieces), np.int64), sizes)
    score, count = np.zeros(edges.base[-1]), np.zeros(edges.base[-1], np.int64)
    for at in edges.levels():
        node, before, piece = edges.node[at], edges.before[at], edges.piece[at]
        new = score[before] + logp[piece]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        best = np.maximum.reduceat(new, first)
        # The first edge of a node that has the best score: edges are ordered by start.
        top = np.flatnonzero(new == np.repeat(best, np.diff(np.append(first, len(node)))))
        top = top[np.append(True, node[top][1:] != node[top][:-1])]
        score[node[first]], count[node[first]] = best, count[before[top]] + pieces[piece[top]]
    return count[edges.base[1:] - 1]


def token_counts(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_tokens; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, runs=True, automaton=True)
        known, kept = Numbering(), Growing(np.int64)
        for batch in in_parts(batches, 1):
            texts, out, lo = batch.column(1), [], 0
            while lo < len(texts):
                tokens, sizes = [], []
                while lo < len(texts) and len(tokens) < MOST_AT_ONCE:
                    text = texts[lo].as_py()
                    own = tokens_of(text, v) if text else []
                    tokens += own
                    sizes.append(len(own))
                    lo += 1
                if len(known) > MOST_TOKENS:
                    known, kept = Numbering(), Growing(np.int64)
                number = known.of(tokens)
                fresh = list(islice(known, kept.size, None))
                for i in range(0, len(fresh), AT_ONCE):
                    kept.append(piece_counts(fresh[i : i + AT_ONCE], v))
                total = np.concatenate([[0], np.cumsum(kept.values[number])])
                stops = np.cumsum([0, *sizes])
                out.append(total[stops[1:]] - total[stops[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")
