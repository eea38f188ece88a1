"""Sampled segmentation by forward filtering and backward sampling, and lossless decoding.

``alpha[j]`` sums the probabilities of all segmentations of a token's first j characters.
A segmentation is drawn from the end: the last piece with the probability of its share in
``alpha``, then the piece before it, and so on (Scott, 2002; Kudo, Subword Regularization, 2018,
with ``theta`` sharpening or flattening the piece probabilities).

The draws of a text depend on the seed, its row key, and the token's and piece's place only: the same row gives
the same pieces in any partition or batch. Shares are rounded to 32 bits, so that draws compare
integers. Tokens are drawn all at once, edge by edge. A token is a word with all spaces before it, so pieces that are
runs of spaces take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts
from tidelog.llm.pieces import AT_ONCE, MARK, MODEL, MOST_TOKENS, OWN_MARK, Growing, Numbering, Vocabulary, edges_of, tokens_of, vocabulary
from tidelog.llm.words import MULTIPLIER, mix

DRAW_BITS = 32
# Words drawn at once; texts of more are drawn in parts.
MOST_DRAWS = 60_000


@dataclass(frozen=True)
class SamplingRule:
    model: str = MODEL
    theta: float = 1.0
    seed: int = 0


class Lattice:
    """Edges of all tokens: each node (token, end) has its edges' cumulated shares, piece and the node before."""

    def __init__(self, v: Vocabulary, theta: float):
        self.v, self.theta = v, theta
        # A character without a piece has an edge of this weight, and a number after those of the pieces.
        self.unknown, self.logp = theta * v.unknown, theta * v.logp
        self.clear()

    def clear(self) -> None:
        self.tokens, self.chars = Numbering(), Numbering()
        self.last = Growing(np.int64)  # node of each token's end
        self.first = Growing(np.int64)  # first edge of each node
        self.nodes = 0
        self.share, self.before, self.piece = Growing(np.uint32), Growing(np.int32), Growing(np.int32)

    def number(self, tokens: list[str]) -> np.ndarray:
        number = self.tokens.of(tokens)
        fresh = list(islice(self.tokens, self.last.size, None))
        for i in range(0, len(fresh), AT_ONCE):
            self._add(fresh[i : i + AT_ONCE])
        return number

    def _add(self, tokens: list[str]) -> None:
        """Edges of new tokens, ordered by node."""
        edges = edges_of(tokens, self.v)
        chars = self.chars.of(edges.bare) + len(self.v.pieces)
        weight = np.append(self.logp, np.full(len(chars), self.unknown))[edges.piece]
        # Forward filtering in logarithms, one position of all tokens at a time.
        alpha, mass = np.zeros(edges.base[-1]), np.zeros(len(weight))
        for at in edges.levels():
            node = edges.node[at]
            log = weight[at] + alpha[edges.before[at]]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
            top = np.maximum.reduceat(log, first)
            mass[at] = np.exp(log - top[group])
            alpha[node[first]] = top + np.log(np.bincount(group, weights=mass[at]))
        node = edges.node
        first = np.append(True, node[1:] != node[:-1])[: len(node)]
        group = np.cumsum(first) - 1
        # Shares cumulated per node; a sum over all edges would lose digits in different ways in different batches.
        share = mass / np.bincount(group, weights=mass)[group]
        run, place = share.copy(), np.arange(len(node)) - np.flatnonzero(first)[group]
        for i in range(1, int(place.max()) + 1 if len(place) else 0):
            at = np.flatnonzero(place == i)
            run[at] += run[at - 1]
        top = np.uint64((1 << DRAW_BITS) - 1)
        upper = np.minimum((run * (1 << DRAW_BITS)).astype(np.uint64), top)
        upper[np.append(first[1:], True)[: len(node)]] = top
        firsts = np.searchsorted(node, np.arange(edges.base[-1])) + self.share.size
        self.first.append(firsts)
        self.share.append(upper)
        self.before.append(edges.before + self.nodes)
        self.piece.append(np.append(np.arange(len(self.v.pieces)), chars)[edges.piece])
        self.last.append(edges.base[1:] - 1 + self.nodes)
        self.nodes += int(edges.base[-1])

    def draw(self, number: np.ndarray, place: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of tokens (by ``number``) in order, and each one's token; draws depend on ``salt`` and ``place``."""
        node, base = self.last.values[number], mix(salt + (place.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
        starts = self.last.values[number] - self.sizes(number)
        live, step, out = np.arange(len(number)), 0, []
        while len(live):
            random = mix(base[live] + np.uint64(step << 40)) >> np.uint64(64 - DRAW_BITS)
            edge = self.first.values[node[live]]
            # A node has few edges; the first whose cumulated share reaches the draw is taken.
            short = np.flatnonzero(self.share.values[edge] < random)
            while len(short):
                edge[short] += 1
                short = short[self.share.values[edge[short]] < random[short]]
            out.append((live, np.full(len(live), step), self.piece.values[edge]))
            node[live] = self.before.values[edge]
            live = live[node[live] > starts[live]]
            step += 1
        token, step, piece = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((-step, token))
        return piece[order], token[order]

    def sizes(self, number: np.ndarray) -> np.ndarray:
        return np.diff(self.last.values, prepend=-1)[number] - 1


class Sampler:
    def __init__(self, rule: SamplingRule):
        self.rule, self.v = rule, vocabulary(rule.model, runs=True)
        self.lattice = Lattice(self.v, rule.theta)
        self.byte_of = {int(i): b for b, i in enumerate(self.v.byte_ids)}
        self.spelling = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.v.pieces)]

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray]:
        """Piece ids of each text; none for null and empty ones."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        tokens: list[str] = []
        owner: list[tuple[int, int, int]] = []  # text, first place, number of tokens
        for i, text in enumerate(texts):
            if not text:
                continue
            own = tokens_of(text.replace(MARK, OWN_MARK), self.v)
            for lo in range(0, len(own), MOST_DRAWS):
                part = own[lo : lo + MOST_DRAWS]
                tokens += part
                owner.append((i, lo, len(part)))
                if len(tokens) >= MOST_DRAWS:
                    self._draw(tokens, owner, keys, out)
                    tokens, owner = [], []
        self._draw(tokens, owner, keys, out)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    def _draw(self, tokens: list[str], owner: list[tuple[int, int, int]], keys: list, out: list[list[np.ndarray]]) -> None:
        if not tokens:
            return
        if len(self.lattice.tokens) > MOST_TOKENS:
            self.lattice.clear()
        counts = np.array([n for _, _, n in owner])
        place = np.concatenate([np.arange(lo, lo + n) for _, lo, n in owner])
        salt = np.array([xxhash.xxh3_64_intdigest(repr(keys[i]), seed=self.rule.seed) for i, _, _ in owner], np.uint64)
        piece, token = self.lattice.draw(self.lattice.number(tokens), place, np.repeat(salt, counts))
        cuts = np.searchsorted(token, np.cumsum(counts)[:-1])
        for (i, _, _), ids in zip(owner, np.split(piece, cuts), strict=True):
            out[i].append(self._as_ids(ids))

    def _as_ids(self, piece: np.ndarray) -> np.ndarray:
        """Characters without a piece become the ids of their bytes."""
        bare = np.flatnonzero(piece >= len(self.v.pieces))
        if not len(bare):
            return piece
        chars = list(self.lattice.chars)
        parts, last = [], 0
        for at in bare.tolist():
            spelt = chars[piece[at] - len(self.v.pieces)].replace(OWN_MARK, MARK).encode("utf-8")
            parts += [piece[last:at], self.v.byte_ids[list(spelt)]]
            last = at + 1
        return np.concatenate([*parts, piece[last:]])

    def decode(self, ids: np.ndarray) -> str:
        spelt = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        return spelt[1:].decode("utf-8")


def sampled_pieces(docs: DataFrame, rule: SamplingRule = SamplingRule(), key: str = "doc_id", text: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key (or the columns ``keep``; ``with_text``: and the text), n_tokens, token_ids, lossless.

    ``lossless`` says that decoding the ids gives the text back; a null text has null ids, an empty one has none, and
    both count as lossless. Equal texts with equal keys get equal ids; rows with a null key are drawn as rows of one key.
    """
    keep = [key] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(rule)
        for batch in in_parts(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = sampler.encode(texts, batch.column(0).to_pylist())
            same = [not t or sampler.decode(x) == t for t, x in zip(texts, ids, strict=True)]
            rows = pa.array([None if t is None else x.astype(np.int32) for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], *batch.columns[1 : 1 + with_text], pa.array([len(x) for x in ids], pa.int64()), rows, pa.array(same, pa.bool_())],
                names=[*keep, *[text] * with_text, "n_tokens", "token_ids", "lossless"],
            )

    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*types, *[f"`{text}` string"] * with_text, "n_tokens long", "token_ids array<int>", "lossless boolean"])
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *keep)
    return rows.mapInArrow(run, schema)
