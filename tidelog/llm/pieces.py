"""A public piece vocabulary inside tasks: numbered words, pieces and their lattices.

A text is cut before every space, or before every run of spaces; a *token* is what lies between,
led by the space mark or by all marks of the run. No piece has a mark behind another character, so
with whole runs no piece reaches across, a token's pieces do not depend on its neighbours, and each
distinct token is worked on once per batch of documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece

from tidelog.llm.words import MULTIPLIER

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Tokens kept between batches, and tokens worked on at once.
MOST_TOKENS, AT_ONCE = 200_000, 16_000
# Stands for a space mark that is a text's own. Not in any text: a surrogate, which UTF-8 has none of.
OWN_MARK = "\udc81"
# Below the rarest piece by this much (natural log) for a character without a piece of its own.
UNKNOWN_PENALTY = 10.0
PIECE_BITS = 32


def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


class Numbering(dict):
    """word -> number, in the order in which words are met."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Growing:
    """An array that grows at its end, by doubling."""

    def __init__(self, dtype: type, shape: tuple[int, ...] = ()):
        self.data, self.size = np.zeros((1024, *shape), dtype), 0

    def append(self, values: np.ndarray) -> None:
        stop = self.size + len(values)
        if stop > len(self.data):
            data = np.zeros((max(stop, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : stop] = values
        self.size = stop

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Trie:
    """The pieces as a trie in a hash table of its steps: (node, character) -> node. All places of a text walk down at once."""

    BITS = 21

    def __init__(self, pieces: list[str], ids: np.ndarray):
        steps, end = {}, [-1]
        for i in ids.tolist():
            node = 0
            for c in pieces[i]:
                key = node << self.BITS | ord(c)
                node = steps.get(key, 0)
                if not node:
                    node = steps[key] = len(end)
                    end.append(-1)
            end[node] = i
        self.end = np.array(end)
        keys, nodes = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << int(64 - int(self.shift))) - 1
        self.key, self.node = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            slot = (self._slot(keys[left]) + self.probes) & self.mask
            free = np.flatnonzero(self.key[slot] < 0)
            slot, first = np.unique(slot[free], return_index=True)
            put = left[free[first]]
            self.key[slot], self.node[slot] = keys[put], nodes[put]
            left = np.setdiff1d(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULTIPLIER >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next node of each, 0 if there is none."""
        key = node << self.BITS | char
        home, out, left = self._slot(key), np.zeros(len(key), np.int64), np.arange(len(key))
        for i in range(self.probes):
            slot = (home[left] + i) & self.mask
            found = self.key[slot]
            hit = found == key[left]
            out[left[hit]] = self.node[slot[hit]]
            left = left[~hit & (found >= 0)]
            if not len(left):
                break
        return out

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stop, size and piece of all pieces in a text (as code points)."""
        place, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        out = [np.zeros((0, 3), np.int64)]
        while len(place):
            node = self.step(node, chars[place + size])
            size += 1
            whole = np.flatnonzero(self.end[node] >= 0)
            out.append(np.stack([place[whole] + size, np.full(len(whole), size), self.end[node[whole]]], axis=1))
            on = (node > 0) & (place + size < len(chars))
            place, node = place[on], node[on]
        return tuple(np.concatenate(out).T)


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model as a unigram vocabulary.

    The file gives merge ranks, not probabilities. By Zipf's law the piece of rank r gets
    a probability in proportion to 1 / (r + 1). Control pieces and bytes are no words of it;
    bytes stand for characters that no piece spells. Matches come from the automaton, or else from the trie.
    """

    pieces: list[str]
    logp: np.ndarray
    marked: np.ndarray  # pieces that start with the space mark
    byte_ids: np.ndarray
    automaton: ahocorasick.Automaton | None
    trie: Trie | None
    token: re.Pattern
    runs: bool = False

    @property
    def unknown(self) -> float:
        return float(self.logp[np.isfinite(self.logp)].min()) - UNKNOWN_PENALTY


def vocabulary(model: str = MODEL, runs: bool = False, automaton: bool = False) -> Vocabulary:
    """``runs``: with the pieces that are runs of two or more marks, for tokens led by all spaces before a word (``tokens_of``)."""
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    usual = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(pieces))])
    # Other tokens are led by one mark; runs would reach across them.
    usual &= np.array([runs or MARK not in p[1:] for p in pieces])
    token = token_pattern([pieces[i] for i in np.flatnonzero(usual)])
    rank = np.cumsum(usual)
    total = np.log((1.0 / np.arange(1, usual.sum() + 1)).sum())
    logp = np.where(usual, -np.log(np.maximum(rank, 1)) - total, -np.inf)
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    marked = np.array([p.startswith(MARK) for p in pieces])
    if not automaton:
        return Vocabulary(pieces, logp, marked, byte_ids, None, Trie(pieces, np.flatnonzero(usual)), token, runs)
    searcher = ahocorasick.Automaton()
    for i in np.flatnonzero(usual):
        searcher.add_word(pieces[i], len(pieces[i]) << PIECE_BITS | int(i))
    searcher.make_automaton()
    return Vocabulary(pieces, logp, marked, byte_ids, searcher, None, token, runs)


@dataclass(frozen=True)
class Edges:
    """Pieces inside tokens, ordered by node and then by start. Nodes are positions (0 .. length) of
    all tokens in a row; an edge leads from node ``before`` to ``node``."""

    base: np.ndarray  # first node of each token, and the number of all nodes
    before: np.ndarray
    node: np.ndarray
    level: np.ndarray  # position of ``node`` in its token
    piece: np.ndarray  # from ``len(pieces)`` on: a character that no piece spells
    bare: list[str]  # those characters, in the order of their edges

    def levels(self) -> list[np.ndarray]:
        """Edges by level, 1 first."""
        by_level = np.argsort(self.level, kind="stable")
        return np.split(by_level, np.flatnonzero(np.diff(self.level[by_level])) + 1) if len(by_level) else []


def edges_of(tokens: list[str], v: Vocabulary) -> Edges:
    """The lattice of tokens. Automaton or trie run over all of them at once."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = "\n".join(tokens)
    chars = code_points(text)
    if v.trie is not None:
        stop, size, piece = v.trie.matches(chars)
    else:
        found = np.fromiter(chain.from_iterable(v.automaton.iter(text)), np.int64).reshape(-1, 2)
        stop, size, piece = found[:, 0] + 1, found[:, 1] >> PIECE_BITS, found[:, 1] & ((1 << PIECE_BITS) - 1)
    token = np.repeat(np.arange(len(tokens)), sizes + 1)[stop - 1]
    level = stop - base[token]
    start = level - size
    # Inside one token; and a space mark beyond the marks that lead a token is one of the text's own.
    led = np.ones(len(tokens), np.int64)
    if v.runs:
        others = np.cumsum(chars != ord(MARK))
        before = np.append(0, others)[base[:-1]]
        leading = np.flatnonzero(others == np.repeat(before, sizes + 1)[: len(chars)])
        led = np.bincount(np.searchsorted(base, leading, side="right") - 1, minlength=len(tokens))
    usual = (start >= 0) & (level <= sizes[token]) & ((start < led[token]) | ~v.marked[piece])
    stop, size, piece, level = stop[usual], size[usual], piece[usual], level[usual]
    spelt = np.zeros(base[-1], bool)
    spelt[base[:-1]] = spelt[stop[size == 1]] = True
    node = np.flatnonzero(~spelt)
    if len(node):
        owner = np.searchsorted(base, node, side="right") - 1
        bare = [tokens[t][i - 1] for t, i in zip(owner.tolist(), (node - base[owner]).tolist(), strict=True)]
        stop, size = np.append(stop, node), np.append(size, np.ones(len(node), np.int64))
        piece = np.append(piece, len(v.pieces) + np.arange(len(node)))
        level = np.append(level, node - base[owner])
    else:
        bare = []
    order = np.argsort(stop * (int(size.max(initial=1)) + 1) - size, kind="stable")
    stop, size = stop[order], size[order]
    return Edges(base, stop - size, stop, level[order], piece[order], bare)


LETTER = "[A-Za-z\u00c0-\u024f]"
# A run of marks with what follows it, up to a line feed; runs of line feeds; what else follows one.
LINES = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
# The same, cut between a Latin letter and a full stop or comma as well.
CLAUSES = re.compile(f"(?:{MARK}+|[^{MARK}\n])[^{MARK}\n.,]*+(?:(?<!{LETTER})[.,][^{MARK}\n.,]*+)*+|\n+")


def token_pattern(pieces: list[str]) -> re.Pattern:
    """Where texts may be cut: no piece may reach across. Shorter tokens repeat more often."""
    if any("\n" in p and p.strip("\n") for p in pieces):
        raise ValueError("a piece reaches across lines")
    return LINES if any(re.search(f"{LETTER}[.,]", p) for p in pieces) else CLAUSES


def tokens_of(text: str, v: Vocabulary) -> list[str]:
    """Tokens of a text that gets a space in front; a run of spaces leads one token with the word after it."""
    return v.token.findall(MARK + text.replace(" ", MARK))
