"""Quality rules: tokenizer fertility, over word counts and repeats.

The words of a text are encoded with a public vocabulary, each by itself. A text that the
vocabulary was not made for, or that is no prose, falls into many short pieces or bytes
(few characters per token, high byte share), or repeats few tokens (low entropy).
Bands per language say what is usual; a language without bands gets the widest ones. Averages over
few words scatter more, so the bands of short texts are wider, by standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts
from tidelog.llm.pieces import MODEL, Numbering, processor
from tidelog.llm.words import grams, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MOST_WORDS = 150_000


@dataclass(frozen=True)
class Band:
    """A text passes with ``chars_per_token`` between (low, high), at most ``tokens_per_word``, at most ``byte_share``
    of byte tokens, and an entropy (bits per token) of at least ``evenness`` times that of equally frequent tokens."""

    chars_per_token: tuple[float, float]
    tokens_per_word: float
    byte_share: float
    evenness: float


# Widest bands, for languages not named, and by language: outside of what labelled good texts of 50 words or more show.
ANY = Band((1.2, 8.0), 6.0, 0.20, 0.40)
BANDS = {
    "en": Band((1.80, 8.0), 3.3, 0.05, 0.45),
    "de": Band((1.90, 8.0), 3.3, 0.05, 0.45),
    "fr": Band((1.60, 8.0), 3.7, 0.05, 0.45),
    "es": Band((1.70, 8.0), 3.4, 0.05, 0.45),
}


@dataclass(frozen=True)
class QualityRules:
    """Base rules: at least ``least_words`` words, at most ``most_repeated`` percent of them in repeated windows of
    ``window`` words. Then the bands, as they stand for texts of at least ``band_words`` words. For fewer they are wider, by
    ``z`` times what a mean over that many words has as standard error beyond one over ``band_words``; ``spread`` are
    the standard deviations by word of characters per token and of tokens, wide enough for labelled good texts with an address in few words."""

    least_words: int = 10
    window: int = 5
    most_repeated: int = 20
    band_words: int = 50
    z: float = 3.0
    spread: tuple[float, float] = (1.2, 8.0)
    model: str = MODEL
    bands: dict[str, Band] = field(default_factory=lambda: BANDS)


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words covered by windows that occur twice or more in the text."""
    runs = grams(hashes, window)
    if not len(runs):
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    turn = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(turn, np.flatnonzero(twice), 1)
    np.add.at(turn, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(turn[:-1]) > 0).sum())


class Fertility:
    """Tokens of words, remembered for up to ``MOST_WORDS`` words."""

    def __init__(self, model: str):
        self.sp = processor(model)
        self.bytes = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.words, self.flat, self.start = Numbering(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def measure(self, words: list[bytes], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, byte tokens and entropy in bits; ``owner`` gives each word's text."""
        if len(self.words) > MOST_WORDS:
            self.clear()
        known = len(self.words)
        number = self.words.of(words)
        fresh = [w.decode("utf-8", "replace") for w in list(self.words)[known:]]
        if fresh:
            ids = self.sp.encode(fresh, num_threads=1)
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int32)])
            self.start = np.append(self.start, self.start[-1] + np.cumsum([len(x) for x in ids]))
        size = np.diff(self.start)[number]
        token = self.flat[np.repeat(self.start[number] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        text = np.repeat(owner, size)
        total = np.bincount(text, minlength=n)
        fallback = np.bincount(text, weights=self.bytes[token], minlength=n)
        pairs, times = np.unique(text * len(self.bytes) + token, return_counts=True)
        share = times / total[pairs // len(self.bytes)]
        entropy = np.bincount(pairs // len(self.bytes), weights=-share * np.log2(share), minlength=n)
        return total, fallback, entropy


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_tokens": "long", "n_byte_tokens": "long", "entropy": "double",
}


def text_measures(docs: DataFrame, rules: QualityRules, key: str = "doc_id", text: str = "text", lang: str = "lang", with_text: bool = False) -> DataFrame:
    """key, lang (``with_text``: the text) and the columns of ``COLUMNS`` for each row; all 0 for null and empty texts."""

    def counts(text: bytes | None) -> tuple[list[bytes], tuple[int, ...]]:
        if not text:
            return [], (0, 0, 0, 0, 0)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        chars = len(text.translate(None, SPACES).decode("utf-8", "replace"))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        repeats = repeated_words(word_hashes(words), rules.window) if words else 0
        return words, (len(words), chars, symbols, len(lines) - len(set(lines)), repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(rules.model)
        for batch in in_parts(batches, 2):
            texts = batch.column(2).to_pylist()
            lo = 0
            while lo < len(texts):
                # Slices of some 100,000 words; a longer text is a slice of its own.
                words, rows, hi = [], [], lo
                while hi < len(texts) and len(words) < 100_000:
                    own, row = counts(texts[hi])
                    words += own
                    rows.append(row)
                    hi += 1
                table = np.array(rows, np.int64)
                measured = fertility.measure(words, np.repeat(np.arange(hi - lo), table[:, 0]), hi - lo)
                columns = [*table.T, *(x.astype(np.int64) for x in measured[:2]), measured[2]]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(own_columns)]), *map(pa.array, columns)], names=[*own_columns, *COLUMNS])
                lo = hi

    own_columns = [key, lang, text] if with_text else [key, lang]
    types = {c: docs.schema[c].dataType.simpleString() for c in (key, lang)} | ({text: "binary"} if with_text else {}) | COLUMNS
    schema = ", ".join(f"`{n}` {t}" for n, t in types.items())
    out = docs.select(key, lang, F.col(text).cast("binary")).mapInArrow(run, schema)
    return out.withColumn(text, F.col(text).cast("string")) if with_text else out


def quality_rules(
    docs: DataFrame, rules: QualityRules | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key (``with_text``: and text), the measures, chars_per_token, tokens_per_word, byte_share, evenness, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Bands widen for texts with fewer
    than ``band_words`` words. Equal rows get equal results; a null
    language has the widest bands.
    """
    rules = rules or QualityRules()
    out = text_measures(docs, rules, key, text, lang, with_text)
    tokens = F.greatest("n_tokens", F.lit(1))
    out = out.withColumns({
        "chars_per_token": F.col("word_chars") / tokens,
        "tokens_per_word": F.col("n_tokens") / F.greatest("n_words", F.lit(1)),
        "byte_share": F.col("n_byte_tokens") / tokens,
        "evenness": F.when(F.col("n_tokens") > 1, F.col("entropy") / F.log2("n_tokens")).otherwise(0.0),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated))

    words = F.greatest("n_words", F.lit(1))
    wider = F.greatest(rules.z * (1 / F.sqrt(words) - 1 / F.sqrt(F.lit(rules.band_words))), F.lit(0.0))
    chars, pieces = (wider * x for x in rules.spread)

    def inside(band: Band):
        low, high = band.chars_per_token
        fertile = F.col("chars_per_token").between(low - chars, high + chars) & (F.col("tokens_per_word") <= band.tokens_per_word + pieces)
        # Byte tokens mostly come by three, as one character.
        bytes_of = band.byte_share + wider * (3 * band.byte_share * (1 - band.byte_share)) ** 0.5
        return fertile & (F.col("byte_share") <= bytes_of) & (F.col("evenness") >= band.evenness)

    passed = F.when(F.lit(False), True)
    for name, band in rules.bands.items():
        passed = passed.when(F.col(lang) == name, inside(band))
    return out.withColumn("kept", ~F.col("base_failed") & passed.otherwise(inside(ANY)))
