"""Fill-in-middle: a text is cut at two places and its parts change order.

Cuts are drawn in code points, texts are UTF-8. A sparse index holds the multibyte characters alone: their
positions in code points and the bytes beyond the first that all of them up to each one have. The byte of a cut is
then the cut plus the excess of the characters before it, found by ``searchsorted``; where a text is ASCII there is
nothing to look up. The index covers all texts of an Arrow batch at once.

A row's draws depend on its id and the seed alone. Null texts count as empty; a null id is drawn for as an empty one.
Equal ids with different texts use the same draws. Every row is one of the result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts

# Marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FillRule:
    """Of 100 texts, ``changed`` are cut; of 100 cut ones, ``suffix_first`` start with the suffix."""

    changed: int = 90
    suffix_first: int = 20
    seed: int = 1


class ExceptionIndex:
    """Multibyte characters of UTF-8 bytes: position in code points, and excess bytes up to and including it."""

    def __init__(self, data: np.ndarray):
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        upto = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.excess = np.append(0, upto)
        self.byte, self.place = at, at - self.excess[:-1]

    def bytes_of(self, places: np.ndarray) -> np.ndarray:
        """Byte positions of positions in code points."""
        return places + self.excess[np.searchsorted(self.place, places)]

    def places_of(self, positions: np.ndarray) -> np.ndarray:
        """Positions in code points of byte positions where a character starts."""
        return positions - self.excess[np.searchsorted(self.byte, positions)]


def draws(key: Column, seed: int) -> dict[str, Column]:
    """Four numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return {f"h{i + 1}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}


def fill_in_middle(docs: DataFrame, rule: FillRule = FillRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n (code points), form (plain, psm or spm), prefix_chars and middle_chars
    (null if plain), output. Texts that contain a mark stay plain, so that every output can be turned back."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbers = draws(F.col(key), rule.seed)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (numbers["h3"] % 100 >= rule.changed)
    form = F.when(plain, "plain").when(numbers["h4"] % 100 < rule.suffix_first, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
        for batch in in_parts(batches, 0):
            texts = pa.concat_arrays([batch.column(0)])  # a slice of its own: offsets start at 0
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.append(0, np.cumsum(sizes))
            whole = b"".join(texts.to_pylist())
            index = ExceptionIndex(np.frombuffer(whole, np.uint8))
            first = index.places_of(base)
            n = np.diff(first)
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) % (n + 1) for i in (2, 3))
            low, high = np.minimum(one, two), np.maximum(one, two)
            cut, stop = index.bytes_of(first[:-1] + low), index.bytes_of(first[:-1] + high)
            out = []
            for form, a, b, c, d in zip(batch.column(4).to_pylist(), base.tolist(), cut.tolist(), stop.tolist(), base[1:].tolist(), strict=False):
                if form == "plain":
                    out.append(whole[a:d])
                elif form == "psm":
                    out.append(b"".join([p, whole[a:b], s, whole[c:d], m, whole[b:c]]))
                else:
                    out.append(b"".join([s, whole[c:d], p, whole[a:b], m, whole[b:c]]))
            changed = pc.not_equal(batch.column(4), "plain")
            chars = [pc.if_else(changed, pa.array(c), None) for c in (low, high - low)]
            columns = [batch.column(1), pa.array(n), batch.column(4), *chars, pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = docs.select(body.cast("binary").alias("text"), F.col(key).alias("key"), numbers["h1"].alias("h1"), numbers["h2"].alias("h2"), form.alias("form"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return drawn.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text behind an output of ``fill_in_middle``. A changed text holds no mark of its own, so its output has just three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*[parts.getItem(i) for i in places])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
