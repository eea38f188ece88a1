"""Phrases of words that occur together more often than apart, by dynamic itemset counting.

The texts are numbered word by word, once, and dealt into shards, which are scanned one after the other in a circle. All words are counted from the
first scan on. Once a phrase has the threshold in what was scanned so far it is *ripe*, and a longer phrase is
counted from the scan after that in which both of its subphrases (without its last word, without its first) became
ripe, for one full circle: each shard once, so its count is exact. All lengths are under way at the same time, and
the last circle ends ``shards`` scans after the last phrase became ripe.

Tasks know ripe phrases by an activation table of fixed size: per slot the scan after which it was set. A phrase has
two slots; it is ripe after the later of them, but not before its own first scan. Slots are set once, so the scan in which a phrase starts never
changes. Phrases that share their slots by chance start without need, which costs work but changes no count: what
starts is counted for a full circle, in which each scan reaches it, and the threshold is applied to exact counts. A phrase with the threshold has
subphrases with the threshold, so none is missed. The table takes ``slots`` bytes in each worker (less on
its way, compressed) and new entries ``slots`` / 8 on their way through the driver, whatever the corpus. Counts stay in a table keyed by the phrases themselves; phrases
that end their circle below the threshold leave it.

Null texts count as empty, a null group as ``und``. Repeated rows count as often as they stand. Groups (languages)
share nothing but the table. No row is needed: an empty corpus has no phrases. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.pieces import Numbering
from tidelog.llm.words import MULTIPLIER, mix
from tidelog.session import scratch_dir

# Words that are counted together.
PART_WORDS = 1_500_000
NEVER = 255
# No byte of UTF-8; stands between the pieces of a text.
BREAK = b"\xff"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(0xFF if b in SEPARATORS else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
STATE = "lang string, phrase binary, start int, n long, ripe boolean"


@dataclass(frozen=True)
class PhraseRule:
    """Phrases of 2 to ``longest`` words that occur ``least`` times. ``slots`` (a power of two) should be some ten times
    the number of phrases with that many occurrences; with fewer, more phrases are counted in vain."""

    longest: int = 5
    least: int = 100
    shards: int = 3
    slots: int = 1 << 24

    def __post_init__(self):
        if self.shards * self.longest >= NEVER or self.slots & (self.slots - 1):
            raise ValueError("shards * longest must be below 255, slots a power of two")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, with ``BREAK`` after each of its pieces. A-Z are lower-cased; only space and tab part words."""
    return text.translate(FOLD).replace(BREAK, b" \xff ").split() + [BREAK]


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their two subphrases."""
    return mix(left * MULTIPLIER + right)


def phrase_hash(lang: str, phrase: bytes) -> int:
    h = np.array([word_hash(lang, w) for w in phrase.split(b" ")], np.uint64)
    while len(h) > 1:
        h = joined(h[:-1], h[1:])
    return int(h[0])


def slots_of(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(slots - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(slots - 1)).astype(np.int64)


@dataclass(frozen=True)
class Part:
    """Some texts of a language as numbers of its words, each text and piece ended by 0. Word 0 is the break."""

    lang: str
    words: list[bytes]
    hashes: np.ndarray
    ids: np.ndarray


PART = "shard int, lang string, words binary, hashes binary, ids binary"


def in_shards(docs: DataFrame, rule: PhraseRule, text: str, lang: str) -> DataFrame:
    """The texts as parts, dealt into shards (see ``Part``; words are ended by line feeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def flush(number: dict[str, Numbering], found: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            for own, numbers in number.items():
                hashes = np.fromiter((word_hash(own, w) for w in numbers), np.uint64, len(numbers)).tobytes()
                row = [shard % rule.shards, own, b"\n".join(numbers), hashes, np.concatenate(found[own]).tobytes()]
                yield pa.RecordBatch.from_pydict({f.name: pa.array([v], f.type) for f, v in zip(schema, row, strict=True)}, schema=schema)
            shard += 1

        schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary())])
        number, found, size = {}, {}, 0
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own not in number:
                    number[own], found[own] = Numbering({BREAK: 0}), []
                words = words_of(body.as_py())
                found[own].append(number[own].of(words).astype(np.int32))
                size += len(words)
                if size > PART_WORDS:
                    yield from flush(number, found)
                    number, found, size = {}, {}, 0
        yield from flush(number, found)

    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return body.where("text IS NOT NULL").mapInArrow(run, PART)


def counted(part: Part, ripe_after: np.ndarray, step: int, rule: PhraseRule) -> Iterator[tuple[list, list, np.ndarray]]:
    """What a scan finds in one part: phrases, first scans and counts, length by length."""
    ids, h = part.ids, part.hashes
    if step < rule.shards:
        numbers = np.bincount(ids, minlength=len(part.words))
        # All words together stand under the empty phrase.
        yield [b"", *part.words[1:]], [0] * len(part.words), np.append(numbers[1:].sum(), numbers[1:])

    def ripe(h: np.ndarray) -> np.ndarray:
        one, two = slots_of(h, len(ripe_after))
        return np.maximum(ripe_after[one], ripe_after[two]).astype(np.int64)

    after = ripe(h)
    after[0] = NEVER
    # Places where a ripe phrase starts, and its number.
    places = np.flatnonzero(after[ids] < step)
    phrases = ids[places].astype(np.int64)
    for size in range(2, rule.longest + 1):
        both = np.flatnonzero(places[1:] == places[:-1] + 1)
        left, right = phrases[both], phrases[both + 1]
        start = np.maximum(after[left], after[right]) + 1
        useful = step < start + rule.shards
        if size < rule.longest:
            useful |= ripe(joined(h[left], h[right])) < step
        places, left, right = places[both[useful]], left[useful], right[useful]
        if not len(places):
            return
        pairs, first, phrases, numbers = np.unique(left << 32 | right, return_index=True, return_inverse=True, return_counts=True)
        left, right = left[first], right[first]
        start = np.maximum(after[left], after[right]) + 1
        h = joined(h[left], h[right])
        due = np.flatnonzero(step < start + rule.shards)
        if len(due):
            at = places[first[due]]
            spelt = [[part.words[i] for i in ids[at + j].tolist()] for j in range(size)]
            yield list(map(b" ".join, zip(*spelt, strict=True))), start[due].tolist(), numbers[due]
        # Slots may have been set by others before the phrase was counted at all.
        after = np.maximum(ripe(h), start)
        grown = after[phrases] < step
        places, phrases = places[grown], phrases[grown]


def scan(shard: DataFrame, ripe_after: np.ndarray, step: int, rule: PhraseRule) -> DataFrame:
    """Counts of all phrases under way in a shard, added up per part of a task: lang, phrase, start, n."""
    packed = zlib.compress(ripe_after.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ripe_after = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            for lang, words, hashes, ids in zip(*batch.columns, strict=True):
                part = Part(lang.as_py(), words.as_py().split(b"\n"), np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(ids.as_buffer(), np.int32))
                for phrases, start, n in counted(part, ripe_after, step, rule):
                    columns = [pa.array([part.lang] * len(n), pa.string()), pa.array(phrases, pa.binary()), pa.array(start, pa.int32()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "start", "n"])

    return shard.mapInArrow(run, "lang string, phrase binary, start int, n long")


def slots_set(ripe: DataFrame, rule: PhraseRule) -> np.ndarray:
    """Slots of some phrases. They come to the driver as bitmaps of at most ``slots`` / 8 bytes in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter(map(phrase_hash, batch.column(0).to_pylist(), batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots_of(h, rule.slots))) + 1)], names=["slot"])

    slots = ripe.select("lang", "phrase").mapInArrow(run, "slot long")
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = [np.zeros(0, np.int64)]
    for row in maps.collect():
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        out.append((row.bucket - 1) * len(bits) + np.flatnonzero(bits))
    return np.concatenate(out)


def phrase_counts(docs: DataFrame, rule: PhraseRule = PhraseRule(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, n for all phrases of 1 to ``longest`` words that occur ``least`` times within pieces of texts of
    a language, and an empty phrase with the number of all words of the language."""
    spark = docs.sparkSession
    home = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    in_shards(docs, rule, text, lang).write.partitionBy("shard").parquet(home)
    shards = spark.read.schema(PART).parquet(home)
    ripe_after = np.full(rule.slots, NEVER, np.uint8)
    state, step, last = None, 0, 0
    while step < rule.shards or step <= last + rule.shards:
        found = scan(shards.where(F.col("shard") == step % rule.shards).drop("shard"), ripe_after, step, rule).withColumn("before", F.lit(0).cast("long"))
        if state is not None:
            found = found.unionByName(state.select("lang", "phrase", "start", "n", F.col("n").alias("before")))
        sums = found.groupBy("lang", "phrase").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.sum("before").alias("before"))
        under_way = (F.col("n") >= rule.least) | (F.col("start") + rule.shards > step + 1) | (F.col("phrase") == F.lit(b""))
        ripe = (F.col("n") >= rule.least) & (F.col("before") < rule.least) & (F.col("phrase") != F.lit(b""))
        state = written(sums.where(under_way).withColumn("ripe", ripe).drop("before"))
        slots = slots_set(state.where("ripe").where(F.size(F.split(F.col("phrase").cast("string"), " ")) < rule.longest), rule)
        ripe_after[slots[ripe_after[slots] == NEVER]] = step
        last = step if len(slots) else last
        step += 1
    kept = state.where((F.col("n") >= rule.least) | (F.col("phrase") == F.lit(b"")))
    return kept.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def collocations(counts: DataFrame, longest: int = 5, top: int = 2000) -> DataFrame:
    """The ``top`` phrases per language of what ``phrase_counts`` found, by how much more often they occur than their
    two parts by chance: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut in two in all ways; the cut with the lowest score counts, the first of equal ones. Phrases inside
    a longer one that occurs as often are left out; it is enough to look at those longer by one word, since what lies
    between the two occurs as often as both. Products are decimals of 38 digits.
    """
    known = counts.where("phrase <> ''")
    phrases = known.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).where("size > 1")
    piece = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    inside = F.explode(F.array(piece(F.lit(1), F.col("size") - 1), piece(F.lit(2), F.col("size") - 1)))
    longer = phrases.where("size > 2").select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = phrases.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n").drop("longer")
    cuts = alone.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": piece(F.lit(1), F.col("k")), "right": piece(F.col("k") + 1, F.col("size") - F.col("k"))}).drop("words")
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    whole = counts.where("phrase = ''").select("lang", "n")
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(whole, "lang")
    score = F.expr("(1000BD * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("cut"))
    scored = worst.select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
