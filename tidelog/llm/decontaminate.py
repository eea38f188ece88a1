"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint of a text is the smallest hash of ``gram`` consecutive words in a sliding
window of ``words - gram + 1`` of them (Schleimer, Wilkerson and Aiken, Winnowing, 2003). Texts
that share ``words`` consecutive words share a fingerprint, so the join of both
sides' fingerprints finds every document to look into. There each common run of ``gram``
words is extended word by word to both sides, and counts if it reaches ``words``.
Items of fewer words are compared as a whole.

The benchmark's fingerprints are broadcast if they are few enough (counted first); the rest of it is joined
without a hint. Texts of documents are never shuffled for the search; only those that share a fingerprint are
read again for the extension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_IDS, rows_of, written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Everything but digits, letters and characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class WinnowRule:
    """Spans of at least ``words`` words count, found through runs of ``gram`` words."""

    words: int = 10
    gram: int = 5

    @property
    def span(self) -> int:
        return self.words - self.gram + 1


def content_words(text: str) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    parts = F.split(F.translate(F.col(text), LETTERS, LETTERS.lower()), SEPARATORS)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def _paired(left: str, right: str, ahead: int, join) -> Column:
    """``join`` of each element of one array with that ``ahead`` places further on in the other."""
    n = F.size(right) - ahead
    both = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(ahead + 1), n), join)
    return F.when(n > 0, both).otherwise(F.array().cast("array<bigint>"))


def _hashed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _with_grams(df: DataFrame, widths: list[int]) -> DataFrame:
    """Add ``g<width>``: hashes of all runs of so many words. A word is hashed once; runs of doubled width are joined.
    Each step is a column of its own, so that it is computed once per row."""
    df, run = df.withColumn("__r1", F.transform("words", lambda w: F.xxhash64(w))), 1
    while 2 * run <= max(widths):
        df = df.withColumn(f"__r{2 * run}", _paired(f"__r{run}", f"__r{run}", run, _hashed))
        run *= 2
    for width in widths:
        parts = [1 << b for b in range(width.bit_length()) if width >> b & 1]
        name, size = f"__r{parts[-1]}", parts[-1]
        for part in reversed(parts[:-1]):
            df = df.withColumn(f"__w{width}_{size + part}", _paired(name, f"__r{part}", size, _hashed))
            name, size = f"__w{width}_{size + part}", size + part
        df = df.withColumn(f"g{width}", F.col(name))
    return df.drop(*[c for c in df.columns if c.startswith(("__r", "__w"))])


def _with_fingerprints(df: DataFrame, grams: str, span: int) -> DataFrame:
    """Add ``prints``: the smallest hash of each window of ``span`` hashes, once each; windows of doubled width first."""
    name, size = grams, 1
    while 2 * size <= span:
        df = df.withColumn(f"__m{2 * size}", _paired(name, name, size, _smaller))
        name, size = f"__m{2 * size}", 2 * size
    if size < span:
        df = df.withColumn("__m", _paired(name, name, span - size, _smaller))
        name = "__m"
    df = df.withColumn("prints", F.array_distinct(name))
    return df.drop(*[c for c in df.columns if c.startswith("__m")])


def _row_id(key: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), F.col(text))


def _spans(docs: DataFrame, items: DataFrame, rule: WinnowRule) -> DataFrame:
    """(row, start, n, item) of common runs of long items, in documents (row, words)."""
    side, width = rule.words - rule.gram, rule.gram

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        around = F.transform(
            F.sequence(F.lit(0), F.size("words") - width),
            lambda i: F.struct(
                F.get(f"g{width}", i).alias("hash"),
                F.slice("words", i + 1, width).alias("gram"),
                F.reverse(F.slice("words", F.greatest(i - side, F.lit(0)) + 1, F.least(i, F.lit(side)))).alias("before"),
                F.slice("words", i + width + 1, side).alias("after"),
            ),
        )
        rows = _with_grams(df.where(F.size("words") >= width), [width]).select(*columns, F.posexplode(around).alias("at", "run"))
        return rows.select(*columns, "at", "run.*")

    ours = placed(docs, "row")
    theirs = placed(items.where(F.size("words") >= rule.words), "item", "prints").where(F.array_contains("prints", F.col("hash")))
    theirs = theirs.select("item", "hash", *[F.col(n).alias(f"item_{n}") for n in ("gram", "before", "after")])

    def agreed(a: str, b: str) -> Column:
        """Number of words from the start on which two arrays agree."""
        differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")

    joined = ours.join(theirs, "hash").where(F.col("gram") == F.col("item_gram"))
    joined = joined.withColumns({"left": agreed("before", "item_before"), "right": agreed("after", "item_after")})
    span = joined.select("row", (F.col("at") - F.col("left")).alias("start"), (F.col("left") + F.col("right") + width).alias("n"), "item")
    return span.where(F.col("n") >= rule.words)


def contamination(
    docs: DataFrame, benchmark: DataFrame, rule: WinnowRule = WinnowRule(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, item_list, contaminated.

    ``n_hit`` counts the words inside a common run, ``item_list`` has the ids of its items as
    sorted strings. Null and empty texts have no words and no hits; items without words or id are
    left out, items of one id are one. Equal rows get equal results. Rows are known by a 64-bit hash of key and text.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), content_words(item_text).alias("words"))
    items = items.where(F.col("item").isNotNull() & (F.size("words") > 0)).distinct()
    items = _with_fingerprints(_with_grams(items, list(range(1, rule.words))), f"g{rule.gram}", rule.span)
    whole = F.coalesce(*[F.when(F.size("words") == m, F.col(f"g{m}")) for m in range(1, rule.words)], F.col("prints"))
    items = written(items.select("item", "words", whole.alias("prints")))
    # At most ``rule.words - 1`` numbers.
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < rule.words).distinct().collect())

    # One pass over the texts: each row's number of words, and those of its fingerprints that the benchmark has.
    texts = docs.select(F.col(key).alias("key"), _row_id(key, text).alias("row"), F.col(text).alias("text"))
    parts = _with_grams(texts.select("key", "row", content_words("text").alias("words")), sorted({rule.gram, *short}))
    parts = _with_fingerprints(parts, f"g{rule.gram}", rule.span)
    # The last of the prints stands for the row itself: its hash, so that no task gets these of all rows.
    parts = parts.withColumn("prints", F.concat("prints", *[F.col(f"g{m}") for m in short], F.array("row")))
    known = written(items.select(F.explode("prints").alias("print")).distinct().withColumn("known", F.lit(True)))
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    each = parts.select("key", "row", F.size("words").cast("long").alias("n_words"), F.size("prints").alias("n"), F.posexplode_outer("prints").alias("at", "print"))
    seen = each.withColumn("whole", F.col("at") == F.col("n") - 1).drop("at", "n").join(known, "print", "left")
    seen = written(seen.where("known OR whole").select("key", "row", "n_words", "whole"))
    rows = seen.where("whole").drop("whole")
    met = written(seen.where("NOT whole").select("row").distinct())
    suspects = rows_of(texts, met, "row").select("row", content_words("text").alias("words"))

    found = _spans(suspects, items, rule)
    for m in short:
        runs = F.transform(F.sequence(F.lit(0), F.size("words") - m), lambda i: F.slice("words", i + 1, m))  # noqa: B023
        ours = suspects.where(F.size("words") >= m).select("row", F.posexplode(runs).alias("start", "run"))
        theirs = items.where(F.size("words") == m).select("item", F.col("words").alias("run"))
        found = found.unionByName(ours.join(theirs, "run").select("row", "start", F.lit(m).alias("n"), "item"))
    found = written(found.distinct())
    covered = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    covered = covered.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_list"))
    hits = covered.join(named, "row")
    out = rows.join(hits, "row", "left")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_list"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_list", F.array().cast("array<string>")).alias("item_list"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
