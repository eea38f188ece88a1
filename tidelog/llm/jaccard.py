"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

A row of the matrix is a document's set of word n-grams (64-bit hashes); its columns, the
hash space, are cut into blocks of equal width. Two documents link when
``den * |A & B| >= num * |A | B|``. Everything follows from that bound:

* A linked pair differs in at most ``D = (a + b) (den - num) / (den + num)`` columns, so of
  ``D + 1 + e`` blocks at least ``1 + e`` hold the same columns in both rows. Blocks are
  compared by one hash each. Pairs that share no block are below the bound and never
  formed. Unlike single n-grams, a block rarely consists of a common passage only.
* D depends on sizes: rows are grouped into spaces of sizes ``l .. l * (den / num) ** 2``, and
  rows that can reach into the next space take part there too.
* Rows with more than ``e`` empty blocks in a space also give the hashes of those. Two rows
  linked through empty blocks only are both of that kind, so no link is lost.
* A linked pair shares at least ``1 + e`` blocks less its empty ones, which lets most pairs that share
  a block by chance go unformed.
* Candidate pairs are multiplied block by block: overlap counts accumulate, and a pair
  goes as soon as what is left cannot reach ``num * (a + b) / (num + den)``.

Groups of copies. Equal rows are one class. In a block's bucket each row is first paired with
one pivot only, so that a bucket costs as many pairs as it has rows, and buckets are
pre-aggregated per batch of documents before the shuffle. Pairs that meet in one bucket only are
put off, as most of those are chance. What the pivots leave apart is then paired across
components: row by row in small buckets; in large ones through the columns in which rows differ from
the bucket's hub, since two rows that link without both linking to the hub share such differences. Components are
therefore those of all links, without forming all pairs of a group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import in_parts, rows_of, written
from tidelog.llm.graph import components
from tidelog.llm.words import EMPTY, MULTIPLIER, distinct, grams, mix, word_hashes

PRODUCT_BLOCKS = 8
PRODUCT_ENTRIES = 500_000
# Buckets of so many rows or fewer are paired row by row, larger ones around a hub.
SMALL_BUCKET = 8
BLOCK_SALT, CONTENT_SALT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class JaccardRule:
    """Documents link at a similarity of at least ``num / den`` of their sets of ``width``-word shingles."""

    width: int = 5
    num: int = 80
    den: int = 100
    lower: bool = True
    _starts: list[int] = field(default_factory=lambda: [1])
    _spaces: dict[int, tuple[int, int, np.ndarray]] = field(default_factory=dict)

    def row(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes; a text with fewer words is one shingle."""
        words = (text.lower() if self.lower else text).split() if text else []
        if not words:
            return EMPTY
        return distinct(grams(word_hashes(words), min(self.width, len(words))))

    def least_overlap(self, sizes: np.ndarray) -> np.ndarray:
        """Smallest overlap of a linked pair whose sizes add up to ``sizes``."""
        return -(-self.num * sizes // (self.num + self.den))

    def _space_of(self, n: int) -> int:
        while self._starts[-1] <= n:
            low = self._starts[-1]
            self._starts.append(low * self.den**2 // self.num**2 + 1)
        return bisect_right(self._starts, n) - 1

    def _space(self, c: int) -> tuple[int, int, np.ndarray]:
        """Differences allowed, empty blocks tolerated and first hashes of the blocks."""
        if c not in self._spaces:
            low, high = self._starts[c], self._starts[c + 1] - 1
            d = 2 * high * (self.den - self.num) // (self.den + self.num)
            smallest, e = max(1, low * self.num // self.den), 1
            for _ in range(4):
                k = d + 1 + e
                empty = k * np.exp(-smallest / k)
                e = int(max(1, min(np.ceil(empty + 5 * empty**0.5 + 3), (d + 1) // 3)))
            k = d + 1 + e
            self._spaces[c] = d, e, np.array([(i << 64) // k for i in range(k)], np.uint64)
        return self._spaces[c]

    def signatures(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One hash per block of each space the row takes part in, and the number of them
        that any linked row has too, at least."""
        n = len(row)
        if not n:
            return EMPTY, EMPTY
        c = self._space_of(n)
        reach = n * self.den // self.num
        self._space_of(reach)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(row ^ CONTENT_SALT), dtype=np.uint64)])
        out, need = [], []
        for space in (c, c + 1) if reach >= self._starts[c + 1] else (c,):
            self._space_of(self._starts[space + 1] if space + 1 < len(self._starts) else self._starts[-1])
            d, e, starts = self._space(space)
            if not d:
                continue  # only equal rows link, and those are one class
            edges = np.append(np.searchsorted(row, starts), n)
            content = sums[edges[1:]] - sums[edges[:-1]]
            number = np.arange(len(starts), dtype=np.uint64)
            hashes = mix(content * MULTIPLIER + (number + np.uint64(space << 32)) * BLOCK_SALT)
            filled = edges[1:] > edges[:-1]
            empty = len(starts) - int(filled.sum())
            out.append(hashes if empty > e else hashes[filled])
            need.append(np.full(len(out[-1]), 1 if empty > e else 1 + e - empty, np.uint64))
        return (np.concatenate(out), np.concatenate(need)) if out else (EMPTY, EMPTY)


def _fields(df: DataFrame, key: str, **more: str) -> T.StructType:
    fields = [T.StructField(key, df.schema[key].dataType)] if key else []
    return T.StructType(fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items()])


def row_keys(docs: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """(key, n_shingles, s1, s2): size and a 128-bit digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            n, s1, s2 = (np.zeros(batch.num_rows, np.uint64) for _ in range(3))
            for i, t in enumerate(batch.column(1).to_pylist()):
                row = rule.row(t)
                n[i], s1[i], s2[i] = len(row), row.sum(dtype=np.uint64), mix(row).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in (n, s1, s2))], names=[key, "n_shingles", "s1", "s2"])

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, _fields(docs, key, n_shingles="long", s1="long", s2="long"))


STAR = ["sig", "doc", "need", "pivot", "pivot_need"]


def _bucket_rows(docs: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """(sig, doc, need, pivot, pivot_need). Within a batch of documents each bucket has a pivot; only the
    pivot's row goes on to the shuffle, with ``pivot`` null. Copies in a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            parts, met = [], set()
            for t in batch.column(1).to_pylist():
                row = rule.row(t)
                digest = (len(row), int(row.sum(dtype=np.uint64)), int(mix(row).sum(dtype=np.uint64)))
                parts.append((EMPTY, EMPTY) if digest in met else rule.signatures(row))
                met.add(digest)
            if not parts:
                continue
            sig, need = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
            _, first, bucket = np.unique(sig, return_index=True, return_inverse=True)
            pivot, pivot_need = owner[first][bucket], need[first][bucket].astype(np.int32)
            is_first = np.zeros(len(sig), bool)
            is_first[first] = True
            for use in (is_first, ~is_first & (pivot != owner)):
                at = np.flatnonzero(use)
                pivots = pa.array(pivot[at], mask=is_first[at])
                for lo in range(0, len(at), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[at[some]].view(np.int64)), batch.column(0).take(pa.array(owner[at[some]])), pa.array(need[at[some]].astype(np.int32)), batch.column(0).take(pivots[some]), pa.array(pivot_need[at[some]])],
                        names=STAR,
                    )

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in zip(STAR, (T.LongType(), kind, T.IntegerType(), kind, T.IntegerType()), strict=True)])
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def _stars(rows: DataFrame) -> DataFrame:
    """The same columns: every row of a bucket that has others, with the bucket's pivot and what that one needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_pivot = last_need = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            known = table.filter(pa.compute.is_valid(table["pivot"]))
            yield from known.combine_chunks().to_batches()
            fresh = table.filter(pa.compute.is_null(table["pivot"])).combine_chunks()
            if not fresh.num_rows:
                continue
            sig = fresh["sig"].to_numpy()
            docs = fresh["doc"].combine_chunks()
            docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
            start = np.append(True, sig[1:] != sig[:-1])
            start[0] = sig[0] != last_sig
            # Position 0 stands for the pivot carried over from the batch before.
            at = np.maximum.accumulate(np.where(start, np.arange(1, len(sig) + 1), 0))
            pivots = pa.concat_arrays([pa.array([last_pivot], docs.type), docs]).take(pa.array(at))
            needs = pa.concat_arrays([pa.array([last_need], pa.int32()), pa.array(fresh["need"].to_numpy(), pa.int32())])
            pivot_needs = needs.take(pa.array(at))
            out = np.flatnonzero(~start)
            last_sig, last_pivot, last_need = sig[-1], pivots[-1].as_py(), pivot_needs[-1].as_py()
            some = pa.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), docs.take(some), needs.take(pa.array(out + 1)), pivots.take(some), pivot_needs.take(some)], names=STAR)

    schema = T.StructType([rows.schema[n] for n in STAR])
    route = F.when(F.col("pivot").isNull(), F.col("sig")).otherwise(F.xxhash64("doc"))
    return rows.repartition(route).sortWithinPartitions("sig", "doc").mapInArrow(run, schema).where("pivot <> doc")


def _set_rows(docs: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """(node, row): the sorted hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            rows = [rule.row(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "row"])

    schema = T.StructType([T.StructField("node", docs.schema[key].dataType), T.StructField("row", T.ArrayType(T.LongType()))])
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], rule: JaccardRule) -> np.ndarray:
    """Which pairs of rows link: products of column blocks accumulate, and pairs
    that can no longer reach their bound are left out of the blocks to come."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    need = rule.least_overlap(sizes.sum(axis=1))
    got = np.zeros(len(need), np.int64)
    live = np.flatnonzero(sizes.min(axis=1) >= need)
    starts = np.array([(i << 64) // PRODUCT_BLOCKS for i in range(1, PRODUCT_BLOCKS)], np.uint64)
    cut = lambda row: np.concatenate([[0], np.searchsorted(row, starts), [len(row)]])
    edges = {i: (cut(a[i]), cut(b[i])) for i in live}
    for block in range(PRODUCT_BLOCKS):
        if not len(live):
            break
        left = [a[i][edges[i][0][block] : edges[i][0][block + 1]] for i in live]
        right = [b[i][edges[i][1][block] : edges[i][1][block + 1]] for i in live]
        pair = np.repeat(np.tile(np.arange(len(live)), 2), [len(x) for x in left + right])
        column = np.concatenate(left + right)
        order = np.lexsort((column, pair))
        pair, column = pair[order], column[order]
        same = (pair[1:] == pair[:-1]) & (column[1:] == column[:-1])
        got[live] += np.bincount(pair[1:][same], minlength=len(live))
        rest = np.array([min(len(a[i]) - edges[i][0][block + 1], len(b[i]) - edges[i][1][block + 1]) for i in live])
        live = live[got[live] + rest >= need[live]]
    linked = np.zeros(len(need), bool)
    linked[live] = True
    return linked


def _paired_rows(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[np.ndarray], list[np.ndarray]]]:
    """Rows ``row_a`` and ``row_b`` of a batch, in slices of about ``PRODUCT_ENTRIES`` matrix entries, which bound the memory."""
    rows = []
    for name in ("row_a", "row_b"):
        col = batch.column(batch.schema.get_field_index(name))
        flat, off = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
        rows.append([flat[off[i] : off[i + 1]] for i in range(len(col))])
    entries = np.cumsum([len(x) + len(y) for x, y in zip(*rows, strict=True)]) // PRODUCT_ENTRIES
    for lo, hi in pairwise([*np.unique(entries, return_index=True)[1], len(entries)]):
        yield slice(lo, hi), rows[0][lo:hi], rows[1][lo:hi]


def _with_rows(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their matrix rows."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("row").alias("row_b")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("row").alias("row_a")), "a")
    return joined.select("a", "b", "row_a", "row_b")


def _multiply(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """Those of ``pairs`` (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.concatenate([overlaps(a, b, rule) for _, a, b in _paired_rows(batch)] or [np.zeros(0, bool)])
            linked = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(linked), batch.column(1).take(linked)], names=["a", "b"])

    return _with_rows(pairs, sets).mapInArrow(run, pairs.select("a", "b").schema)


def _differences(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """(hub, node, size, linked, own, lacking): the columns that only ``node`` (b) has, and those that only its ``hub`` (a) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hubs, rows in _paired_rows(batch):
                own, lacking = ([np.setdiff1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sides, strict=True)] for sides in ((rows, hubs), (hubs, rows)))
                columns = [pa.array([len(y) for y in rows], pa.int64()), pa.array(overlaps(hubs, rows, rule)), pa.array(own, pa.list_(pa.int64())), pa.array(lacking, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], *columns], names=["hub", "node", "size", "linked", "own", "lacking"])

    kind, columns = pairs.schema["a"].dataType, T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("hub", kind), T.StructField("node", kind), T.StructField("size", T.LongType()), T.StructField("linked", T.BooleanType()), T.StructField("own", columns), T.StructField("lacking", columns)])
    return _with_rows(pairs, sets).mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, rule: JaccardRule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    ``component_id`` is the smallest key reachable by links, the row's own included. Texts
    without words (or null) have no shingles, link with nothing and keep their own key.
    Rows with a null key take no part in links; their component is null. Rows that share a key
    are told apart by their text. Hashes are of 64 bits, digests of classes of 128.
    """
    keys = written(row_keys(docs, rule, key, text))
    digest = ["n_shingles", "s1", "s2"]
    usable = docs.where(F.col(key).isNotNull())
    classes = keys.where((F.col("n_shingles") > 0) & F.col(key).isNotNull()).groupBy(*digest).agg(F.min(key).alias("node"))
    classes = written(classes)
    members = written(keys.join(classes, digest).select(F.col(key).alias("doc"), "node", "n_shingles"))

    def in_classes(pairs: DataFrame) -> DataFrame:
        """Pairs (pivot, doc, often) as pairs of classes; ``often``: they met in two buckets, or one is all a link needs."""
        a = members.select(F.col("doc").alias("pivot"), F.col("node").alias("a"))
        b = members.select("doc", F.col("node").alias("b"))
        found = pairs.join(a, "pivot").join(b, "doc").where("a <> b")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "often").groupBy("a", "b").agg(F.max("often").alias("often"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
        return _set_rows(rows_of(docs, ids, key), rule, key, text)

    def verified(pairs: DataFrame) -> DataFrame:
        return _multiply(pairs, sets_of(pairs), rule)

    stars = written(_stars(_bucket_rows(usable, rule, key, text)))
    often = (F.count(F.lit(1)) > 1) | (F.min("need") < 2)
    pairs = written(in_classes(stars.groupBy("pivot", "doc").agg(often.alias("often"))))
    links = written(verified(pairs.where("often").select("a", "b")))
    parts = written(components(links))

    # Buckets in which a pair of different components is left.
    def component_of(node: str, name: str) -> DataFrame:
        return parts.select(F.col("node").alias(node), F.col("component").alias(name))

    apart = pairs.join(component_of("a", "ca"), "a", "left").join(component_of("b", "cb"), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    nodes = written(apart.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    mixed = _mixed_buckets(stars, members, nodes, parts)
    spokes = written(mixed.where((F.col("rows") > SMALL_BUCKET) & (F.col("hub") != F.col("node"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    rest = _within(mixed.where(F.col("rows") <= SMALL_BUCKET), rule)
    if not spokes.isEmpty():
        apart = written(_differences(spokes, sets_of(spokes), rule))
        links = links.unionByName(apart.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rest = rest.unionByName(_around_hubs(apart, parts, rule))
    more = written(rest.distinct().join(pairs.where("often"), ["a", "b"], "left_anti"))
    links = written(links.unionByName(verified(more)))
    parts = written(components(links))

    named = classes.join(parts, "node", "left").select(*digest, F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col(key))
    out = keys.join(written(named), digest, "left")
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", own)).alias("component_id"))


def _mixed_buckets(stars: DataFrame, members: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(sig, node, n_shingles, c, rows, hub): the classes of buckets that hold several components ``c``.

    A row that needs ``r`` shared buckets out of its ``m`` stays in its ``m - r + 1`` smallest ones only: two rows that
    share enough meet there (prefix filter), and the large buckets of common passages are left out. ``rows`` counts what stays.
    A bucket's ``hub`` is the class whose buckets are largest in sum, that is, the one with most in common with others. Where
    most of that class's buckets have another hub, it is that one, so that a group of near copies has few of them.
    """
    suspects = members.join(nodes, "node", "left_semi").select("doc")
    touched = stars.join(suspects, "doc", "left_semi").select("sig")
    touched = touched.unionByName(stars.join(suspects.withColumnRenamed("doc", "pivot"), "pivot", "left_semi").select("sig")).distinct()
    inside = stars.join(touched, "sig", "left_semi")
    pivots = inside.select("sig", F.col("pivot").alias("doc"), F.col("pivot_need").alias("need"))
    inside = inside.select("sig", "doc", "need").unionByName(pivots)
    inside = inside.join(members, "doc").join(parts, "node", "left").withColumn("c", F.coalesce("component", "node"))
    inside = written(inside.groupBy("sig", "node", "n_shingles", "c").agg(F.max("need").alias("need")))
    buckets = inside.groupBy("sig").agg(F.count(F.lit(1)).alias("all"), F.min("c").alias("lowest"), F.max("c").alias("highest"))
    # The blocks of one document are one window.
    own = Window.partitionBy("node")
    ranked = inside.join(buckets, "sig").withColumns({
        "m": F.count(F.lit(1)).over(own),
        "least": F.min("need").over(own),
        "at": F.row_number().over(own.orderBy("all", "sig")),
        "weight": F.sum("all").over(own),
    })
    ranked = written(ranked.where("lowest < highest").select("sig", "node", "n_shingles", "c", "weight", (F.col("at") <= F.col("m") - F.col("least") + 1).alias("stays")))
    shape = ranked.groupBy("sig").agg(F.count_if("stays").alias("rows"), F.max(F.struct("weight", "node")).alias("top"))
    shape = written(shape.select("sig", "rows", F.col("top.node").alias("first"), "top.weight"))
    ways = shape.select("sig", F.col("first").alias("hub"), "weight").join(ranked.select("sig", F.col("node").alias("first")), "sig")
    ways = ways.join(shape.select("first").distinct(), "first", "left_semi").groupBy("first", "hub").agg(F.count(F.lit(1)).alias("times"), F.max("weight").alias("weight"))
    hubs = ways.groupBy("first").agg(F.max(F.struct("times", "weight", "hub"))["hub"].alias("hub"))
    shape = shape.join(hubs, "first").select("sig", "rows", "hub")
    return written(ranked.where("stays").select("sig", "node", "n_shingles", "c").join(shape.where("rows > 1"), "sig"))


def _fits(rule: JaccardRule, a: str, b: str) -> Column:
    return F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num


def _within(buckets: DataFrame, rule: JaccardRule) -> DataFrame:
    """Pairs (a, b) of different components in one bucket, of sizes that allow a link. For buckets of bounded size."""
    left = buckets.select("sig", F.col("node").alias("a"), "n_shingles", "c")
    right = buckets.select("sig", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("c").alias("c_b"))
    met = left.join(right, "sig").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("c_b")) & _fits(rule, "n_shingles", "n_b"))
    return met.select("a", "b").distinct()


def _ranked(rows: DataFrame) -> DataFrame:
    """The ``columns`` of ``rows`` as a row each, with their number ``d`` and place ``at`` by rarity around the hub.

    A pair has a row that is ``odd``, so other columns, and those of one row only, meet nothing. They come first: they
    count in the places, but are not given. Hubs without odd rows are left out.
    """
    hubs = rows.where("odd").select("hub").distinct()
    cells = rows.join(hubs, "hub", "left_semi").withColumn("d", F.size("columns")).withColumn("column", F.explode("columns")).drop("columns")
    common = cells.groupBy("hub", "column").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("some"))
    common = common.where("n > 1 AND some > 0").drop("some")
    own = Window.partitionBy("hub", "node")
    at = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "column"))
    return cells.join(common, ["hub", "column"]).withColumn("at", at).drop("n")


def _may_meet(rows: DataFrame, reach: Column) -> DataFrame:
    """Those of ``rows`` that share a column of their first ``reach`` ones, in the order of hashes, with another, one of the two being odd.

    That needs no counts, so only the first columns become rows of a table; all columns of what is left are then put in order of rarity.
    """
    hubs = rows.where("odd").select("hub").distinct()
    first = rows.join(hubs, "hub", "left_semi").select("hub", "node", "odd", F.explode(F.slice("columns", F.lit(1), reach.cast("int"))).alias("column"))
    first = written(first)
    common = first.groupBy("hub", "column").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("some")).where("n > 1 AND some > 0")
    return rows.join(written(first.join(common, ["hub", "column"], "left_semi").select("hub", "node").distinct()), ["hub", "node"], "left_semi")


def _met(left: DataFrame, right: DataFrame, shared: Column, rule: JaccardRule) -> DataFrame:
    """Pairs (a, b) of an odd row and any other of ``_ranked`` that have the same column among those that may be the rarest of ``shared`` ones."""
    right = right.select("hub", "column", *[F.col(n).alias(f"{n}_b") for n in ("node", "size", "c", "odd", "d", "at")])
    once = ~F.col("odd_b") | (F.col("node") < F.col("node_b"))
    early = F.greatest(F.col("at") - F.col("d"), F.col("at_b") - F.col("d_b")) <= 1 - shared
    met = left.where("odd").join(right, ["hub", "column"]).where((F.col("c") != F.col("c_b")) & once & early & _fits(rule, "size", "size_b"))
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))


def _around_hubs(apart: DataFrame, parts: DataFrame, rule: JaccardRule) -> DataFrame:
    """Pairs (a, b) around one hub that may link although one of them does not link to the hub.

    A row ``w`` of a linked pair has at most ``S = |w| (den - num) / den`` columns that the other lacks. Where ``w`` has more columns
    than that beside its hub's, it is *far*: it does not link to the hub, and any row it links with shares all but ``S`` of those.
    So far rows meet others in columns beside the hub's alone, in the first ``S + 1`` of either row by any order, of hashes or of rarity.
    The hub's columns that rows lack, most of them the same ones around a common passage, are not looked at.

    Other pairs are of rows that are not far. Let ``v`` and ``w`` differ from their hub in the column sets V and W. They differ from each other in
    ``|V| + |W| - 2 |V & W|`` columns. If V and W are disjoint and ``v`` and ``w`` link, both link to the hub, for
    ``|v| - |hub| <= |V|``. So where ``w`` does not, V and W meet, in more than ``|V| num / (num + den)`` columns.
    As ``v`` and ``w`` differ in at most ``D = |w| (den - num) / num``, they also meet in ``|W| - D`` and in ``(|W| + 1 - D) / 2``.
    Sets that meet in ``k`` columns meet in the rarest ``|V| - k + 1`` and ``|W| - k + 1``.

    These bounds choose the columns to join by; once both sizes are known, the exact ``k`` is held against the places of the
    column met. Around a hub, the rare columns are a copy's own; edits apart from each other give no pair.
    """
    part = lambda n, d: F.floor(n * (rule.den - rule.num) / F.lit(d))
    both = F.col("size") + F.col("size_b")
    rows = apart.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node"))
    rows = rows.withColumn("far", F.size("own") > part(F.col("size"), rule.den))

    reach = part(F.col("size"), rule.den) + 1
    beside = rows.select("hub", "node", "size", "c", F.col("far").alias("odd"), F.col("own").alias("columns"))
    beside = written(_ranked(_may_meet(beside, reach)).where(F.col("at") <= reach))
    overlap = F.ceil(both * rule.num / F.lit(rule.num + rule.den))
    shared = F.greatest(overlap - F.least(F.col("size") - F.col("d"), F.col("size_b") - F.col("d_b")), F.lit(1))
    met = _met(beside, beside, shared, rule)

    close = rows.where("not far").select("hub", "node", "size", "c", (~F.col("linked")).alias("odd"), F.concat("own", "lacking").alias("columns"))
    most = part(F.col("size"), rule.num)
    least = F.greatest(F.ceil((F.col("d") + 1 - most) / 2), F.col("d") - most, F.lit(1))
    ranked = _ranked(close).withColumns({"near": F.col("d") - F.floor(F.col("d") * rule.num / F.lit(rule.num + rule.den)), "last": F.col("d") - least + 1})
    ranked = written(ranked.where(F.col("at") <= F.greatest("near", "last")))
    shared = F.ceil((F.col("d") + F.col("d_b") - part(both, rule.num + rule.den)) / 2)
    return met.unionByName(_met(ranked, ranked.where("at <= near"), shared, rule)).distinct()
