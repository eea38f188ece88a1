"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its site.

* Document classifier: naive Bayes over the presence of hashed words, learnt from one half of the
  labelled rows. Its mean log odds fall into fixed bins; labelled rows of the other half say how much
  more often good than bad documents fall into a bin. That ratio is the document's evidence.
* Host: share of good labels, a beta posterior around the global share. The prior's weight comes
  from the spread of hosts (method of moments), so sites with few labels shrink to the global share.
* Path: in the same way around its host's posterior mean.

Document's odds = its path's odds x its evidence; a labelled document's own label is left out of its
site's counts. Everything gathered is of fixed size: word buckets and bins. Sites are grouped
sums that are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_IDS, in_parts, written
from tidelog.llm.words import distinct, word_hashes

BUCKETS = 1 << 15
BINS, WIDTH = 40, 0.05  # bins of the mean log odds, around 0


@dataclass(frozen=True)
class SiteRule:
    """``threshold``: kept with at least this probability of being good. ``smooth``: added to word and bin counts.
    ``least_weight`` and ``most_weight`` bound the prior's weight in labels."""

    threshold: float = 0.5
    smooth: float = 1.0
    least_weight: float = 2.0
    most_weight: float = 1000.0


def word_buckets(text: bytes | None) -> np.ndarray:
    """Distinct buckets of a text's words and of their last three bytes, as endings carry marks."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    whole, end = word_hashes(words), word_hashes([w[-3:] for w in words])
    return distinct(np.concatenate([whole, end * np.uint64(3)]) % np.uint64(BUCKETS)).astype(np.int64)


def _learn(rows: DataFrame, rule: SiteRule) -> np.ndarray:
    """Log odds of good per bucket from rows (text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in in_parts(batches, 0):
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[good, word_buckets(text)] += 1
                count[good, BUCKETS] += 1
        good, bucket = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64()), pa.array(bucket, pa.int64()), pa.array(count[good, bucket])], names=["good", "bucket", "n"])

    sums = rows.select(F.col("text").cast("binary"), F.col("good").cast("int")).mapInArrow(run, "good long, bucket long, n long")
    found = sums.groupBy("good", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 (BUCKETS + 1) rows
    count = np.zeros((2, BUCKETS + 1))
    count[found["good"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    share = (count[:, :-1] + rule.smooth) / (count[:, -1:] + 2 * rule.smooth)
    return np.log(share[1] / share[0])


def _scored(docs: DataFrame, odds: np.ndarray, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` and the bin of the mean log odds; no words: the middle bin."""
    spread = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = spread.value
        for batch in in_parts(batches, len(keep)):
            buckets = [word_buckets(t) for t in batch.column(len(keep)).to_pylist()]
            mean = np.array([weights[b].mean() if len(b) else 0.0 for b in buckets])
            bins = np.clip(np.floor(mean / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins)], names=[*keep, "bin"])

    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col(text).cast("binary")).mapInArrow(run, ", ".join([*types, "bin int"]))


def prior_weight(sites: float, rule: SiteRule, share: float, sums: tuple[float, float, float]) -> float:
    """Weight of a beta prior by the method of moments, from sums over sites of n, n squared and
    n (site share - global share) squared."""
    n, n2, spread = sums
    noise = share * (1 - share)
    if sites < 2 or noise <= 0 or n * n <= n2:
        return rule.most_weight
    between = (spread - (sites - 1) * noise) / (n - n2 / n)
    if between <= 0:
        return rule.most_weight
    return float(np.clip(noise / between - 1, rule.least_weight, rule.most_weight))


def _moments(sites: DataFrame, share: Column) -> tuple[float, tuple[float, float, float]]:
    n = F.col("known").cast("double")
    row = sites.where("known > 0").agg(
        F.count(F.lit(1)).alias("sites"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(n * (F.col("good_n") / n - share) ** 2).alias("spread")
    ).first()
    return float(row.sites), (row.n or 0.0, row.n2 or 0.0, row.spread or 0.0)


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, rule: SiteRule = SiteRule(), key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: key, evidence (log odds), host_mean, path_mean, p_quality, kept.

    ``labels`` (key, label: 1 good, 0 bad); nulls are no labels, of several for one key the lowest counts. Null
    hosts and paths are sites like others. Texts without words have the middle bin's evidence. Without labels
    every document has p_quality 0.5. Rows with a null key have no label.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("int")).alias("good"))
    known = written(known)
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    rows = docs.select(F.col(key), F.col(text).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path")).join(known, key, "left")
    half = F.pmod(F.xxhash64(F.col(key)), F.lit(2))
    odds = _learn(rows.where(F.col("good").isNotNull() & (half == 0)), rule)
    scored = written(_scored(rows, odds, [key, "host", "path", "good"], "text"))

    labelled = scored.where("good IS NOT NULL")
    found = np.zeros((2, BINS))
    for r in labelled.where(half == 1).groupBy("good", "bin").count().collect():  # at most 2 BINS rows
        found[r["good"], r["bin"]] = r["count"]
    share = (found + rule.smooth) / (found.sum(axis=1, keepdims=True) + BINS * rule.smooth)
    ratio = np.log(share[1] / share[0])
    evidence = F.element_at(F.array(*[F.lit(float(x)) for x in ratio]), F.col("bin") + 1)

    sums = [F.count("good").alias("known"), F.coalesce(F.sum("good"), F.lit(0)).alias("good_n")]
    top = labelled.agg(F.count("good").alias("n"), F.sum("good").alias("good")).first()
    overall = (top.good + 1) / (top.n + 2) if top.n else 0.5
    paths = written(scored.groupBy("host", "path").agg(*sums))
    hosts = written(paths.groupBy("host").agg(F.sum("known").alias("known"), F.sum("good_n").alias("good_n")))
    sites, moments = _moments(hosts, F.lit(overall))
    host_weight = prior_weight(sites, rule, overall, moments)

    def mean(good: Column, n: Column, centre: Column, weight: float) -> Column:
        return (good + weight * centre) / (n + weight)

    host_mean = mean(F.col("host_good"), F.col("host_known"), F.lit(overall), host_weight)
    above = hosts.select("host", F.col("known").alias("host_known"), F.col("good_n").alias("host_good"))
    same_host = F.col("host").eqNullSafe(F.col("host_"))
    joined = paths.join(above.withColumnRenamed("host", "host_"), same_host).drop("host_")
    sites, moments = _moments(joined.withColumn("m", host_mean), F.col("m"))
    path_weight = prior_weight(sites, rule, overall, moments)

    joined = written(joined).withColumnsRenamed({"host": "host_", "path": "path_"})
    out = scored.join(joined, same_host & F.col("path").eqNullSafe(F.col("path_")))
    own, own_good = F.col("good").isNotNull().cast("int"), F.coalesce("good", F.lit(0))
    out = out.withColumn("host_mean", mean(F.col("host_good") - own_good, F.col("host_known") - own, F.lit(overall), host_weight))
    out = out.withColumn("path_mean", mean(F.col("good_n") - own_good, F.col("known") - own, F.col("host_mean"), path_weight))
    out = out.withColumn("evidence", evidence)
    logit = F.log(F.col("path_mean") / (1 - F.col("path_mean"))) + F.col("evidence")
    p = 1 / (1 + F.exp(-logit))
    return out.select(key, "evidence", "host_mean", "path_mean", p.alias("p_quality"), (p >= rule.threshold).alias("kept"))
