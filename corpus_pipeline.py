"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, with fewer rows or changed
texts; the last one adds the sampled pieces. Stages use the operators of ``tidelog.llm`` with the
parameters below. Extra columns pass through, whatever their names, but for those the last stage adds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import PART_BYTES, rows_of, rows_without, table, written
from tidelog.llm.decontaminate import WinnowRule, contamination
from tidelog.llm.fertility import QualityRules, quality_rules
from tidelog.llm.jaccard import JaccardRule, jaccard_components
from tidelog.llm.repeats import WindowRule, remove_repeats
from tidelog.llm.sampling import SamplingRule, sampled_pieces
from tidelog.plans.base import Registry
from tidelog.session import scratch_dir

NEAR_DUPLICATES = JaccardRule(width=5, num=80, den=100)
REPEATS = WindowRule(words=50)
LEAKS = WinnowRule(words=10, gram=5)
# Operators work on texts in parts of ``PART_BYTES``. An Arrow batch is closed by the row that passes its limit; this one leaves room for that row.
BATCH_BYTES = PART_BYTES * 7 // 8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with Arrow batches of about ``BATCH_BYTES``. By number of rows alone a batch of texts takes ten times that, which
    every task holds outside the heap, twice while a buffer grows, and once more in its Python worker."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def beside_text(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one: a text goes through Python once."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]


@in_small_batches
def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    packed = beside_text(docs).withColumn("lang", F.col("row.lang"))
    return quality_rules(packed, QualityRules(), key="row", with_text=True).where("kept").select(*unpacked(docs.columns))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component. Rows without an id stay; rows that
    are equal in id and text are one."""
    found = written(jaccard_components(docs, NEAR_DUPLICATES))
    extra = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = rows_without(docs, written(extra), "doc_id")
    again = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return rows_without(left, again, "doc_id").unionByName(rows_of(left, again, "doc_id").dropDuplicates(["doc_id", "text"]))


@in_small_batches
def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; those of which nothing is left go, others stay as they are."""
    cut = remove_repeats(beside_text(docs), REPEATS, key="row", as_is=True).where("n_words > n_removed")
    cut = cut.select("row", F.col("kept").cast("string").alias("text"))
    kept = cut.select(*unpacked(docs.columns))
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    name = f"row_{uuid.uuid4().hex}"
    known = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    hit = contamination(known, table(spark, sf_dir, "benchmark"), LEAKS, key=name).where("contaminated").select(name).distinct()
    return rows_without(known, written(hit), name).select(*docs.columns)


@in_small_batches
def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces. Own columns of the names of the new ones give way."""
    new = ["n_tokens", "token_ids", "lossless"]
    packed = beside_text(docs).withColumn("doc_id", F.col("row.doc_id"))
    found = sampled_pieces(packed, SamplingRule(), keep=["row"], with_text=True)
    return found.select(*unpacked([c for c in docs.columns if c not in new]), *new)


STAGES = [
    ("quality_rules", rule_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", repeat_stage),
    ("benchmark_decontamination", leak_stage),
    ("sentencepiece_encoding", piece_stage),
]
# Tokenizers and sampling are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    home = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs


REGISTRY = Registry()
REGISTRY.add("pipeline", ORACLE_SQL)(run)
