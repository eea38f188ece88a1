"""Shared helpers: tables, intermediate results, joins by id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import scratch_dir

# Texts are worked on in parts of about so many bytes, which bounds the memory of a Python worker.
PART_BYTES = 4 << 20
# Lists of ids up to this many rows are broadcast (about 64 MB as a hashed relation); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: its lineage ends there,
    so a lost executor costs no recomputation of earlier steps."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (a written table of distinct ids).

    A list of proven size is broadcast, so that texts stay where they are; beyond it
    both sides are shuffled.
    """
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, "left_semi")


def rows_without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids`` (as for ``rows_of``); null keys stay."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, "left_anti")


def in_parts(batches: Iterator[pa.RecordBatch], column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts (in ``column``) come to about ``size`` bytes, or one text."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.column(column).nbytes))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)
        pa.default_memory_pool().release_unused()
