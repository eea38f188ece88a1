"""The append-only change log as a table with any number of independent readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def follow_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000, **options) -> DataFrame:
    """Stream over the log in bounded batches. Each query that reads it keeps its own
    checkpoint, so consumers neither see nor delay each other."""
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).parquet(path)
