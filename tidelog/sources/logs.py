"""Log lines with their place in the file, in batch and follow mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value). Large files are split over tasks; ``block`` is the
    split's start in the file and ``row`` grows inside a split, so that ordering by
    both gives the file's line order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.trim("value").alias("value"),
    )


def follow_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines as files arrive; the query's checkpoint remembers what was read."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("seen_at"), F.trim("value").alias("value"))
        .where("value <> ''")
    )
