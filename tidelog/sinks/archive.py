"""Archiving of old rows, once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def due_for_archive(rows: DataFrame, manifest: DataFrame, keys: list[str], ts: str, cutoff: Column) -> DataFrame:
    """Rows older than the cutoff whose key the manifest does not list yet."""
    return rows.where(F.col(ts) < cutoff).join(manifest.select(*keys), keys, "left_anti")


def archive(rows: DataFrame, manifest_path: str, archive_path: str, keys: list[str], ts: str, cutoff: Column, run_id: str) -> DataFrame:
    """Append due rows to the archive, then list their keys in the manifest.

    The source is not touched. Rows and manifest entries go to a folder per run,
    so repeating a run, whether it failed half-way or succeeded, replaces its own output only: what
    the run itself has listed counts as not yet archived.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], rows.select(*keys).schema)
    try:
        schema = StructType([*empty.schema.fields, StructField("run", StringType())])
        listed = spark.read.schema(schema).parquet(manifest_path).where(F.col("run") != run_id)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing archived so far.
        listed = empty
    due = due_for_archive(rows, listed, keys, ts, cutoff)
    target = f"{archive_path}/run={run_id}"
    due.write.mode("overwrite").parquet(target)
    done = spark.read.schema(rows.schema).parquet(target)
    done.select(*keys).distinct().write.mode("overwrite").parquet(f"{manifest_path}/run={run_id}")
    return done
