"""Columns every change record carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CDC_COLUMNS = ("op_type", "op_ts", "is_deleted")


def op_type(op_name: Column) -> Column:
    """First character of the operation name (INSERT, UPDATE, DELETE, ...)."""
    return F.substring(op_name, 1, 1)


def is_deleted(op: Column) -> Column:
    """1 for a delete; every other code, known or not, is 0."""
    return F.when(op == "D", 1).otherwise(0)


def with_cdc_columns(df: DataFrame, op_name: str = "op_name", commit_ts: str = "commit_ts") -> DataFrame:
    """Replace the raw operation name and commit time by the three CDC columns."""
    return (
        df.withColumn("op_type", op_type(F.col(op_name)))
        .withColumn("op_ts", F.col(commit_ts))
        .withColumn("is_deleted", is_deleted(F.col("op_type")))
        .drop(*({op_name, commit_ts} - set(CDC_COLUMNS)))
    )
