"""Appending changes, routing them to targets, and setting bad ones aside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.changelog import drop_payload, mask_payload
from tidelog.operators.routes import WAREHOUSE


def append_changes(log: DataFrame, path: str, partition_by: tuple[str, ...] = ("op_date",)) -> None:
    """Append-all: inserts, updates and deletes are all new rows.

    The rebalance hint gathers each partition's rows into few files and lets AQE
    split partitions that hold too much for one task.
    """
    dated = log.withColumn("op_date", F.to_date("op_ts")) if "op_date" in partition_by else log
    dated.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def exclude_for_target(routed: DataFrame, payload: str = "payload", excluded: str = "excluded_columns") -> DataFrame:
    """Hide excluded payload entries: nulled for the warehouse, gone for the mirror."""
    nulled, dropped = (f(F.col(payload), F.col(excluded)) for f in (mask_payload, drop_payload))
    return routed.withColumn(payload, F.when(F.col("target") == WAREHOUSE, nulled).otherwise(dropped))


def write_routed(routed: DataFrame, path: str) -> None:
    """One folder per target, target schema and table."""
    by = ["target", "target_schema", "table_name"]
    routed.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)


def split_valid(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): the first failing check names the reason."""
    reason = F
    for text, ok in checks.items():
        reason = reason.when(~F.coalesce(ok, F.lit(False)), text)
    marked = rows.withColumn("reason", reason.otherwise(F.lit(None)))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def discard(rejected: DataFrame, path: str) -> None:
    rejected.withColumn("rejected_at", F.current_timestamp()).write.mode("append").parquet(path)
