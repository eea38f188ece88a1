"""Shared inputs of the plans and a registry of (Spark plan, SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.cdc import with_cdc_columns

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(plan: Plan) -> Plan:
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` read as a change log per user (``events``: a stream of them)."""
    operation = (
        F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    )
    rows = events if events is not None else table(spark, sf_dir, "events")
    raw = rows.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("k"),
        operation.alias("op_name"),
        F.col("ts").alias("commit_ts"),
        "value",
        "props",
        "event_type",
    )
    return with_cdc_columns(raw)


# The same change log in SQL; every statement that uses it starts with this.
LOG_SQL = """WITH log AS (
  SELECT event_id AS seq, user_id AS k, ts AS op_ts,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op_type,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_deleted,
         value, props, event_type
  FROM events)
"""
