"""Retry and escalation of failing processes, and the quarantine that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.status import backoff_seconds
from tidelog.operators.ordered import OrderedRows, SkewGuard

# Retries before a person is called, first delay and its limit.
MAX_RETRIES, BASE_SECONDS, MAX_SECONDS = 5, 30.0, 240.0


def retry_columns(failures_in_row: Column, max_retries: int = MAX_RETRIES, base: float = BASE_SECONDS) -> dict[str, Column]:
    """Decision for the n-th failure since the last success or escalation."""
    place = (failures_in_row - 1) % (max_retries + 1)
    attempt = F.least(place + 1, F.lit(max_retries)).cast("int")
    retried = place < max_retries
    return {
        "event_type": F.when(retried, "TRANSIENT_RETRY").otherwise("ESCALATED"),
        "attempt": attempt,
        "delay_seconds": F.when(retried, backoff_seconds(attempt, base, MAX_SECONDS)),
    }


def retry_plan(
    outcomes: DataFrame,
    keys: list[str],
    order: list[str],
    failed: Column,
    succeeded: Column,
    max_retries: int = MAX_RETRIES,
    base: float = BASE_SECONDS,
    guard: SkewGuard = SkewGuard(),
) -> DataFrame:
    """One decision per transient failure; a success starts the count again."""
    rows = OrderedRows(outcomes.where(failed | succeeded), keys, order, guard)
    rows = rows.sum_since("__in_row", failed.cast("bigint"), succeeded)
    return rows.frame().where(failed).withColumns(retry_columns(F.col("__in_row"), max_retries, base)).drop("__in_row")


# Fields of a recovery log entry, in order, and the words in them.
RECOVERY_FIELDS = (
    "timestamp", "event_type", "process_name", "error_class", "error_pattern", "action_taken",
    "attempt", "max_retries", "failing_table", "gg_home", "success", "details",
)
RETRY_ACTION, ESCALATION_ACTION, PERMANENT_ACTION = "waiting_{}s_then_restart", "escalated_to_permanent", "disable_and_notify"
ESCALATED_CLASS, OVERRIDE_REASON = "TRANSIENT->PERMANENT", "Auto-recovery:"


def recovery_entries(decisions: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Decisions in the shape of the recovery log (missing fields become blanks)."""
    have = set(decisions.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    retried = F.col("event_type") == "TRANSIENT_RETRY"
    action = (
        F.when(retried, F.replace(F.lit(RETRY_ACTION), F.lit("{}"), F.col("delay_seconds").cast("bigint").cast("string")))
        .when(F.col("event_type") == "ESCALATED", ESCALATION_ACTION)
        .otherwise(PERMANENT_ACTION)
    )
    return decisions.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "event_type",
        text("process_name").alias("process_name"),
        F.when(F.col("event_type") == "ESCALATED", ESCALATED_CLASS).otherwise(text("error_class")).alias("error_class"),
        text("error_pattern").alias("error_pattern"),
        action.alias("action_taken"),
        F.coalesce(F.col("attempt"), F.lit(0)).alias("attempt"),
        F.lit(max_retries).alias("max_retries"),
        text("failing_table").alias("failing_table"),
        text("gg_home").alias("gg_home"),
        (F.col("success") if "success" in have else F.lit(False)).alias("success"),
        text("details").alias("details"),
    )


def quarantine_entries(failures: DataFrame) -> DataFrame:
    """Override rows that disable the failing table of a permanent or escalated failure."""
    why = F.concat_ws(" ", F.lit(OVERRIDE_REASON), "error_code", "error_pattern")
    return failures.where("failing_table IS NOT NULL AND failing_table <> ''").select(
        F.col("failing_table").alias("fqn"), F.lit(False).alias("enabled"), why.alias("reason"), F.col("ts").alias("changed_at")
    )
