"""Failure detection, retry state and quarantine as a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import rules
from tidelog.operators import loglines
from tidelog.operators.retry import BASE_SECONDS, MAX_RETRIES, MAX_SECONDS, quarantine_entries
from tidelog.streaming.ingest import batch_folder
from tidelog.streaming.inorder import InOrder, in_order

DECISION = "process_name string, ts timestamp, seq bigint, event_type string, attempt int, delay_seconds double"


def failures_in_row(failed: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each row in order: failures since the last success of its process, given those before. ``starts``: first rows of processes."""
    so_far = np.cumsum(failed)
    since = np.where(failed, 0, so_far)
    since[starts] = so_far[starts] - np.where(failed[starts], before + 1, 0)
    resets = ~failed
    resets[starts] = True
    return so_far - since[np.maximum.accumulate(np.where(resets, np.arange(len(failed)), 0))]


class Retries(InOrder):
    """Keeps one number per process: its failures since the last success."""

    FRESH = {"failures": 0}

    def __init__(self, max_retries: int, base: float, slot_seconds: int):
        super().__init__(slot_seconds)
        self.max_retries, self.base = max_retries, base

    def release(self, kept, key, ts, seq, failed, starts):
        counts = failures_in_row(failed, starts, kept["failures"][key[starts]])
        # A full cycle starts over, so the number kept stays small.
        kept["failures"][key[starts]] = counts[np.append(starts[1:], len(key)) - 1] % (self.max_retries + 1)
        place = (counts[failed] - 1) % (self.max_retries + 1)
        attempt = np.minimum(place + 1, self.max_retries)
        delay = np.minimum(self.base * np.power(2.0, attempt), MAX_SECONDS)
        retried = place < self.max_retries
        if len(place):
            yield pd.DataFrame(
                {
                    "process_name": kept.names(key[failed]),
                    "ts": pd.to_datetime(ts[failed], unit="us"),
                    "seq": seq[failed],
                    "event_type": np.where(retried, "TRANSIENT_RETRY", "ESCALATED"),
                    "attempt": attempt.astype("int32"),
                    "delay_seconds": np.where(retried, delay, np.nan),
                }
            )

    def live(self, kept):
        return kept["failures"] > 0


def retry_stream(
    outcomes: DataFrame, max_retries: int = MAX_RETRIES, base: float = BASE_SECONDS, late: str = "10 minutes", slot_seconds: int = 60
) -> DataFrame:
    """Retry decisions for a stream of (process_name, ts, seq, failed).

    Outcomes wait until the watermark has passed their slot and are decided on in the order of (ts, seq), so the result is
    that of ``retry_plan`` however rows are spread over batches. Decisions come ``late`` and up to a slot later.
    """
    rows = outcomes.withColumn("flag", F.col("failed"))
    out = in_order(rows, "process_name", Retries(max_retries, base, slot_seconds), DECISION, late)
    return out.withColumn("delay_seconds", F.nanvl("delay_seconds", F.lit(None).cast("double")))


def failure_stream(lines: DataFrame) -> DataFrame:
    """Failed processes in new log lines, classified by the line itself, with the time the line is stamped with."""
    events = loglines.named_events(loglines.abend_events(lines, rules.ABEND_OR_STOP_LINE))
    table = F.upper(rules.last_match(F.col("value"), rules.TABLE_NAME))
    code = rules.last_match(F.col("value"), rules.ERROR_CODE)
    return loglines.classified(events).withColumns({"error_code": code, "failing_table": table, "failed_at": rules.stamped_at(F.col("value"))})


def _override_writer(rows: DataFrame, entries, overrides_path: str, checkpoint: str):
    def disable(batch: DataFrame, batch_id: int) -> None:
        entries(batch).write.mode("overwrite").parquet(batch_folder(batch, batch_id, overrides_path, checkpoint))

    return rows.writeStream.foreachBatch(disable).option("checkpointLocation", checkpoint)


def quarantine_stream(failures: DataFrame, overrides_path: str, checkpoint: str, load_reports=None):
    """Append a disabling override for every permanent failure that names a table.

    ``load_reports`` returns the report lines of the moment (process_name, block, row, value); they are read anew
    per batch, and a failure is judged by its line and the tail of its process's report, which may name code and table too.
    The override has the time of the failure, so a repeated batch writes the same row; a line without a stamp has that of its file.
    """

    def entries(batch: DataFrame) -> DataFrame:
        if load_reports is not None:
            judged = loglines.enrich_events(batch.drop("error_class", "error_pattern").withColumnsRenamed({"error_code": "__code", "failing_table": "__table"}), load_reports())
            batch = judged.withColumns({"error_code": F.coalesce("error_code", "__code"), "failing_table": F.coalesce("failing_table", "__table")})
        seen = [F.col("seen_at").cast("timestamp_ntz")] if "seen_at" in batch.columns else []
        return quarantine_entries(batch.where("error_class = 'PERMANENT'").withColumn("ts", F.coalesce("failed_at", *seen)))

    return _override_writer(failures, entries, overrides_path, checkpoint)


def escalation_stream(decisions: DataFrame, load_failures, overrides_path: str, checkpoint: str):
    """Append a disabling override for every escalation (see ``retry_stream``): who fails after the last retry has its table disabled.

    ``load_failures`` returns the failures (process_name, seq, error_code, failing_table), read anew per batch.
    """

    def entries(batch: DataFrame) -> DataFrame:
        escalated = batch.where("event_type = 'ESCALATED'").select("process_name", "seq", "ts", F.lit("retries used up").alias("error_pattern"))
        return quarantine_entries(load_failures().join(escalated, ["process_name", "seq"]))

    return _override_writer(decisions, entries, overrides_path, checkpoint)
