"""Live heartbeat lag, throughput and open-transaction watch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import status
from tidelog.streaming.inorder import InOrder, in_order


def as_instant(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need instants; NTZ columns are taken as session-zone (UTC) times."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def heartbeat_lag_stream(
    beats: DataFrame, keys: list[str], now: Column | None = None, ts: str = "incoming_heartbeat_ts", late: str = "10 minutes",
    scale=status.HEARTBEAT_LAG,
) -> DataFrame:
    """Lag per path after every batch (update mode); one state row per path."""
    at = now if now is not None else F.current_timestamp()
    return (
        as_instant(beats, ts).withWatermark(ts, late).groupBy(*keys).agg(F.max(ts).alias(ts))
        .withColumn("lag_seconds", F.timestamp_diff("SECOND", F.col(ts), at))
        .withColumn("lag_status", status.lag_status(F.col("lag_seconds"), scale))
    )


def missing_beats(beats: DataFrame, keys: list[str], now: Column, cadence_seconds: int = 60, ts: str = "incoming_heartbeat_ts") -> DataFrame:
    """Paths without a beat in the last two cadences (batch, over the kept history)."""
    since = now - F.make_interval(secs=F.lit(2 * cadence_seconds))
    return beats.groupBy(*keys).agg(F.max(ts).alias("last_beat")).where(F.col("last_beat") < since)


SILENT = "path string, last_beat timestamp, due timestamp, severity string"


class Beats(InOrder):
    """Keeps the last beat of a path until its silence has been reported."""

    FRESH = {"beat": 0, "awaited": False}

    def __init__(self, limit_seconds: int, slot_seconds: int):
        super().__init__(slot_seconds)
        self.limit = limit_seconds * 1_000_000

    def _alerts(self, paths: np.ndarray, beats: np.ndarray) -> pd.DataFrame:
        times = pd.to_datetime(beats, unit="us"), pd.to_datetime(beats + self.limit, unit="us")
        return pd.DataFrame({"path": paths, "last_beat": times[0], "due": times[1], "severity": "CRITICAL"})

    def release(self, kept, key, ts, seq, flag, starts):
        paths = key[starts]
        before = np.append(0, ts[:-1])
        before[starts] = np.where(kept["awaited"][paths], kept["beat"][paths], ts[starts])
        silent = ts - before > self.limit
        kept["beat"][paths] = ts[np.append(starts[1:], len(ts)) - 1]
        kept["awaited"][paths] = True
        if silent.any():
            yield self._alerts(kept.names(key[silent]), before[silent])

    def idle(self, kept, until):
        silent = np.flatnonzero(kept["awaited"] & (kept["beat"] + self.limit < until))
        if len(silent):
            kept["awaited"][silent] = False
            yield self._alerts(kept.names(silent), kept["beat"][silent])

    def live(self, kept):
        return kept["awaited"]

    def wakes(self, kept):
        return kept["beat"][kept["awaited"]] + self.limit


def silent_path_stream(
    beats: DataFrame, path: str, ts: str = "incoming_heartbeat_ts", limit_seconds: int = 120, late: str = "1 minute", slot_seconds: int = 60
) -> DataFrame:
    """One CRITICAL row for each beat that none followed within the limit, also if none ever does: a timer per path
    fires without input, as the beats of other paths move the watermark. A path is reported once per silence."""
    rows = beats.select(F.col(path).cast("string").alias("path"), F.col(ts).alias("ts"), F.lit(0).alias("seq"), F.lit(True).alias("flag"))
    return in_order(rows, "path", Beats(limit_seconds, slot_seconds), SILENT, late)


def throughput_stream(changes: DataFrame, by: list[str], minutes: int = 30, ts: str = "op_ts", late: str = "10 minutes") -> DataFrame:
    """Closed windows only (append mode); the watermark drops finished windows."""
    return (
        as_instant(changes, ts).withWatermark(ts, late)
        .groupBy(F.window(ts, f"{minutes} minutes").alias("__w"), *by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("__w.start").alias("window_start"), *by, "rows", (F.col("rows") / (minutes * 60)).alias("rows_per_second"))
    )


OPEN_ALERT = "txn string, opened_at timestamp, changes bigint, open_seconds bigint"


class OpenTransactions(InOrder):
    """Keeps the first change of an open transaction, the number of its changes and the time of its next check."""

    FRESH = {"opened": 0, "changes": 0, "due": 0, "open": False}

    def __init__(self, limit_seconds: int, check_seconds: int, slot_seconds: int):
        super().__init__(slot_seconds)
        self.limit, self.check = limit_seconds * 1_000_000, check_seconds * 1_000_000

    def release(self, kept, key, ts, seq, closes, starts):
        txns, ends = key[starts], np.append(starts[1:], len(key))
        closed = np.maximum.reduceat(np.where(closes, np.arange(len(key)), -1), starts)
        first = np.maximum(closed + 1, starts)
        still = kept["open"][txns] & (closed < 0)
        opens = ~still & (first < ends)
        kept["changes"][txns] = np.where(still, kept["changes"][txns], 0) + ends - first
        kept["opened"][txns[opens]] = ts[first[opens]]
        kept["due"][txns[opens]] = ts[first[opens]] + self.limit
        kept["open"][txns] = still | opens
        return iter(())

    def idle(self, kept, until):
        due = np.flatnonzero(kept["open"] & (kept["due"] < until))
        if len(due):
            now, opened = self.watermark * 1000, kept["opened"][due]
            kept["due"][due] = now + self.check
            columns = {"txn": kept.names(due), "opened_at": pd.to_datetime(opened, unit="us"), "changes": kept["changes"][due]}
            yield pd.DataFrame({**columns, "open_seconds": (now - opened) // 1_000_000})

    def live(self, kept):
        return kept["open"]

    def wakes(self, kept):
        return kept["due"][kept["open"]]


def long_transaction_stream(changes: DataFrame, limit_seconds: int = 900, check_seconds: int = 300, late: str = "1 minute", slot_seconds: int = 60) -> DataFrame:
    """Alerts for transactions open beyond the limit, repeated at every check while the watermark moves on.

    Needs txn, ts, closes (bool) and, where times tie, seq. Changes are taken in the order of their times, so batches and late rows within
    the allowance change nothing; rows after the closing one are a new transaction. State is one row per open transaction beside the rows that wait.
    Time is event time, so replays behave like live runs.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    rows = changes.select(F.col("txn").cast("string").alias("txn"), "ts", seq.alias("seq"), F.col("closes").alias("flag"))
    return in_order(rows, "txn", OpenTransactions(limit_seconds, check_seconds, slot_seconds), OPEN_ALERT, late)
