"""Pipeline telemetry in batch form: files, lag, throughput, transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import status
from tidelog.operators.ordered import OrderedRows, SkewGuard

# Fixed value: two-character prefix and nine-digit sequence.
FILE_NAME = r"^([a-zA-Z][a-zA-Z0-9])(\d{9})$"
MB = 1024 * 1024
GB = 1024 * MB


# -- files -----------------------------------------------------------------

def parse_listing(listing: DataFrame) -> DataFrame:
    """Keep files named prefix + sequence and split the name."""
    return (
        listing.where(F.col("name").rlike(FILE_NAME))
        .withColumn("prefix", F.regexp_extract("name", FILE_NAME, 1))
        .withColumn("sequence", F.regexp_extract("name", FILE_NAME, 2).cast("bigint"))
    )


FILE_MEASURES = ("files", "total_bytes", "newest_seq", "oldest_seq", "newest_mtime", "oldest_mtime")


def _file_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.max("sequence").alias("newest_seq"),
        F.min("sequence").alias("oldest_seq"),
        F.max("mtime").alias("newest_mtime"),
        F.min("mtime").alias("oldest_mtime"),
    ]


def _sized(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("total_mb", F.col("total_bytes") / MB)
        .withColumn("total_gb", F.col("total_bytes") / GB)
        .withColumn("backlog", F.col("newest_seq") - F.col("oldest_seq"))
    )


def prefix_stats(files: DataFrame, by: list[str] = ("snapshot_ts", "dir")) -> DataFrame:
    return _sized(files.groupBy(*by, "prefix").agg(*_file_aggregates()))


def directory_stats(files: DataFrame, by: list[str] = ("snapshot_ts", "dir")) -> DataFrame:
    """Prefix rows plus one total row (null prefix) per directory, in one pass."""
    keys = [*by, "prefix"]
    grouped = files.groupingSets([keys, list(by)], *keys).agg(*_file_aggregates())
    return _sized(grouped)


def file_rates(
    stats: DataFrame, scans: DataFrame, dir: str = "dir", at: str = "snapshot_ts", guard: SkewGuard = SkewGuard()
) -> DataFrame:
    """Growth and consumption in MB/min between consecutive scans of a directory.

    ``stats``: dir, snapshot, prefix, total_bytes, newest_seq. ``scans``: every
    (dir, snapshot), also those that found nothing. A prefix counts only if it was
    there in the directory's previous scan. Shrinking counts as consumption unless
    the sequence went back. First scans and gaps under a second give 0.
    """
    last_scan = OrderedRows(scans.select(dir, at).distinct(), [dir], [at], guard).preceding({"__scan": F.col(at)})
    before = OrderedRows(stats.select(dir, at, "prefix", "total_bytes", "newest_seq"), [dir, "prefix"], [at], guard)
    before = before.preceding({"__at": F.col(at), "__bytes": F.col("total_bytes"), "__seq": F.col("newest_seq")})
    moved = F.col("total_bytes") - F.col("__bytes")
    per_scan = (
        before.frame()
        .join(last_scan.frame(), [dir, at])
        .where(F.col("__at") == F.col("__scan"))
        .groupBy(dir, at)
        .agg(
            F.sum(F.greatest(moved, F.lit(0))).alias("__grown"),
            F.sum(F.when(F.col("newest_seq") >= F.col("__seq"), F.greatest(-moved, F.lit(0))).otherwise(0)).alias("__used"),
        )
    )
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__scan").cast("timestamp"))) / 1_000_000
    rate = lambda c: F.when(F.col("__sec") >= 1, F.coalesce(c, F.lit(0)) / MB / (F.col("__sec") / 60)).otherwise(0.0)
    return (
        last_scan.frame()
        .withColumn("__sec", seconds)
        .join(per_scan, [dir, at], "left")
        .select(dir, at, rate(F.col("__grown")).alias("growth_mb_min"), rate(F.col("__used")).alias("consumed_mb_min"))
    )


def forecast(rates: DataFrame) -> DataFrame:
    """Hours until the disk is full and until the backlog is gone.

    Needs growth_mb_min, consumed_mb_min, free_mb and total_mb.
    """
    grow, use = F.col("growth_mb_min"), F.col("consumed_mb_min")
    return rates.withColumns(
        {
            "hours_to_fill": F.when((grow > 0) & (F.col("free_mb") > 0), F.col("free_mb") / grow / 60),
            "hours_to_catch_up": F.when((use > grow) & (F.col("total_mb") > 0), F.col("total_mb") / (use - grow) / 60),
            "trend": F.when(grow > use, "GROWING").when(use > grow, "DRAINING").otherwise("STABLE"),
        }
    )


def alerts(
    report: DataFrame, total_gb: float = 50, growth: float = 100, disk_pct: float = 80, fill_hours: float = 4
) -> DataFrame:
    """One row per exceeded threshold; a missing directory raises only that alert.

    Needs exists, total_gb, growth_mb_min, disk_pct and hours_to_fill.
    """
    there = F.col("exists")
    alert = lambda when, severity, kind, value: F.when(
        when,
        F.struct(
            F.lit(severity).alias("severity"), F.lit(kind).alias("alert"), value.cast("double").alias("value")
        ),
    )
    raised = F.array_compact(
        F.array(
            alert(~there, "WARN", "MISSING_DIRECTORY", F.lit(None)),
            alert(there & (F.col("total_gb") > total_gb), "WARN", "TOTAL_SIZE", F.col("total_gb")),
            alert(there & (F.col("growth_mb_min") > growth), "WARN", "GROWTH_RATE", F.col("growth_mb_min")),
            alert(there & (F.col("disk_pct") > disk_pct), "CRITICAL", "DISK_USAGE", F.col("disk_pct")),
            alert(there & (F.col("hours_to_fill") < fill_hours), "CRITICAL", "DISK_FILLING", F.col("hours_to_fill")),
        )
    )
    kept = [c for c in report.columns if c in ("dir", "snapshot_ts")]
    return report.withColumn("__alert", F.explode(raised)).select(*kept, "__alert.*")


def file_health(stats: DataFrame, now: Column) -> DataFrame:
    """Freshness of each directory's newest file and level of its disk (disk_pct)."""
    age = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("newest_mtime").cast("timestamp"))) / 60)
    return stats.withColumn("age_minutes", age).withColumn("freshness", status.staleness(F.col("age_minutes"))).withColumn(
        "disk", status.disk_level(F.col("disk_pct"))
    )


# -- lag and throughput ----------------------------------------------------

def latest_heartbeat(beats: DataFrame, keys: list[str], ts: str = "incoming_heartbeat_ts") -> DataFrame:
    """Newest beat per path; partial aggregation keeps one row per task and path."""
    return beats.groupBy(*keys).agg(F.max(ts).alias(ts))


def heartbeat_lag(
    beats: DataFrame, keys: list[str], now: Column, ts: str = "incoming_heartbeat_ts", scale=status.HEARTBEAT_LAG
) -> DataFrame:
    lag = F.timestamp_diff("SECOND", F.col(ts), now)
    return (
        latest_heartbeat(beats, keys, ts)
        .withColumn("lag_seconds", lag)
        .withColumn("lag_status", status.lag_status(F.col("lag_seconds"), scale))
    )


def retained(beats: DataFrame, now: Column, hours: int = 24, ts: str = "incoming_heartbeat_ts") -> DataFrame:
    return beats.where(F.col(ts) >= now - F.make_interval(hours=F.lit(hours)))


def gaps(
    rows: DataFrame, keys: list[str], ts: str, seq: str, scale=status.HEARTBEAT_LAG, guard: SkewGuard = SkewGuard()
) -> DataFrame:
    """Seconds since the key's previous row, rated on a lag scale."""
    out = OrderedRows(rows, keys, [ts, seq], guard).preceding({"__before": F.col(ts)}).frame()
    return (
        out.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("__before"), F.col(ts)))
        .withColumn("gap_status", status.lag_status(F.col("gap_seconds"), scale))
        .drop("__before")
    )


def throughput(rows: DataFrame, by: list[str], minutes: int = 30, ts: str = "op_ts") -> DataFrame:
    """Rows and rows per second in tumbling windows, per key."""
    span = F.window(ts, f"{minutes} minutes")
    return (
        rows.groupBy(span.alias("__w"), *by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("__w.start").alias("window_start"), *by, "rows", (F.col("rows") / (minutes * 60)).alias("rows_per_second")
        )
    )


def long_transactions(
    log: DataFrame, txn: list[str], ts: str, closes: Column, now: Column, limit_seconds: int = 900
) -> DataFrame:
    """Transactions open longer than the limit: until their closing row, or now."""
    return (
        log.groupBy(*txn)
        .agg(
            F.min(ts).alias("opened_at"),
            F.max(F.when(closes, F.col(ts))).alias("closed_at"),
            F.count(F.lit(1)).alias("changes"),
        )
        .withColumn("open_seconds", F.timestamp_diff("SECOND", "opened_at", F.coalesce(F.col("closed_at"), now)))
        .where(F.col("open_seconds") > limit_seconds)
    )


# -- roll-up ---------------------------------------------------------------

def roll_up(checks: DataFrame, by: list[str] = (), severity: str = "severity") -> DataFrame:
    """Worst severity and how many checks passed, warned and failed."""
    rank = status.severity_rank(F.col(severity))
    return (
        checks.withColumn("__rank", rank)
        .groupBy(*by)
        .agg(
            F.coalesce(F.max("__rank"), F.lit(0)).alias("__worst"),
            *[F.count_if(F.col("__rank") == r).alias(n) for r, n in enumerate(("passed", "warned", "failed"))],
        )
        .withColumn("severity", status.severity_word(F.col("__worst")))
        .drop("__worst")
    )
