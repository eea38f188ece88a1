"""Threshold scales shared by the monitoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (warn, critical) seconds and the words of the two lag scales.
HEARTBEAT_LAG = (60, 300, "WARNING")
MONITOR_LAG = (300, 1800, "WARN")

SEVERITIES = ("OK", "WARN", "CRITICAL")


def lag_status(seconds: Column, scale: tuple[int, int, str] = HEARTBEAT_LAG) -> Column:
    warn, critical, warn_word = scale
    return (
        F.when(seconds > critical, "CRITICAL").when(seconds > warn, warn_word).otherwise("OK")
    )


def hms_seconds(text: Column) -> Column:
    """Seconds of the first H:M:S in the text, null when there is none."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+)", i).try_cast("bigint")
    return part(1) * 3600 + part(2) * 60 + part(3)


def severity_rank(word: Column) -> Column:
    """CRITICAL/FAIL above WARN/WARNING above everything else."""
    upper = F.upper(word)
    return F.when(upper.isin("CRITICAL", "FAIL"), 2).when(upper.isin("WARN", "WARNING"), 1).otherwise(0)


def severity_word(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def process_severity(status: Column) -> Column:
    upper = F.upper(status)
    return (
        F.when(upper == "RUNNING", "OK")
        .when(upper.isin("ABENDED", "STOPPED"), "CRITICAL")
        .otherwise("WARN")
    )


def staleness(age_minutes: Column) -> Column:
    """How fresh the newest file of a directory is."""
    return F.when(age_minutes > 30, "STALE").when(age_minutes > 5, "IDLE").otherwise("ACTIVE")


def disk_level(pct: Column) -> Column:
    return F.when(pct > 90, "FAIL").when(pct > 75, "WARN").otherwise("OK")


def backoff_seconds(attempt: Column, base: float = 30.0, cap: float = 240.0) -> Column:
    """Exponential delay; the attempt counts before the delay is taken."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))
