import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import loglines, retry, telemetry
from tidelog.operators.ordered import SkewGuard
from tidelog.streaming.monitor import missing_beats

MB = 1024 * 1024
T0 = datetime.datetime(2024, 1, 1)


def after(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def scans(spark, rows):
    """rows: seconds, directory, prefix, MB, newest sequence"""
    stats = small_table(spark, [(after(s), d, p, int(mb * MB), q) for s, d, p, mb, q in rows],
                        "snapshot_ts timestamp_ntz, dir string, prefix string, total_bytes bigint, newest_seq bigint")
    return {
        (r.dir, int((r.snapshot_ts - T0).total_seconds() * 10)): (r.growth_mb_min, r.consumed_mb_min)
        for r in telemetry.file_rates(stats, stats.select("dir", "snapshot_ts")).collect()
    }


def test_growth_and_consumption(spark):
    got = scans(spark, [
        (0, "a", "e1", 10, 1), (60, "a", "e1", 16, 2), (120, "a", "e1", 4, 3), (240, "a", "e1", 1, 2),
        (60, "a", "e2", 50, 1), (120, "a", "e2", 52, 2),
    ])
    assert got == {("a", 0): (0, 0), ("a", 600): (6, 0), ("a", 1200): (2, 12), ("a", 2400): (0, 0)}


def test_prefix_absent_from_the_last_scan_does_not_count(spark):
    got = scans(spark, [(0, "a", "e1", 10, 1), (60, "a", "e2", 1, 1), (120, "a", "e1", 30, 2), (120, "a", "e2", 3, 1)])
    assert got[("a", 1200)] == (2, 0)


def test_scans_within_a_second_give_no_rate(spark):
    assert scans(spark, [(0, "a", "e1", 1, 1), (0.5, "a", "e1", 9, 1)])[("a", 5)] == (0, 0)


def test_listing_names(spark):
    names = ["e1000000001", "E9000000012", "ee000000003", "1e000000001", "e100000001", "e1000000001.bak"]
    rows = small_table(spark, [(n,) for n in names], "name string")
    assert {(r.prefix, r.sequence) for r in telemetry.parse_listing(rows).collect()} == {("e1", 1), ("E9", 12), ("ee", 3)}


def test_forecast_and_alerts(spark):
    rows = small_table(
        spark,
        [("grow", True, 60.0, 1.0, 120.0, 60_000.0, 50 * 1024.0, 81.0), ("drain", True, 1.0, 31.0, 0.0, 0.0, 1800.0, 80.0), ("none", False, 999.0, 0.0, 1.0, 1.0, 1.0, 99.0)],
        "dir string, exists boolean, growth_mb_min double, consumed_mb_min double, unused double, free_mb double, total_mb double, disk_pct double",
    ).withColumn("total_gb", F.col("total_mb") / 1024)
    forecast = {r.dir: r for r in telemetry.forecast(rows).collect()}
    assert forecast["grow"].trend == "GROWING" and forecast["grow"].hours_to_catch_up is None
    assert forecast["drain"].hours_to_fill is None and forecast["drain"].hours_to_catch_up == 1.0
    raised = {(r.dir, r.severity, r.alert) for r in telemetry.alerts(telemetry.forecast(rows), growth=59).collect()}
    assert raised == {("grow", "WARN", "GROWTH_RATE"), ("grow", "CRITICAL", "DISK_USAGE"), ("none", "WARN", "MISSING_DIRECTORY")}


def test_heartbeats(spark):
    beats = small_table(spark, [("p", T0), ("p", after(200)), ("q", T0), ("r", after(239))], "path string, incoming_heartbeat_ts timestamp_ntz")
    now = F.lit(after(301))
    got = {r.path: (r.lag_seconds, r.lag_status) for r in telemetry.heartbeat_lag(beats, ["path"], now).collect()}
    assert got == {"p": (101, "WARNING"), "q": (301, "CRITICAL"), "r": (62, "WARNING")}
    assert telemetry.retained(beats, F.lit(after(24 * 3600 + 100)), 24).count() == 2


def test_missing_beats(spark):
    beats = small_table(spark, [("late", T0), ("fine", after(100))], "path string, incoming_heartbeat_ts timestamp_ntz")
    assert [r.path for r in missing_beats(beats, ["path"], F.lit(after(200)), 60).collect()] == ["late"]


def test_long_transactions(spark):
    log = small_table(spark, [("a", T0, False), ("a", after(901), True), ("b", T0, False), ("b", after(900), True), ("c", after(50), False)],
                      "txn string, ts timestamp_ntz, closes boolean")
    got = {r.txn: r.open_seconds for r in telemetry.long_transactions(log, ["txn"], "ts", F.col("closes"), F.lit(after(2000))).collect()}
    assert got == {"a": 901, "c": 1950}


def test_roll_up(spark):
    rows = small_table(spark, [("OK",), ("WARN",), ("OK",)], "severity string")
    row = telemetry.roll_up(rows).first()
    assert (row.severity, row.passed, row.warned, row.failed) == ("WARN", 2, 1, 0)
    assert telemetry.roll_up(rows.where("false")).first().severity == "OK"


def lines(spark, texts, file="f", process=None):
    rows = [(file, 0, i, t, process) for i, t in enumerate(texts)]
    return small_table(spark, rows, "file string, block bigint, row bigint, value string, process_name string")


def test_continuation_lines_share_the_last_stamp(spark):
    got = loglines.recent_errors(
        lines(spark, ["ERROR before any stamp", "2024-01-01T09:59:59Z ERROR old", "  OGG-1 old too", "2024-01-01T10:00:00Z INFO", "  ABEND new", "quiet"]),
        F.lit("2024-01-01T10:00"),
    )
    assert [r.value for r in got.collect()] == ["  ABEND new"]


def test_report_details(spark):
    report = lines(spark, ["ERROR OGG-00001 MAP s.first"] + ["x"] * 60 + ["OGG-00002 bad TABLE a.b", "error later", "bye"], process="EXT01")
    row = loglines.report_details(report, 50).first()
    assert (row.error_code, row.failing_table, row.error_message) == ("OGG-00002", "A.B", "error later")
    assert loglines.report_details(report, 80).first().excerpt.startswith("ERROR OGG-00001")


def test_events_and_enrichment(spark):
    log = lines(spark, ["EXTRACT ext01 ABENDED", "something abended", "REPLICAT rep02 STOPPED", "fine"])
    assert {r.process_name for r in loglines.abend_events(log).collect()} == {"EXT01", None}
    found = loglines.abend_events(log, loglines.rules.ABEND_OR_STOP_LINE).drop("file", "block", "row")
    report = lines(spark, ["OGG-00868 timeout", "OGG-01028 no key TABLE hr.emp"], process="EXT01")
    got = {r.process_name: (r.error_class, r.failing_table) for r in loglines.enrich_events(found, report).collect()}
    assert got == {"EXT01": ("PERMANENT", "HR.EMP"), "REP02": ("UNKNOWN", None)}


def test_events_see_the_report_as_it_was(spark):
    report = [("EXT01", i, v) for i, v in [(1, "OGG-00868 timeout"), (2, "MAP hr.one"), (5, "restarted"), (7, "OGG-01028 no key TABLE hr.two")]]
    report += [("EXT01", 10 + i, "noise") for i in range(6)]
    lines_ = small_table(spark, report, "process_name string, row bigint, value string").withColumn("block", F.lit(0))
    log = [("EXT01", 3, "EXT01 ABENDED"), ("EXT01", 3, "EXT01 ABENDED again"), ("EXT01", 8, "EXT01 ABENDED"), ("EXT01", 99, "EXT01 ABENDED"), ("EXT01", 0, "early"), ("REP9", 4, "no report"), (None, 4, "x")]
    events = small_table(spark, log, "process_name string, row bigint, value string")
    for guard in (SkewGuard(), SkewGuard(min_bytes=0, hot_rows=4)):
        got = loglines.enrich_events_as_of(events, lines_, "row", 5, guard=guard).collect()
        found = sorted((r.process_name, r.row, r.value, r.error_code, r.failing_table, r.error_class) for r in got)
        assert found == [
            ("EXT01", 0, "early", None, None, "UNKNOWN"),
            ("EXT01", 3, "EXT01 ABENDED", "OGG-00868", "HR.ONE", "TRANSIENT"),
            ("EXT01", 3, "EXT01 ABENDED again", "OGG-00868", "HR.ONE", "TRANSIENT"),
            ("EXT01", 8, "EXT01 ABENDED", "OGG-01028", "HR.TWO", "PERMANENT"),
            ("EXT01", 99, "EXT01 ABENDED", None, None, "UNKNOWN"),
            ("REP9", 4, "no report", None, None, "UNKNOWN"),
        ]


def test_lines_left_out_are_counted(spark):
    log = lines(spark, [f"2024-01-01T10:00:{i:02d}Z ERROR {i}" for i in range(20)])
    got = loglines.recent_errors(log, F.lit("2024-01-01T10:00"), 15, count_rest=True).collect()
    assert len(got) == 15 and {r.left_out for r in got} == {5}


def test_process_status(spark):
    log = lines(spark, ["EXTRACT ext01 Last Started  Status RUNNING", "Extract EXT01 x Status ABENDED", "REPLICAT rdb01 since 10:30 STOPPED", "REPLICAT r2 x Status STARTING", "MANAGER up"])
    got = {r.process_name: (r.status, r.severity) for r in loglines.process_status(log).collect()}
    assert got == {"EXT01": ("ABENDED", "CRITICAL"), "RDB01": ("STOPPED", "CRITICAL"), "R2": ("STARTING", "WARN")}


def simulate_retries(outcomes, most=5, base=30.0):
    attempt, out = 0, []
    for failed in outcomes:
        if not failed:
            attempt = 0
        elif attempt >= most:
            out.append(("ESCALATED", attempt, None))
            attempt = 0
        else:
            attempt += 1
            out.append(("TRANSIENT_RETRY", attempt, min(base * 2**attempt, 240.0)))
    return out


@pytest.mark.parametrize("guard", [SkewGuard(), SkewGuard(min_bytes=0, hot_rows=15)])
def test_retry_plan_equals_the_row_by_row_rule(spark, guard):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.random() < 0.85) for i in range(300)]
    table = small_table(spark, rows, "p string, seq bigint, failed boolean")
    plan = retry.retry_plan(table, ["p"], ["seq"], F.col("failed"), ~F.col("failed"), guard=guard).orderBy("p", "seq").collect()
    for process in "ab":
        expected = simulate_retries([f for p, _, f in rows if p == process])
        assert [(r.event_type, r.attempt, r.delay_seconds) for r in plan if r.p == process] == expected


def test_recovery_entries_and_quarantine(spark):
    rows = small_table(spark, [("EXT01", T0, "TRANSIENT_RETRY", 2, 120.0, "HR.EMP"), ("EXT02", T0, "ESCALATED", 5, None, None)],
                       "process_name string, ts timestamp_ntz, event_type string, attempt int, delay_seconds double, failing_table string")
    first, second = retry.recovery_entries(rows).orderBy("process_name").collect()
    assert tuple(first.asDict()) == retry.RECOVERY_FIELDS
    assert (first.timestamp, first.action_taken, first.failing_table) == ("2024-01-01T00:00:00Z", "waiting_120s_then_restart", "HR.EMP")
    assert (second.action_taken, second.error_class) == ("escalated_to_permanent", "TRANSIENT->PERMANENT")
    failures = rows.withColumn("error_code", F.lit("OGG-01028")).withColumn("error_pattern", F.lit("why"))
    assert [tuple(r) for r in retry.quarantine_entries(failures).collect()] == [("HR.EMP", False, "Auto-recovery: OGG-01028 why", T0)]
