"""Streams over several files end where the batch form does."""

import datetime
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import retry, routes, state
from tidelog.plans import streams
from tidelog.sinks.mirror import Mirror
from tidelog.sinks.reports import stream_alerts
from tidelog.sources import changelog, logs
from tidelog.streaming import ingest, monitor, recovery

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k int, seq bigint, op_ts timestamp_ntz, op_type string, is_deleted int, v string"


def after(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture(scope="module")
def log_dir(spark, tmp_path_factory):
    """Six files of changes; some keys die, some come back."""
    folder = str(tmp_path_factory.mktemp("log"))
    rng = random.Random(3)
    for part in range(6):
        rows = []
        for i in range(200):
            seq = part * 200 + i
            op = rng.choice("IUUD")
            rows.append((rng.randrange(90), seq, after(seq * 10), op, int(op == "D"), str(seq)))
        small_table(spark, rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def follow(spark, folder):
    return changelog.follow_log(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def current(df):
    return sorted((r.k, r.seq, r.v) for r in df.collect())


def test_two_consumers_of_one_log(spark, log_dir, tmp_path):
    log = spark.read.parquet(log_dir)
    mirror = Mirror(spark, str(tmp_path / "mirror"), ["k"], log.schema)
    finish(ingest.mirror_stream(follow(spark, log_dir), mirror, str(tmp_path / "c1")))
    finish(ingest.append_stream(follow(spark, log_dir), str(tmp_path / "copy"), str(tmp_path / "c2")))
    assert current(mirror.state()) == current(state.current_state(log, ["k"]))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == log.count()
    # Restarting from the checkpoint finds nothing new.
    finish(ingest.append_stream(follow(spark, log_dir), str(tmp_path / "copy"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == log.count()
    assert mirror.version() == 6  # six batches and a compaction


def test_mirror_batches(spark, tmp_path):
    frame = lambda *rows: small_table(spark, [(k, s, after(s), op, int(op == "D"), f"{op}{s}") for k, s, op in rows], SCHEMA)
    mirror = Mirror(spark, str(tmp_path / "m"), ["k"], frame((1, 1, "I")).schema)
    assert mirror.version() == -1 and mirror.state().count() == 0
    mirror.apply(frame((1, 1, "I"), (2, 2, "I"), (3, 3, "I")))
    mirror.apply(frame((1, 5, "D"), (2, 4, "U")))
    expected = [(2, 4, "U4"), (3, 3, "I3")]
    assert current(mirror.state()) == expected
    mirror.apply(frame((1, 5, "D"), (2, 4, "U")))  # a repeated batch
    mirror.apply(frame((1, 2, "U"), (2, 1, "U")))  # late changes
    assert current(mirror.state()) == expected
    assert current(mirror.state(tombstones=True)) == [(1, 5, "D5"), *expected]
    assert mirror.vacuum(keep=1) == 3  # each batch made a version
    assert current(mirror.state()) == expected
    assert {f.name for f in (tmp_path / "m/data").iterdir()} == {r.folder for r in mirror.runs()}


def test_mirror_runs_stay_few_and_rewriting_is_rare(spark, tmp_path):
    frame = lambda lo: small_table(spark, [(k, k, after(k), "I", 0, str(k)) for k in range(lo, lo + 10)], SCHEMA)
    mirror = Mirror(spark, str(tmp_path / "m"), ["k"], frame(0).schema)
    written = 0
    for i in range(24):
        mirror.apply(frame(10 * i))
        while mirror.compact():
            written += mirror.runs()[-1].rows
        mirror.vacuum(1)
        assert len(mirror.runs()) <= 8
    assert mirror.state().count() == 240 and written <= 240 * 4
    assert mirror.compact(whole=True) and len(mirror.runs()) == 1
    assert not mirror.compact(whole=True)
    assert current(mirror.state()) == [(k, k, str(k)) for k in range(240)]


def test_two_writers_lose_nothing(spark, tmp_path):
    frame = lambda *rows: small_table(spark, [(k, s, after(s), "U", 0, str(s)) for k, s in rows], SCHEMA)
    one = Mirror(spark, str(tmp_path / "m"), ["k"], frame((1, 1)).schema)
    two = Mirror(spark, str(tmp_path / "m"), ["k"], frame((1, 1)).schema)
    # Both have written their run on top of the same version before either publishes.
    first, second = one._write(frame((1, 1), (2, 5))), two._write(frame((1, 9), (3, 3)))
    assert two._publish(second, []) and one._publish(first, [])
    assert one.version() == 1
    assert current(two.state()) == [(1, 9, "9"), (2, 5, "5"), (3, 3, "3")]
    # Of two compactions of the same runs one is given up; a batch in between stays.
    runs = one.runs()
    mine, other = one._write(one._read(runs)), two._write(two._read(runs))
    one.apply(frame((4, 4)))
    assert two._publish(other, runs) and not one._publish(mine, runs)
    assert current(one.state()) == [(1, 9, "9"), (2, 5, "5"), (3, 3, "3"), (4, 4, "4")]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Mirror(spark, one.path, ["k"], one.schema).apply(frame((10 + i, i))), range(8)))
    assert one.version() == 11 and one.state().count() == 12
    # What was written but never published goes once it is old.
    assert one.vacuum(1) == 11 and len(list((tmp_path / "m/data").iterdir())) == len(one.runs()) + 1
    one.vacuum(1, orphans_after_hours=0)
    assert {f.name for f in (tmp_path / "m/data").iterdir()} == {r.folder for r in one.runs()}
    assert one.state().count() == 12


def test_routed_batches_of_a_new_checkpoint_overwrite_nothing(spark, log_dir, tmp_path):
    routed = small_table(spark, [("S", "T", 1, "rds", "", "M", True, "", "")],
                         "schema string, table_name string, group_id int, target string, target_schema string, rds_target_schema string, "
                         "enabled boolean, disabled_reason string, disabled_at string")
    rows = spark.read.parquet(log_dir).count()
    for run in (1, 2):
        stream = follow(spark, log_dir).withColumn("fqn", F.lit("S.T"))
        finish(ingest.routed_stream(stream, lambda: routes.normalise_routes(routed), lambda: None, str(tmp_path / "out"), str(tmp_path / f"c{run}")))
        assert spark.read.parquet(str(tmp_path / "out")).count() == run * rows


def test_unfinished_batch_is_invisible_and_repeatable(spark, tmp_path):
    row = lambda s, v: small_table(spark, [(1, s, after(s), "U", 0, v)], SCHEMA)
    mirror = Mirror(spark, str(tmp_path / "m"), ["k"], row(1, "").schema)
    mirror.apply(row(1, "first"))
    # Data of batch 1 was written, its manifest was not.
    mirror._write(row(2, "half"))
    assert current(mirror.state()) == [(1, 1, "first")]
    mirror.apply(row(3, "whole"))
    assert current(mirror.state()) == [(1, 3, "whole")]


RETRY_ROWS = "process_name string, ts timestamp_ntz, seq bigint, failed boolean"


def in_files(spark, folder, batches, schema):
    for rows in batches:
        small_table(spark, rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return changelog.follow_log(spark, folder, spark.read.parquet(folder).schema, 1)


def collected(spark, out, tmp_path, name="out"):
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")))
    return spark.read.schema(out.schema).parquet(str(tmp_path / name))


def test_retry_stream_equals_batch_in_whatever_order_rows_come(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"P{rng.randrange(4)}", after(30 * i), i, rng.random() < 0.85) for i in range(400)]
    mixed = rng.sample(rows, len(rows))
    batches = [*[mixed[i : i + 80] for i in range(0, 400, 80)], [(None, after(90 * 86400), 0, False)]]
    stream = in_files(spark, str(tmp_path / "in"), batches, RETRY_ROWS)
    got = collected(spark, recovery.retry_stream(stream, late="10 days", slot_seconds=600), tmp_path)
    batch = retry.retry_plan(small_table(spark, rows, RETRY_ROWS), ["process_name"], ["ts", "seq"], F.col("failed"), ~F.col("failed"))
    columns = ["process_name", "ts", "seq", "event_type", "attempt", "delay_seconds"]
    got = got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_retry_stream_gives_out_what_the_watermark_has_passed_and_drops_late_rows(spark, tmp_path):
    batches = [
        [("p", after(300), 3, True), ("p", after(100), 1, True), ("p", after(100), 0, False)],
        [("q", after(2000), 9, True)],
        [("p", after(200), 2, False), ("p", after(1995), 4, True)],  # 200 is late by now: 300 has been decided on
        [("q", after(4000), 10, True), ("p", None, 11, True)],
    ]
    out = recovery.retry_stream(in_files(spark, str(tmp_path / "in"), batches, RETRY_ROWS), late="1 minute", slot_seconds=60)
    got = sorted((r.process_name, r.seq, r.attempt) for r in collected(spark, out, tmp_path).collect())
    assert got == [("p", 1, 1), ("p", 3, 2), ("p", 4, 3), ("q", 9, 1)]


def test_silent_paths_are_reported_without_input(spark, tmp_path):
    schema = "path string, incoming_heartbeat_ts timestamp_ntz"
    beats = [("dead", 0), ("dead", 50), ("slow", 0), ("slow", 400), ("slow", 500), ("live", 0)] + [("live", 60 * i) for i in range(1, 60)] + [("slow", 3550), ("gone", 2400), ("live", 9000)]
    rng = random.Random(1)
    rng.shuffle(beats)
    ordered = sorted(beats, key=lambda b: b[1] // 600)
    batches = [[(p, after(s)) for p, s in ordered[i : i + 20]] for i in range(0, len(ordered), 20)]
    stream = in_files(spark, str(tmp_path / "in"), batches, schema)
    out = monitor.silent_path_stream(stream, "path", limit_seconds=120, late="10 minutes")
    got = sorted((r.path, r.last_beat, r.due, r.severity) for r in collected(spark, out, tmp_path).collect())
    expected = [("dead", 50), ("gone", 2400), ("live", 3540), ("slow", 0), ("slow", 500), ("slow", 3550)]
    assert got == [(p, after(s), after(s + 120), "CRITICAL") for p, s in expected]


def test_escalations_and_reports_disable_tables(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("2024-01-01T00:00:09Z EXTRACT ext01 ABENDED\nREPLICAT rep02 ABENDED\n")
    reports = small_table(
        spark,
        [("EXT01", 0, 1, "OGG-01028 no key"), ("EXT01", 0, 2, "on TABLE hr.emp"), ("REP02", 0, 1, "OGG-00868 timeout TABLE hr.dept")],
        "process_name string, block bigint, row bigint, value string",
    )
    failures = recovery.failure_stream(logs.follow_lines(spark, str(tmp_path / "logs")))
    finish(recovery.quarantine_stream(failures, str(tmp_path / "off"), str(tmp_path / "c1"), lambda: reports))
    rows = spark.read.parquet(str(tmp_path / "off")).collect()
    assert [(r.fqn, r.enabled, r.changed_at) for r in rows] == [("HR.EMP", False, after(9))]
    assert rows[0].reason.startswith("Auto-recovery: OGG-01028")


def test_throughput_stream_emits_closed_windows(spark, log_dir, tmp_path):
    out = monitor.throughput_stream(follow(spark, log_dir), ["op_type"], minutes=30, late="1 minute")
    finish(out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")))
    got = {(r.window_start, r.op_type): r.rows for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    log = spark.read.parquet(log_dir).withColumn("op_ts", F.col("op_ts").cast("timestamp"))
    whole = {(r.w.start, r.op_type): r["count"] for r in log.groupBy(F.window("op_ts", "30 minutes").alias("w"), "op_type").count().collect()}
    assert got and all(whole[key] == n for key, n in got.items())
    assert max(key[0] for key in got) < max(key[0] for key in whole)


def test_heartbeat_stream(spark, tmp_path):
    rows = [("p", after(0)), ("p", after(250)), ("q", after(10))]
    small_table(spark, rows, "path string, incoming_heartbeat_ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    beats = changelog.follow_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    lag = monitor.heartbeat_lag_stream(beats, ["path"], F.lit(after(320)).cast("timestamp"))
    query = finish(lag.writeStream.outputMode("update").format("memory").queryName("beats_out").option("checkpointLocation", str(tmp_path / "c")))
    assert query.exception() is None
    assert {(r.path, r.lag_seconds, r.lag_status) for r in spark.table("beats_out").collect()} == {("p", 70, "WARNING"), ("q", 310, "CRITICAL")}


def test_long_transaction_stream(spark, tmp_path):
    batches = [
        [("slow", after(0), False), ("quick", after(1), False), ("quick", after(5), True)],
        [("other", after(1500), False)],
        [("other", after(1700), True)],
        [("slow", after(1710), True)],
        [("slow", after(1700), False)],
        [("last", after(4000), False)],
    ]
    for rows in batches:
        small_table(spark, rows, "txn string, ts timestamp_ntz, closes boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = changelog.follow_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    out = monitor.long_transaction_stream(stream, limit_seconds=900, late="1 second")
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")))
    alerts = spark.read.parquet(str(tmp_path / "o")).collect()
    assert {r.txn for r in alerts} == {"slow"}
    # The row of 1700 came after the closing one of 1710 and opens nothing.
    assert all(r.opened_at == T0 and 900 < r.open_seconds <= 1710 for r in alerts)


def test_failures_are_quarantined_and_routing_stops(spark, log_dir, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text(
        "2024-01-01T00:00:00Z ERROR OGG-01028 no key TABLE s.t1 EXTRACT ext01 ABENDED\n\nREPLICAT rep01 OGG-00868 ABENDED on TABLE s.t2\nabended, no name\n"
    )
    failures = recovery.failure_stream(logs.follow_lines(spark, str(tmp_path / "logs")))
    finish(recovery.quarantine_stream(failures, str(tmp_path / "overrides"), str(tmp_path / "c1")))
    finish(stream_alerts(failures.select("process_name", "error_class"), str(tmp_path / "alerts"), str(tmp_path / "c2")))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "alerts")).select("process_name", "error_class").collect()} == {("EXT01", "PERMANENT"), ("REP01", "TRANSIENT")}

    overrides = lambda: spark.read.parquet(str(tmp_path / "overrides")).drop("run", "batch")
    assert [r.fqn for r in overrides().collect()] == ["S.T1"]
    inventory = small_table(spark, [("S", "T1", 1, "both", "", "", True, "", ""), ("S", "T2", 1, "rds", "", "M", True, "", "")],
                            "schema string, table_name string, group_id int, target string, target_schema string, rds_target_schema string, "
                            "enabled boolean, disabled_reason string, disabled_at string")
    stream = follow(spark, log_dir).withColumn("fqn", F.concat(F.lit("S.T"), (F.col("k") % 2 + 1).cast("string")))
    finish(ingest.routed_stream(stream, lambda: routes.normalise_routes(inventory), overrides, str(tmp_path / "out"), str(tmp_path / "c3")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.target, r.target_schema, r.table_name) for r in out.select("target", "target_schema", "table_name").distinct().collect()} == {("rds", "M", "T2")}
    assert out.count() == spark.read.parquet(log_dir).where("k % 2 = 1").count()


def test_mirror_takes_changes_of_a_new_checkpoint(spark, tmp_path):
    frame = lambda *rows: small_table(spark, [(k, s, after(s), op, int(op == "D"), f"{op}{s}") for k, s, op in rows], SCHEMA)
    log = str(tmp_path / "log")
    mirror = Mirror(spark, str(tmp_path / "m"), ["k"], frame((1, 1, "I")).schema)
    for i, rows in enumerate([[(1, 1, "I"), (2, 2, "I")], [(1, 3, "U")]]):
        frame(*rows).write.mode("append").parquet(log)
        finish(ingest.mirror_stream(follow(spark, log), mirror, str(tmp_path / "c1")))
    frame((9, 9, "I")).write.mode("append").parquet(log)
    finish(ingest.mirror_stream(follow(spark, log), mirror, str(tmp_path / "c2")))
    assert current(mirror.state()) == [(1, 3, "U3"), (2, 2, "I2"), (9, 9, "I9")]


def test_streams_read_tables_stored_as_folders(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert streams.stream_append_all(spark, str(tmp_path)).count() == rows.count() > 0
