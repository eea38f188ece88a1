"""Ordered streams keep the rows of many keys as columns: calls to the state store grow with buckets and slots, not with keys."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import retry
from tidelog.plans import streams
from tidelog.sources import changelog
from tidelog.streaming import inorder, monitor, recovery

T0 = datetime.datetime(2024, 1, 1)
KEYS = [None, *(f"k{i}" for i in range(1499))]
DAY = 86_400


def after(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def batched(spark, folder, rows, schema):
    """Three batches in no order of time and a row that moves the watermark to the 30th day."""
    rows = random.Random(5).sample(rows, len(rows))
    closing = (None, after(40 * DAY), *[None] * (len(schema.split(",")) - 2))
    for part in (rows[::3], rows[1::3], rows[2::3], [closing]):
        small_table(spark, part, schema).coalesce(1).write.mode("append").parquet(folder)
    return changelog.follow_log(spark, folder, spark.read.parquet(folder).schema, 1)


def run(writer, checkpoint):
    """Runs to the end; the rows of the state store must be fewer than the keys."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    stored = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert 0 < stored < len(KEYS)


def collected(spark, out, tmp_path):
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


@pytest.fixture
def few_buckets(monkeypatch):
    plain = inorder.in_order
    for module in (monitor, recovery):
        monkeypatch.setattr(module, "in_order", lambda *args: plain(*args, buckets=16))


def test_many_open_transactions(spark, tmp_path, few_buckets):
    rng = random.Random(1)
    rows = [(k, after(rng.randrange(DAY)), i * 10 + j, rng.random() < 0.3) for i, k in enumerate(KEYS) for j in range(4)]
    expected = []
    for i, k in enumerate(KEYS):
        mine = sorted((r[1], r[2], r[3]) for r in rows[4 * i : 4 * i + 4])
        last = max((j for j, r in enumerate(mine) if r[2]), default=-1)
        if mine[last + 1 :]:
            opened = mine[last + 1][0]
            expected.append((str(k), opened, 3 - last, int((after(30 * DAY) - opened).total_seconds())))
    stream = batched(spark, str(tmp_path / "in"), rows, "txn string, ts timestamp_ntz, seq bigint, closes boolean")
    out = monitor.long_transaction_stream(stream, 5 * DAY, 300, "10 days", DAY // 2)
    got = [(str(r.txn), r.opened_at, r.changes, r.open_seconds) for r in collected(spark, out, tmp_path).collect()]
    assert sorted(got) == sorted(expected) and len(expected) > 1000


def test_a_transaction_closed_after_its_limit_is_reported_once(spark, tmp_path, few_buckets):
    """Also where the watermark passes the opening, the limit and the close at once, and a slot has no rows."""
    rows = [("late", after(0), 1, False), ("late", after(9 * DAY), 2, True), ("late", after(9 * DAY + 5), 3, False), ("quick", after(0), 4, False), ("quick", after(2 * DAY), 5, True)]
    stream = batched(spark, str(tmp_path / "in"), [*rows, *((k, after(0), 0, True) for k in KEYS)], "txn string, ts timestamp_ntz, seq bigint, closes boolean")
    out = monitor.long_transaction_stream(stream, 5 * DAY, 300, "10 days", DAY)
    got = sorted((r.txn, r.opened_at, r.changes, r.open_seconds) for r in collected(spark, out, tmp_path).collect())
    assert got == [("late", after(0), 1, 30 * DAY), ("late", after(9 * DAY + 5), 1, 21 * DAY - 5)]


def test_many_silent_paths(spark, tmp_path, few_buckets):
    rng = random.Random(2)
    beats = {k: sorted(rng.randrange(9 * DAY) for _ in range(3)) for k in KEYS}
    beats["k7"] = [0, DAY, 2 * DAY]  # a beat at the limit ends no silence
    expected = [(str(k), after(a), after(a + DAY)) for k, at in beats.items() for a, b in zip(at, [*at[1:], 10**9]) if b - a > DAY and a + DAY < 30 * DAY]
    stream = batched(spark, str(tmp_path / "in"), [(k, after(s)) for k, at in beats.items() for s in at], "path string, incoming_heartbeat_ts timestamp_ntz")
    out = monitor.silent_path_stream(stream, "path", limit_seconds=DAY, late="10 days", slot_seconds=3 * DAY)
    got = [(str(r.path), r.last_beat, r.due) for r in collected(spark, out, tmp_path).collect()]
    assert sorted(got) == sorted(expected) and len(expected) > 1500


RETRY_ROWS = "process_name string, ts timestamp_ntz, seq bigint, failed boolean"


def outcomes():
    rng = random.Random(3)
    return [(k, after(rng.randrange(2 * DAY)), i * 20 + j, rng.random() < 0.9) for i, k in enumerate(KEYS) for j in range(10)]


def test_many_retries(spark, tmp_path, few_buckets):
    rows = outcomes()
    stream = batched(spark, str(tmp_path / "in"), rows, RETRY_ROWS)
    got = collected(spark, recovery.retry_stream(stream, late="10 days", slot_seconds=DAY // 2), tmp_path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = retry.retry_plan(small_table(spark, rows, RETRY_ROWS), ["process_name"], ["ts", "seq"], F.col("failed"), ~F.col("failed"))
    columns = ["process_name", "ts", "seq", "event_type", "attempt", "delay_seconds"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_many_escalations(spark, tmp_path, few_buckets):
    rows = outcomes()
    decisions = recovery.retry_stream(batched(spark, str(tmp_path / "in"), rows, RETRY_ROWS), late="10 days", slot_seconds=DAY // 2)
    failures = small_table(spark, [(k, seq, "OGG-1", f"S.T{seq}") for k, _, seq, failed in rows if failed], "process_name string, seq bigint, error_code string, failing_table string")
    run(recovery.escalation_stream(decisions, lambda: failures, str(tmp_path / "off"), str(tmp_path / "c")), str(tmp_path / "c"))
    batch = retry.retry_plan(small_table(spark, rows, RETRY_ROWS), ["process_name"], ["ts", "seq"], F.col("failed"), ~F.col("failed"))
    expected = {f"S.T{r.seq}" for r in batch.where("event_type = 'ESCALATED' AND process_name IS NOT NULL").collect()}
    assert {r.fqn for r in spark.read.parquet(str(tmp_path / "off")).collect()} == expected != set()


def test_failures_in_a_row_of_several_processes():
    rng = np.random.default_rng(4)
    failed, starts, before = rng.random(300) < 0.8, np.array([0, 1, 5, 6, 120, 299]), np.array([5, 0, 3, 1, 4, 2])
    expected, n = [], 0
    for i, f in enumerate(failed):
        n = before[list(starts).index(i)] if i in starts else n
        n = n + 1 if f else 0
        expected.append(n)
    assert recovery.failures_in_row(failed, starts, before).tolist() == expected


def test_batches_of_several_files_hold_every_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_BYTES", 300)
    rows = spark.range(1000).withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    stream = streams.micro_batches(spark, rows, str(tmp_path), streams.closing(rows, "ts", "2024-01-01 00:00:00"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(counts) == streams.BATCHES + 1 and counts[-1] == 1 and sum(counts) == 1001
    assert len(list(tmp_path.glob("in-*/*.parquet"))) > streams.BATCHES + 1
    assert spark.read.parquet(str(tmp_path / "out")).where("id IS NOT NULL").distinct().count() == 1000
