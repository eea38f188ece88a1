"""Streaming plans: run over a table to the end, they equal the batch result."""

from __future__ import annotations

import datetime
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators.changelog import replay_groups, subscribe
from tidelog.operators.ordered import estimated_bytes
from tidelog.operators.state import latest_change
from tidelog.plans.base import LOG_SQL, Registry, event_log, table
from tidelog.plans.cdc import LOG_COLUMNS, ROUTES_SQL, STATE_SQL, route_table
from tidelog.plans.telemetry import EVENTS_SQL, LAG_SQL, NOW, RETRY_SQL, THROUGHPUT_SQL, _lines, _rule_sql
from tidelog.sinks.mirror import Mirror
from tidelog.sinks.reports import stream_alerts
from tidelog.session import scratch_dir
from tidelog.sources.changelog import follow_log
from tidelog.streaming import ingest, monitor, recovery

REGISTRY = Registry()
query = REGISTRY.add


def workspace(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


# The registered streams run over so many micro-batches at least.
BATCHES = 5
# A batch has a file for so many bytes of the table, since a file is read by one task.
FILE_BYTES = 4 << 20
# A last row moves the watermark to its time less this, beyond which no row of the tables lies.
LATE, LATE_DAYS = "400 days", 400


def micro_batches(spark: SparkSession, rows: DataFrame, home: str, last: DataFrame | None = None) -> DataFrame:
    """Rows as a stream of several batches in no order of time, each of one file or more; ``last`` comes in a batch of its own."""
    folder = f"{home}/in-{uuid.uuid4().hex}"
    files = max(1, math.ceil(estimated_bytes(rows) / (BATCHES * FILE_BYTES)))
    rows.repartition(BATCHES * files).write.parquet(folder)
    if last is not None:
        last.select(*rows.columns).coalesce(1).write.mode("append").parquet(folder)
    return follow_log(spark, folder, rows.schema, files)


def stream_of(spark: SparkSession, sf_dir: str, name: str, home: str) -> DataFrame:
    """A table as a stream of several batches: the files of its folder, or files made of the few it has."""
    rows = table(spark, sf_dir, name)
    files = len(rows.inputFiles())
    if files < BATCHES:
        return micro_batches(spark, rows, home)
    return follow_log(spark, f"{sf_dir}/{name}.parquet", rows.schema, math.ceil(files / BATCHES))


def closing(rows: DataFrame, ts: str, watermark: str) -> DataFrame:
    """A row that moves the watermark of a stream of ``rows`` to a time. All but the time is null."""
    at = F.to_timestamp_ntz(F.lit(watermark)) + F.make_interval(days=F.lit(LATE_DAYS))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}
    return rows.sparkSession.range(1).select(*[(at if n == ts else c).alias(n) for n, c in empty.items()])


def _event_stream(spark: SparkSession, sf_dir: str, home: str, watermark: str | None = None) -> DataFrame:
    """``watermark``: where the watermark stands after the last batch, for streams that allow rows to be ``LATE``."""
    if watermark is None:
        return event_log(spark, sf_dir, stream_of(spark, sf_dir, "events", home))
    rows = table(spark, sf_dir, "events")
    return event_log(spark, sf_dir, micro_batches(spark, rows, home, closing(rows, "ts", watermark)))


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written_out(rows: DataFrame, home: str, name: str = "out") -> DataFrame:
    """What a stream appends, from its first batch to its last."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{home}/{name}")
    finish(writer.option("checkpointLocation", f"{home}/{name}-checkpoint"))
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{home}/{name}")


@query("stream_append_all", LOG_SQL + "SELECT k, seq, op_ts, op_type, is_deleted, value FROM log")
def stream_append_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = workspace(spark)
    rows = _event_stream(spark, sf_dir, home).select("k", "seq", "op_ts", "op_type", "is_deleted", "value")
    finish(ingest.append_stream(rows, f"{home}/log", f"{home}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{home}/log").drop("op_date")


@query("stream_mirror", STATE_SQL)
def stream_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several batches with foldings in between."""
    home = workspace(spark)
    rows = _event_stream(spark, sf_dir, home).select(*LOG_COLUMNS, "is_deleted")
    mirror = Mirror(spark, f"{home}/mirror", ["k"], rows.schema)
    finish(ingest.mirror_stream(rows, mirror, f"{home}/checkpoint"))
    return mirror.state().select(*LOG_COLUMNS)


@query("stream_throughput", THROUGHPUT_SQL)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are given out once, when the watermark has passed them."""
    home = workspace(spark)
    out = monitor.throughput_stream(_event_stream(spark, sf_dir, home, "2100-01-01 00:00:00"), ["event_type"], 30, late=LATE)
    return written_out(out, home).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_heartbeat_lag", LAG_SQL)
def stream_heartbeat_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch gives out the paths it has changed; the newest row of a path counts."""
    home = workspace(spark)
    now = F.to_timestamp_ntz(F.lit(NOW)).cast("timestamp")
    beats = _event_stream(spark, sf_dir, home).select("k", "op_ts")
    lag = monitor.heartbeat_lag_stream(beats, ["k"], now, "op_ts", LATE, scale=(5000, 20000, "WARNING"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(ingest.batch_folder(batch, batch_id, f"{home}/out", f"{home}/checkpoint"))

    finish(lag.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint"))
    given = spark.read.schema(lag.schema).parquet(f"{home}/out")
    return latest_change(given, ["k"], ["op_ts"]).select("k", F.col("op_ts").cast("timestamp_ntz").alias("op_ts"), "lag_seconds", "lag_status")


SILENT_SQL = LOG_SQL + """, b AS (SELECT k, op_ts, op_ts + INTERVAL 1 DAY AS due, lead(op_ts) OVER (PARTITION BY k ORDER BY op_ts, seq) AS beat FROM log)
SELECT CAST(k AS VARCHAR) AS path, op_ts AS last_beat, due, 'CRITICAL' AS severity FROM b
WHERE beat > due OR (beat IS NULL AND date_trunc('day', due) + INTERVAL 1 DAY < TIMESTAMP '2024-01-31 12:00:00')"""


@query("stream_silent_paths", SILENT_SQL)
def stream_silent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as paths: who is silent for a day, also at the end, is reported by a timer."""
    home = workspace(spark)
    beats = _event_stream(spark, sf_dir, home, "2024-01-31 12:00:00")
    out = written_out(monitor.silent_path_stream(beats, "k", "op_ts", 86_400, LATE, 86_400), home)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_beat", "due")})


OPEN_SQL = LOG_SQL + """, c AS (SELECT k, max((op_ts, seq)) FILTER (event_type = 'purchase') AS closed FROM log GROUP BY k),
o AS (SELECT CAST(k AS VARCHAR) AS txn, min(op_ts) AS opened_at, count(*) AS changes FROM log JOIN c USING (k) WHERE closed IS NULL OR (op_ts, seq) > closed GROUP BY k)
SELECT *, (epoch_us(TIMESTAMP '2024-12-01') - epoch_us(opened_at)) // 1000000 AS open_seconds FROM o"""


@query("stream_long_open", OPEN_SQL)
def stream_long_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as transactions that a purchase closes; who then does anything and buys nothing in 40 days has one alert."""
    home = workspace(spark)
    rows = _event_stream(spark, sf_dir, home, "2024-12-01 00:00:00")
    changes = rows.select(F.col("k").alias("txn"), F.col("op_ts").alias("ts"), "seq", (F.col("event_type") == "purchase").alias("closes"))
    out = written_out(monitor.long_transaction_stream(changes, 40 * 86_400, 300, LATE, 86_400), home)
    return out.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))


@query(
    "stream_failures",
    EVENTS_SQL
    + f""", c AS (SELECT *, {_rule_sql('value')} AS hit FROM found WHERE process_name IS NOT NULL)
    SELECT row, process_name, regexp_extract_all(value, '(OGG-[0-9]+)', 1)[-1] AS error_code,
      upper(regexp_extract_all(value, '(?i)(?:TABLE|MAP)\\s+(\\w+\\.\\w+)', 1)[-1]) AS failing_table,
      split_part(hit, '|', 1) AS error_class, split_part(hit, '|', 2) AS error_pattern FROM c""",
)
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = workspace(spark)
    lines = _lines(spark, sf_dir, stream_of(spark, sf_dir, "events", home))
    columns = ["row", "process_name", "error_code", "failing_table", "error_class", "error_pattern"]
    failures = recovery.failure_stream(lines).select(*columns)
    finish(stream_alerts(failures, f"{home}/alerts", f"{home}/checkpoint"))
    return spark.read.schema(failures.schema).json(f"{home}/alerts")


@query(
    "stream_routed",
    LOG_SQL
    + ROUTES_SQL
    + """SELECT target, target_schema, table_name, count(*) AS changes FROM log JOIN routes ON upper(event_type) = table_name
    WHERE table_name <> 'VIEW' GROUP BY ALL""",
)
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table is quarantined by an override while the stream runs."""
    home = workspace(spark)
    changes = _event_stream(spark, sf_dir, home).select("seq", "k", F.concat(F.lit("APP."), F.upper("event_type")).alias("fqn"))
    plain = route_table(spark).withColumns({"disabled_reason": F.lit(""), "disabled_at": F.lit("")})
    off = small_table(
        spark, [("APP.VIEW", False, "failing", datetime.datetime(2024, 1, 1))], "fqn string, enabled boolean, reason string, changed_at timestamp_ntz"
    )
    finish(ingest.routed_stream(changes, lambda: plain, lambda: off, f"{home}/routed", f"{home}/checkpoint"))
    routed = spark.read.parquet(f"{home}/routed")
    return routed.groupBy("target", "target_schema", "table_name").agg(F.count(F.lit(1)).alias("changes"))


def _decisions(spark: SparkSession, sf_dir: str, home: str) -> DataFrame:
    """Retry decisions on the events of users as processes."""
    rows = _event_stream(spark, sf_dir, home, "2024-03-01 00:00:00").where("event_type IN ('error', 'purchase') OR event_type IS NULL")
    outcomes = rows.select(
        F.col("k").cast("string").alias("process_name"), F.col("op_ts").alias("ts"), "seq", (F.col("event_type") == "error").alias("failed")
    )
    return recovery.retry_stream(outcomes, late=LATE, slot_seconds=2 * 86_400)


STREAM_RETRY_SQL = RETRY_SQL.replace("SELECT k, seq,", "SELECT CAST(k AS VARCHAR) AS k, seq,")


@query("stream_retry", STREAM_RETRY_SQL)
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows come in no order of time; decisions are made in that order."""
    home = workspace(spark)
    return written_out(_decisions(spark, sf_dir, home), home).select(F.col("process_name").alias("k"), "seq", "event_type", "attempt", "delay_seconds")


@query(
    "stream_quarantine",
    RETRY_SQL.replace("SELECT k, seq, CASE WHEN place", ", d AS (SELECT k, seq, CASE WHEN place")
    + """)
    SELECT 'APP.T' || (d.seq % 9) AS fqn, false AS enabled, 'Auto-recovery: OGG-' || (d.seq % 4) || ' retries used up' AS reason, e.ts AS changed_at
    FROM d JOIN events e ON e.event_id = d.seq WHERE d.event_type = 'ESCALATED' AND d.seq % 3 = 0""",
)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who fails after the last retry has its table disabled; every third failure names one."""
    home = workspace(spark)
    failures = lambda: table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("process_name"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("OGG-"), (F.col("event_id") % 4).cast("string")).alias("error_code"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("APP.T"), (F.col("event_id") % 9).cast("string"))).alias("failing_table"),
    )
    finish(recovery.escalation_stream(_decisions(spark, sf_dir, home), failures, f"{home}/overrides", f"{home}/checkpoint"))
    off = spark.read.parquet(f"{home}/overrides").drop("run", "batch")
    return off.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query(
    "stream_resume",
    LOG_SQL + "SELECT consumer, k, seq, op_type, CAST(consumer = 'stopped' AND seq % 2 = 1 AS BOOLEAN) AS after_stop FROM log, (VALUES ('stopped'), ('later')) t(consumer)",
)
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consumer stops and resumes from its checkpoint after more changes came; another starts then, with its own."""
    home = workspace(spark)
    log = event_log(spark, sf_dir).select("k", "seq", "op_type")
    columns = {"consumer": F.lit("stopped"), "after_stop": F.lit(False)}

    def consume(consumer: str, after_stop: bool) -> None:
        rows = follow_log(spark, f"{home}/log", log.schema, 2).withColumns({"consumer": F.lit(consumer), "after_stop": F.lit(after_stop)})
        writer = rows.writeStream.format("parquet").option("path", f"{home}/{consumer}")
        finish(writer.option("checkpointLocation", f"{home}/{consumer}-checkpoint"))

    log.where("seq % 2 = 0").repartition(BATCHES).write.parquet(f"{home}/log")
    consume("stopped", False)
    log.where("seq % 2 = 1").repartition(BATCHES).write.mode("append").parquet(f"{home}/log")
    consume("stopped", True)
    consume("later", False)
    schema = log.withColumns(columns).schema
    return spark.read.schema(schema).parquet(f"{home}/stopped", f"{home}/later").select("consumer", "k", "seq", "op_type", "after_stop")


@query(
    "stream_replay_from",
    LOG_SQL + """, mid AS (SELECT (min(seq) + max(seq)) // 2 AS seq FROM log)
    SELECT event_type AS group_name, k, log.seq, op_type FROM log, mid WHERE (event_type = 'click' AND log.seq >= 100)
       OR (event_type IN ('view', 'error') AND log.seq > mid.seq)""",
)
def stream_replay_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups subscribe to a log that has changes already: one from a position, two from now, others not at all."""
    home = workspace(spark)
    log = event_log(spark, sf_dir).select(F.col("event_type").alias("group_name"), "k", "seq", "op_type")
    mid = log.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    log.where(F.col("seq") <= mid).repartition(BATCHES).write.parquet(f"{home}/log")
    groups = small_table(spark, [("click", 100), ("view", None), ("error", None)], "group_name string, start_seq bigint")
    subscribed = subscribe(groups, spark.read.schema(log.schema).parquet(f"{home}/log"), "group_name")
    subscribed.write.parquet(f"{home}/subscriptions")
    log.where(F.col("seq") > mid).repartition(BATCHES).write.mode("append").parquet(f"{home}/log")
    starts = spark.read.schema(subscribed.schema).parquet(f"{home}/subscriptions")
    return written_out(replay_groups(follow_log(spark, f"{home}/log", log.schema, 2), starts, "group_name"), home)
