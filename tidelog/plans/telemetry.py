"""Telemetry, log-line, retry and inventory plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import rules, status, text
from tidelog.operators import loglines, recon, retry, routes, telemetry
from tidelog.operators.ordered import SkewGuard, shared_checkpoint
from tidelog.plans.base import LOG_SQL, Registry, event_log, table
from tidelog.sinks.archive import due_for_archive
from tidelog.sources.inventory import parse_inventory

REGISTRY = Registry()
query = REGISTRY.add

# -- lag and throughput -------------------------------------------------------

NOW = "2024-01-31 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


LAG_WORDS = "CASE WHEN {s} > {c} THEN 'CRITICAL' WHEN {s} > {w} THEN '{word}' ELSE 'OK' END"
# Whole seconds between two times, fractions cut off as TIMESTAMPDIFF does.
SECONDS = "(epoch_us({b}) - epoch_us({a})) // 1000000"


LAG_SQL = (
    LOG_SQL
    + f""", last AS (SELECT k, max(op_ts) AS op_ts FROM log GROUP BY k),
    lag AS (SELECT *, {SECONDS.format(a='op_ts', b=f"TIMESTAMP '{NOW}'")} AS lag_seconds FROM last)
    SELECT *, {LAG_WORDS.format(s='lag_seconds', c=20000, w=5000, word='WARNING')} AS lag_status FROM lag"""
)


@query("lag_status", LAG_SQL)
def lag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.heartbeat_lag(event_log(spark, sf_dir), ["k"], _now(), "op_ts", (5000, 20000, "WARNING"))


GAPS_SQL = (
    LOG_SQL
    + f""", pairs AS (SELECT k, seq, op_ts, lag(op_ts) OVER (PARTITION BY k ORDER BY op_ts, seq) AS before FROM log),
    gaps AS (SELECT k, seq, {SECONDS.format(a='before', b='op_ts')} AS gap_seconds FROM pairs)
    SELECT *, {LAG_WORDS.format(s='gap_seconds', c=1800, w=300, word='WARN')} AS gap_status FROM gaps"""
)


@query("gap_status", GAPS_SQL)
def gap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.gaps(event_log(spark, sf_dir), ["k"], "op_ts", "seq", status.MONITOR_LAG)
    return rows.select("k", "seq", "gap_seconds", "gap_status")


@query("heartbeats_retained", LOG_SQL + f"SELECT k, seq FROM log WHERE op_ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def heartbeats_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.retained(event_log(spark, sf_dir), _now(), 24, "op_ts").select("k", "seq")


THROUGHPUT_SQL = (
    LOG_SQL
    + """SELECT time_bucket(INTERVAL 30 MINUTE, op_ts) AS window_start, event_type, count(*) AS rows,
    count(*) / CAST(1800 AS DOUBLE) AS rows_per_second FROM log GROUP BY ALL"""
)


@query("throughput_30m", THROUGHPUT_SQL)
def throughput_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.throughput(event_log(spark, sf_dir), ["event_type"], 30)


@query(
    "throughput_1m",
    LOG_SQL + "SELECT date_trunc('minute', op_ts) AS window_start, count(*) AS rows, count(*) / CAST(60 AS DOUBLE) AS rows_per_second FROM log GROUP BY ALL",
)
def throughput_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.throughput(event_log(spark, sf_dir), [], 1)


@query(
    "long_open",
    """WITH log AS (SELECT o_orderkey AS txn, o_orderdate AS moment, false AS closes FROM orders
      UNION ALL SELECT l_orderkey, l_shipdate, l_linestatus = 'F' FROM lineitem),
    spans AS (SELECT txn, min(moment) AS opened_at, max(moment) FILTER (WHERE closes) AS closed_at, count(*) AS changes FROM log GROUP BY txn),
    aged AS (SELECT *, (epoch_us(coalesce(closed_at, TIMESTAMP '2003-01-01')) - epoch_us(opened_at)) // 1000000 AS open_seconds FROM spans)
    SELECT * FROM aged WHERE open_seconds > 31536000""",
)
def long_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, lines as their changes; a final line closes one."""
    opened = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn"), F.col("o_orderdate").alias("at"), F.lit(False).alias("closes")
    )
    changed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("txn"), F.col("l_shipdate").alias("at"), (F.col("l_linestatus") == "F").alias("closes")
    )
    now = F.to_timestamp_ntz(F.lit("2003-01-01 00:00:00"))
    return telemetry.long_transactions(opened.unionByName(changed), ["txn"], "at", F.col("closes"), now, 365 * 86400)


# -- files: events play trail files --------------------------------------------

# One file per event; the file stays listed on its day and the two days after.
FILES_SQL = """WITH files AS (
  SELECT event_id, 'd' || user_id % 3 AS dir, CASE event_type WHEN 'click' THEN 'e1' WHEN 'view' THEN 'e2' WHEN 'purchase' THEN 'p1' ELSE 'r1' END AS prefix,
    event_id % 1000000000 AS sequence, CAST(round(value * 1048576) AS BIGINT) AS size_bytes, ts AS mtime, date_trunc('day', ts) AS day
  FROM events WHERE event_type <> 'error'),
listing AS (SELECT *, day + CAST(d AS INTEGER) * INTERVAL 1 DAY AS snapshot_ts FROM files, range(0, 3) r(d)),
stats AS (SELECT snapshot_ts, dir, prefix, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(sequence) AS newest_seq,
    min(sequence) AS oldest_seq, max(mtime) AS newest_mtime, min(mtime) AS oldest_mtime FROM listing GROUP BY ALL)
"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "e1", "view": "e2", "purchase": "p1", "signup": "r1"}
    prefix = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("junk"))
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    stays = F.explode(F.array(*[F.lit(d) for d in range(3)]))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dir"),
        F.concat(prefix, F.lpad((F.col("event_id") % 1_000_000_000).cast("string"), 9, "0")).alias("name"),
        F.round(F.col("value") * 1048576).cast("bigint").alias("size_bytes"),
        F.col("ts").alias("mtime"),
        day.alias("day"),
        stays.alias("d"),
    ).withColumn("snapshot_ts", F.col("day") + F.make_interval(days=F.col("d"))).drop("day", "d")


@query(
    "file_stats",
    FILES_SQL
    + """SELECT snapshot_ts, dir, prefix, files, total_bytes, newest_seq, oldest_seq, newest_mtime, oldest_mtime,
    total_bytes / CAST(1048576 AS DOUBLE) AS total_mb, total_bytes / CAST(1073741824 AS DOUBLE) AS total_gb, newest_seq - oldest_seq AS backlog FROM stats""",
)
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.prefix_stats(telemetry.parse_listing(_listing(spark, sf_dir)))


@query(
    "file_stats_by_directory",
    FILES_SQL
    + """SELECT snapshot_ts, dir, prefix, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(sequence) - min(sequence) AS backlog
    FROM listing GROUP BY GROUPING SETS ((snapshot_ts, dir, prefix), (snapshot_ts, dir))""",
)
def file_stats_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.directory_stats(telemetry.parse_listing(_listing(spark, sf_dir)))
    return rows.select("snapshot_ts", "dir", "prefix", "files", "total_bytes", "backlog")


RATES_SQL = FILES_SQL + """, scans AS (SELECT dir, snapshot_ts, lag(snapshot_ts) OVER (PARTITION BY dir ORDER BY snapshot_ts) AS prev_scan
    FROM (SELECT DISTINCT dir, snapshot_ts FROM listing)),
moves AS (SELECT *, total_bytes - lag(total_bytes) OVER w AS moved, lag(newest_seq) OVER w AS prev_seq, lag(snapshot_ts) OVER w AS prev_ts
  FROM stats WINDOW w AS (PARTITION BY dir, prefix ORDER BY snapshot_ts)),
sums AS (SELECT s.dir, s.snapshot_ts, epoch(s.snapshot_ts) - epoch(prev_scan) AS sec,
    coalesce(sum(greatest(moved, 0)) FILTER (prev_ts = prev_scan), 0) AS grown,
    coalesce(sum(greatest(-moved, 0)) FILTER (prev_ts = prev_scan AND newest_seq >= prev_seq), 0) AS used,
    sum(total_bytes) / CAST(1048576 AS DOUBLE) AS total_mb
  FROM scans s LEFT JOIN moves m ON s.dir = m.dir AND s.snapshot_ts = m.snapshot_ts GROUP BY s.dir, s.snapshot_ts, prev_scan),
rates AS (SELECT dir, snapshot_ts, total_mb, CASE WHEN sec >= 1 THEN grown / 1048576.0 / (sec / 60) ELSE 0 END AS g,
    CASE WHEN sec >= 1 THEN used / 1048576.0 / (sec / 60) ELSE 0 END AS c FROM sums)
"""


def _rates(spark: SparkSession, sf_dir: str, guard: SkewGuard = SkewGuard()) -> DataFrame:
    # A few rows per scan, used by several steps: the listing is read once.
    stats = shared_checkpoint(telemetry.prefix_stats(telemetry.parse_listing(_listing(spark, sf_dir))))
    rates = telemetry.file_rates(stats, stats.select("dir", "snapshot_ts"), guard=guard)
    totals = stats.groupBy("dir", "snapshot_ts").agg(F.sum("total_mb").alias("total_mb"))
    return rates.join(totals, ["dir", "snapshot_ts"])


RATES_OUT_SQL = RATES_SQL + "SELECT dir, snapshot_ts, round(g, 6) AS growth_mb_min, round(c, 6) AS consumed_mb_min FROM rates"


@query("file_rates", RATES_OUT_SQL)
def file_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select(
        "dir", "snapshot_ts", F.round("growth_mb_min", 6).alias("growth_mb_min"), F.round("consumed_mb_min", 6).alias("consumed_mb_min")
    )


@query(
    "file_forecast",
    RATES_SQL
    + """SELECT dir, snapshot_ts, round(CASE WHEN g > 0 THEN 2000 / g / 60 END, 4) AS hours_to_fill,
    round(CASE WHEN c > g AND total_mb > 0 THEN total_mb / (c - g) / 60 END, 4) AS hours_to_catch_up,
    CASE WHEN g > c THEN 'GROWING' WHEN c > g THEN 'DRAINING' ELSE 'STABLE' END AS trend FROM rates""",
)
def file_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.forecast(_rates(spark, sf_dir).withColumn("free_mb", F.lit(2000.0)))
    return out.select(
        "dir", "snapshot_ts", F.round("hours_to_fill", 4).alias("hours_to_fill"),
        F.round("hours_to_catch_up", 4).alias("hours_to_catch_up"), "trend",
    )


@query(
    "file_alerts",
    RATES_SQL
    + """, rep AS (SELECT *, dir <> 'd2' AS here, CASE WHEN g > 0 THEN 2000 / g / 60 END AS fill FROM rates)
    SELECT dir, snapshot_ts, 'WARN' AS severity, 'MISSING_DIRECTORY' AS alert FROM rep WHERE NOT here
    UNION ALL SELECT dir, snapshot_ts, 'WARN', 'TOTAL_SIZE' FROM rep WHERE here AND total_mb / 1024 > 2
    UNION ALL SELECT dir, snapshot_ts, 'WARN', 'GROWTH_RATE' FROM rep WHERE here AND g > 0.5
    UNION ALL SELECT dir, snapshot_ts, 'CRITICAL', 'DISK_USAGE' FROM rep WHERE here AND dir = 'd1'
    UNION ALL SELECT dir, snapshot_ts, 'CRITICAL', 'DISK_FILLING' FROM rep WHERE here AND fill < 72""",
)
def file_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = telemetry.forecast(_rates(spark, sf_dir).withColumn("free_mb", F.lit(2000.0))).withColumns(
        {
            "exists": F.col("dir") != "d2",
            "total_gb": F.col("total_mb") / 1024,
            "disk_pct": F.when(F.col("dir") == "d1", 85.0).otherwise(80.0),
        }
    )
    return telemetry.alerts(report, total_gb=2, growth=0.5, fill_hours=72).select("dir", "snapshot_ts", "severity", "alert")


@query(
    "file_health",
    FILES_SQL
    + """, aged AS (SELECT snapshot_ts, dir, prefix, CAST(floor((epoch(snapshot_ts + INTERVAL 1 DAY) - floor(epoch(newest_mtime))) / 60) AS BIGINT) AS age_minutes,
      oldest_seq % 100 AS pct FROM stats)
    SELECT snapshot_ts, dir, prefix, age_minutes, CASE WHEN age_minutes > 30 THEN 'STALE' WHEN age_minutes > 5 THEN 'IDLE' ELSE 'ACTIVE' END AS freshness,
    CASE WHEN pct > 90 THEN 'FAIL' WHEN pct > 75 THEN 'WARN' ELSE 'OK' END AS disk FROM aged""",
)
def file_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = telemetry.prefix_stats(telemetry.parse_listing(_listing(spark, sf_dir))).withColumn("disk_pct", F.col("oldest_seq") % 100)
    rated = telemetry.file_health(stats, F.col("snapshot_ts") + F.make_interval(days=F.lit(1)))
    return rated.select("snapshot_ts", "dir", "prefix", "age_minutes", "freshness", "disk")


# -- log lines: events printed as lines ------------------------------------------

# The code of a line follows from its event id.
CODES = [*rules.PERMANENT_ERRORS, *rules.TRANSIENT_ERRORS]
PRINTED = ["Warehouse WH1 is suspended" if c == "Warehouse .* is suspended" else c for c in CODES] + ["OGG-99999", "all quiet"]
PRINTED_SQL = "[" + ", ".join(f"'{p}'" for p in PRINTED) + "]"
LINES_SQL = f"""WITH lines AS (
  SELECT 'u' || user_id % 7 || '.log' AS file, event_id AS row, ts, event_type, user_id,
    CASE WHEN event_type IN ('error', 'signup') THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' ELSE '  ' END
    || CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'purchase' THEN 'stopped after ' ELSE 'INFO ' END
    || ({PRINTED_SQL})[event_id % {len(PRINTED)} + 1]
    || CASE WHEN event_type = 'error' THEN ' EXTRACT ext' || user_id % 20 || ' ABENDED' ELSE '' END
    || CASE WHEN event_id % 3 = 0 THEN ' on TABLE app.t' || user_id % 9 ELSE '' END AS value
  FROM events)
"""


def _lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    stamp = F.when(kind.isin("error", "signup"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z '")).otherwise("  ")
    word = F.when(kind == "error", "ERROR ").when(kind == "purchase", "stopped after ").otherwise("INFO ")
    code = F.element_at(F.array(*[F.lit(p) for p in PRINTED]), (event % len(PRINTED) + 1).cast("int"))
    process = F.when(kind == "error", F.concat(F.lit(" EXTRACT ext"), (user % 20).cast("string"), F.lit(" ABENDED"))).otherwise("")
    where = F.when(event % 3 == 0, F.concat(F.lit(" on TABLE app.t"), (user % 9).cast("string"))).otherwise("")
    return (events if events is not None else table(spark, sf_dir, "events")).select(
        F.concat(F.lit("u"), (user % 7).cast("string"), F.lit(".log")).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        event.alias("row"),
        "ts",
        "event_type",
        "user_id",
        F.concat(stamp, word, code, process, where).alias("value"),
    )


RECENT_SQL = LINES_SQL + """, stamped AS (
  SELECT *, last_value(CASE WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN value[1:16] END IGNORE NULLS)
    OVER (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING) AS stamp FROM lines),
hits AS (SELECT file, row, value, stamp FROM stamped WHERE stamp >= '2024-01-20T00:00' AND regexp_matches(value, 'ERROR|ABEND|OGG-'))
"""


@query("recent_errors", RECENT_SQL + "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY file ORDER BY row DESC) <= 15")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.recent_errors(_lines(spark, sf_dir), F.lit("2024-01-20T00:00")).select("file", "row", "value", "stamp")


@query("recent_errors_split_files", RECENT_SQL + "SELECT * FROM hits")
def recent_errors_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them, with every file cut into pieces."""
    hits = loglines.recent_errors(_lines(spark, sf_dir), F.lit("2024-01-20T00:00"), None, ["row"], SkewGuard(min_bytes=0, hot_rows=200))
    return hits.select("file", "row", "value", "stamp")


@query("tail_lines", LINES_SQL + "SELECT file, row, value FROM lines QUALIFY row_number() OVER (PARTITION BY file ORDER BY row DESC) <= 50")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.tail_lines(_lines(spark, sf_dir), 50).select("file", "row", "value")


@query(
    "error_window",
    LINES_SQL
    + """, hits AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, row DESC) AS rn FROM lines
      WHERE ts >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 600 MINUTE AND regexp_matches(value, 'ERROR|ABEND|FATAL'))
    SELECT file, count(*) AS errors, string_agg(value, ' ~ ' ORDER BY rn) FILTER (rn <= 3) AS newest, CAST(greatest(count(*) - 3, 0) AS BIGINT) AS left_out
    FROM hits GROUP BY file""",
)
def error_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loglines.error_window(_lines(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-30 20:00:00")), 600)
    return rows.withColumn("newest", F.array_join("newest", " ~ "))


def _rule_sql(column: str) -> str:
    out = "CASE"
    for rule in rules.default_rules():
        hit = f"contains(lower({column}), '{rule.pattern.lower()}')" if rule.literal else f"regexp_matches({column}, '(?i){rule.pattern}')"
        out += f" WHEN {hit} THEN '{rule.error_class}|{rule.label}'"
    return out + f" ELSE 'UNKNOWN|{rules.UNKNOWN_ERROR}' END"


EVENTS_SQL = LINES_SQL + """, found AS (
  SELECT *, upper(nullif(regexp_extract(value, '(?i)(?:EXTRACT|REPLICAT|PUMP)\\s+(\\w+)', 1), '')) AS process_name FROM lines
  WHERE regexp_matches(value, '(?i)(ABEND|PROCESS ABENDING|abended|STOPPED)'))
"""


@query("log_classify", EVENTS_SQL + f", c AS (SELECT *, {_rule_sql('value')} AS hit FROM found) SELECT row, process_name, split_part(hit, '|', 1) AS error_class, split_part(hit, '|', 2) AS error_pattern FROM c")
def log_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = loglines.abend_events(_lines(spark, sf_dir), rules.ABEND_OR_STOP_LINE)
    return loglines.classified(events).select("row", "process_name", "error_class", "error_pattern")


DETAILS_SQL = LINES_SQL + """, tail AS (SELECT 'EXT' || user_id % 20 AS process_name, row, value,
    regexp_extract_all(value, '(OGG-[0-9]+)', 1)[-1] AS code, upper(regexp_extract_all(value, '(?i)(?:TABLE|MAP)\\s+(\\w+\\.\\w+)', 1)[-1]) AS tab
  FROM lines QUALIFY row_number() OVER (PARTITION BY process_name ORDER BY row DESC) <= 80),
codes AS (SELECT process_name, arg_max(code, row) FILTER (code IS NOT NULL) AS error_code, arg_max(tab, row) FILTER (tab IS NOT NULL) AS failing_table,
    string_agg(value, chr(10) ORDER BY row) AS excerpt FROM tail GROUP BY process_name),
messages AS (SELECT process_name, trim(arg_max(value, row)) AS error_message FROM tail JOIN codes USING (process_name)
  WHERE coalesce(contains(value, error_code), false) OR contains(upper(value), 'ERROR') OR contains(upper(value), 'ABEND') GROUP BY process_name),
details AS (SELECT process_name, error_code, error_message, failing_table, excerpt FROM codes LEFT JOIN messages USING (process_name))
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("EXT"), (F.col("user_id") % 20).cast("string"))
    return _lines(spark, sf_dir).select(name.alias("process_name"), "block", "row", "value")


@query("report_details", DETAILS_SQL + "SELECT * FROM details")
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.report_details(_reports(spark, sf_dir), loglines.RECOVERY_TAIL)


AS_OF_SQL = LINES_SQL + f""", found AS (SELECT row, value, upper(regexp_extract(value, '(?i)(?:EXTRACT|REPLICAT|PUMP)\\s+(\\w+)', 1)) AS process_name FROM lines
  WHERE regexp_matches(value, '(?i)(ABEND)')),
numbered AS (SELECT 'EXT' || user_id % 20 AS process_name, row, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY row) AS no FROM lines),
named AS (SELECT f.row AS event, f.value AS line, process_name, n.no AS upto FROM found f JOIN numbered n USING (process_name) WHERE n.row <= f.row AND process_name <> ''
  QUALIFY row_number() OVER (PARTITION BY f.row ORDER BY n.row DESC) = 1),
tail AS (
  SELECT event, line, t.process_name, n.row, n.value, regexp_extract_all(n.value, '(OGG-[0-9]+)', 1)[-1] AS code,
    upper(regexp_extract_all(n.value, '(?i)(?:TABLE|MAP)\\s+(\\w+\\.\\w+)', 1)[-1]) AS tab
  FROM named t JOIN numbered n ON n.process_name = t.process_name AND n.no <= upto AND n.no > upto - 80),
codes AS (
  SELECT event, line, process_name, arg_max(code, row) FILTER (code IS NOT NULL) AS error_code, arg_max(tab, row) FILTER (tab IS NOT NULL) AS failing_table,
    string_agg(value, chr(10) ORDER BY row) AS excerpt FROM tail GROUP BY ALL),
messages AS (SELECT event, trim(arg_max(value, row)) AS error_message FROM tail JOIN codes USING (event)
  WHERE coalesce(contains(value, error_code), false) OR contains(upper(value), 'ERROR') OR contains(upper(value), 'ABEND') GROUP BY event),
texts AS (SELECT *, concat_ws(chr(10), line, excerpt) AS txt FROM codes LEFT JOIN messages USING (event)),
c AS (SELECT *, {_rule_sql('txt')} AS hit FROM texts)
SELECT event AS row, process_name, error_code, failing_table, error_message, split_part(hit, '|', 1) AS error_class, split_part(hit, '|', 2) AS error_pattern FROM c"""


def _enriched(spark: SparkSession, sf_dir: str, guard: SkewGuard) -> DataFrame:
    """Each event with the last 80 report lines up to it: a process that fails twice has two reports."""
    events = loglines.abend_events(_lines(spark, sf_dir)).select("row", "value", "process_name")
    out = loglines.enrich_events_as_of(events, _reports(spark, sf_dir), "row", guard=guard)
    return out.select("row", "process_name", "error_code", "failing_table", "error_message", "error_class", "error_pattern")


@query("event_enrichment", AS_OF_SQL)
def event_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir, SkewGuard())


@query("event_enrichment_split_keys", AS_OF_SQL)
def event_enrichment_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir, SkewGuard(min_bytes=0, hot_rows=100))


STATUS_SQL = """WITH lines AS (
  SELECT event_id AS row, user_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'abended' WHEN 'signup' THEN 'STOPPED' ELSE 'STARTING' END AS s
  FROM events WHERE event_type <> 'view'),
latest AS (SELECT 'EXT' || user_id AS process_name, upper(arg_max(s, row)) AS status FROM lines GROUP BY user_id),
rated AS (SELECT *, CASE status WHEN 'RUNNING' THEN 'OK' WHEN 'ABENDED' THEN 'CRITICAL' WHEN 'STOPPED' THEN 'CRITICAL' ELSE 'WARN' END AS severity FROM latest)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    word = F.when(kind == "click", "RUNNING").when(kind == "error", "abended").when(kind == "signup", "STOPPED").otherwise("STARTING")
    label = F.when(F.col("event_id") % 2 == 0, F.lit("Extract ")).otherwise(F.lit("REPLICAT   "))
    # The short form, without the word Status, exists for three statuses only.
    middle = F.when((F.col("event_id") % 3 == 0) & (kind != "purchase"), "  Last Started 2024-01-15 10:30  ").otherwise(" Last Started   Status ")
    line = F.when(kind == "view", F.lit("MANAGER is up")).otherwise(
        F.concat(label, F.lit("ext"), F.col("user_id").cast("string"), middle, word)
    )
    lines = table(spark, sf_dir, "events").select(F.lit(0).alias("block"), F.col("event_id").alias("row"), line.alias("value"))
    return loglines.process_status(lines)


@query("process_status", STATUS_SQL + "SELECT * FROM rated")
def process_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@query("status_counts", STATUS_SQL + "SELECT status, count(*) AS processes FROM rated GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.status_counts(_statuses(spark, sf_dir))


@query(
    "severity_roll_up",
    STATUS_SQL
    + """SELECT count(*) FILTER (severity = 'OK') AS passed, count(*) FILTER (severity = 'WARN') AS warned, count(*) FILTER (severity = 'CRITICAL') AS failed,
    CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'WARN') > 0 THEN 'WARN' ELSE 'OK' END AS severity FROM rated""",
)
def severity_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.roll_up(_statuses(spark, sf_dir))


@query(
    "lag_lines",
    f"""WITH lags AS (SELECT event_id AS row, 'EXT' || user_id AS process_name, CAST(floor(value * 60) AS BIGINT) AS lag_seconds FROM events)
    SELECT *, {LAG_WORDS.format(s='lag_seconds', c=1800, w=300, word='WARN')} AS severity FROM lags""",
)
def lag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = F.floor(F.col("value") * 60)
    clock = F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row"),
        F.concat(F.lit("EXT"), F.col("user_id").cast("string"), F.lit("  Lag at Chkpt "), clock, F.lit(" (updated)")).alias("value"),
    )
    return loglines.lag_lines(lines).select("row", "process_name", "lag_seconds", "severity")


# -- retry --------------------------------------------------------------------

RETRY_SQL = LOG_SQL + """, f AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY op_ts, seq) AS island
    FROM log WHERE event_type IN ('error', 'purchase')),
n AS (SELECT *, row_number() OVER (PARTITION BY k, island ORDER BY op_ts, seq) AS nth FROM f WHERE event_type = 'error'),
p AS (SELECT *, (nth - 1) % (6) AS place FROM n)
SELECT k, seq, CASE WHEN place < 5 THEN 'TRANSIENT_RETRY' ELSE 'ESCALATED' END AS event_type, CAST(least(place + 1, 5) AS INTEGER) AS attempt,
  CASE WHEN place < 5 THEN least(30.0 * pow(2, place + 1), 240.0) END AS delay_seconds FROM p"""


def _retries(spark: SparkSession, sf_dir: str, guard: SkewGuard) -> DataFrame:
    kind = F.col("event_type")
    rows = retry.retry_plan(
        event_log(spark, sf_dir).select("k", "seq", "op_ts", "event_type"), ["k"], ["op_ts", "seq"], kind == "error", kind == "purchase", guard=guard
    )
    return rows.select("k", "seq", "event_type", "attempt", "delay_seconds")


@query("retry_plan", RETRY_SQL)
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retries(spark, sf_dir, SkewGuard())


@query("retry_plan_split_keys", RETRY_SQL)
def retry_plan_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retries(spark, sf_dir, SkewGuard(min_bytes=0, hot_rows=10))


# -- inventory ------------------------------------------------------------------

# Customers as inventory rows with untidy cells.
INVENTORY_SQL = """WITH raw AS (SELECT c_custkey, 'NATION_' || c_nationkey AS schema, upper('T' || c_custkey % 900) AS table_name,
    CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE c_custkey % 10 + 1 END AS group_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'both' WHEN 'MACHINERY' THEN 'rds' ELSE 'snowflake' END AS target,
    CASE WHEN c_custkey % 3 = 0 THEN 'PROD_' || c_nationkey ELSE 'NATION_' || c_nationkey END AS target_schema,
    NOT (c_custkey % 4 = 0) AS enabled, c_custkey % 59 = 0 AS blank FROM customer),
inv AS (SELECT * FROM raw WHERE NOT blank AND group_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY schema, table_name ORDER BY c_custkey) = 1)
"""


def _inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    raw = table(spark, sf_dir, "customer").select(
        F.when(key % 59 == 0, " ").otherwise(F.concat(F.lit(" nation_"), nation)).alias("Owner"),
        F.concat(F.lit("t"), (key % 900).cast("string"), F.lit(" ")).alias("TableName"),
        F.when(key % 53 == 0, "x").otherwise((key % 10 + 1).cast("string")).alias("group"),
        F.when(F.col("c_mktsegment") == "BUILDING", " Both").when(F.col("c_mktsegment") == "MACHINERY", "RDS")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "tape").otherwise("").alias("destination"),
        F.when(key % 3 == 0, F.concat(F.lit("PROD_"), nation)).alias("tgt_schema"),
        F.when(key % 4 == 0, F.when(key % 8 == 0, " disabled").otherwise("0")).when(key % 5 == 0, "").otherwise("Y").alias("Active"),
        F.when(key % 6 == 0, "ssn, ,tax_id ").alias("pii_columns"),
        key.alias("line_no"),
    )
    return parse_inventory(raw, order=["line_no"])


@query(
    "inventory_routes",
    INVENTORY_SQL
    + """SELECT schema || '.' || table_name AS fqn, CAST(group_id AS INTEGER) AS group_id, target, target_schema, enabled,
    CASE WHEN c_custkey % 6 = 0 THEN 'SSN|TAX_ID' ELSE '' END AS excluded, CASE WHEN target = 'both' THEN 2 ELSE 1 END AS n_targets FROM inv""",
)
def inventory_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _inventory(spark, sf_dir)
    return good.select(
        "fqn", "group_id", "target", "target_schema", "enabled", F.array_join("excluded_columns", "|").alias("excluded"), F.size("targets").alias("n_targets")
    )


@query(
    "inventory_rejects",
    INVENTORY_SQL
    + """SELECT c_custkey AS line_no, CASE WHEN blank THEN 'empty schema or table_name' ELSE 'group_id is not an integer' END AS reason
    FROM raw WHERE blank OR group_id IS NULL""",
)
def inventory_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)[1].select("line_no", "reason")


@query(
    "target_summary",
    INVENTORY_SQL
    + """SELECT CAST(group_id AS INTEGER) AS group_id, count(*) AS tables, count(*) FILTER (target = 'snowflake') AS warehouse_only,
    count(*) FILTER (target = 'rds') AS mirror_only, count(*) FILTER (target = 'both') AS both, count(*) FILTER (target <> 'rds') AS to_warehouse,
    count(*) FILTER (target <> 'snowflake') AS to_mirror FROM inv WHERE enabled GROUP BY group_id""",
)
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.target_summary(_inventory(spark, sf_dir)[0])


@query(
    "group_schemas",
    INVENTORY_SQL
    + """SELECT CAST(group_id AS INTEGER) AS group_id, string_agg(DISTINCT target_schema, ',' ORDER BY target_schema) AS schemas
    FROM inv WHERE target <> 'rds' GROUP BY group_id""",
)
def group_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routes.routes_for(_inventory(spark, sf_dir)[0], routes.WAREHOUSE)
    return routes.group_members(rows, "group_id", "target_schema", "schemas").withColumn("schemas", F.array_join("schemas", ","))


@query("oversized_groups", INVENTORY_SQL + "SELECT CAST(group_id AS INTEGER) AS group_id, count(*) AS members FROM inv GROUP BY group_id HAVING count(*) > 140")
def oversized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.oversized_groups(_inventory(spark, sf_dir)[0], "group_id", 140)


@query(
    "default_target_schema",
    INVENTORY_SQL
    + """, per AS (SELECT schema, target_schema, count(*) AS n, min(c_custkey) AS f FROM inv GROUP BY ALL)
    SELECT schema, arg_max(target_schema, n * 10000000 - f) AS target_schema, max(n) AS occurrences, count(*) AS values FROM per GROUP BY schema""",
)
def default_target_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.most_common(_inventory(spark, sf_dir)[0], ["schema"], "target_schema", ["line_no"])


OVERRIDES_SQL = INVENTORY_SQL + """, o AS (SELECT upper('nation_' || user_id % 25 || '.t' || user_id % 900) AS fqn,
    arg_max(event_type = 'purchase', ts) AS on_, max(ts) AS changed FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1)
"""


@query(
    "effective_routes",
    OVERRIDES_SQL
    + """SELECT schema || '.' || table_name AS fqn, coalesce(on_, enabled) AS enabled,
    CASE WHEN on_ IS NULL THEN '' WHEN on_ THEN '' ELSE 'failing' END AS disabled_reason,
    CASE WHEN on_ IS NULL OR on_ THEN '' ELSE strftime(changed, '%Y-%m-%dT%H:%M:%SZ') END AS disabled_at
    FROM inv LEFT JOIN o ON fqn = schema || '.' || table_name""",
)
def effective_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors disable a user's table, purchases enable it; the last entry counts."""
    user = F.col("user_id")
    entries = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").select(
        F.concat(F.lit("NATION_"), (user % 25).cast("string"), F.lit(".T"), (user % 900).cast("string")).alias("fqn"),
        (F.col("event_type") == "purchase").alias("enabled"),
        F.when(F.col("event_type") == "error", "failing").otherwise("").alias("reason"),
        F.col("ts").alias("changed_at"),
    )
    out = routes.apply_overrides(_inventory(spark, sf_dir)[0], entries)
    return out.select("fqn", "enabled", "disabled_reason", "disabled_at")


@query(
    "mode_per_key",
    LOG_SQL
    + """, per AS (SELECT k, event_type, count(*) AS occurrences, min(seq) AS first FROM log GROUP BY k, event_type)
    SELECT k, event_type, occurrences, count(*) OVER (PARTITION BY k) AS values FROM per
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY occurrences DESC, first) = 1""",
)
def mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.most_common(event_log(spark, sf_dir), ["k"], "event_type", ["seq"])


@query(
    "status_report",
    """WITH o AS (SELECT c_nationkey, o_orderkey, o_orderstatus <> 'F' AS on_ FROM orders JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, on_ ORDER BY o_orderkey) AS rn FROM o),
    g AS (SELECT c_nationkey, count(*) FILTER (on_) AS enabled, count(*) FILTER (NOT on_) AS disabled, count(*) AS total,
      coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY rn) FILTER (NOT on_ AND rn <= 3), '') AS names FROM r GROUP BY c_nationkey)
    SELECT c_nationkey, enabled, disabled, total, names || CASE WHEN disabled > 3 THEN ' (+' || (disabled - 3) || ' more)' ELSE '' END AS disabled_names FROM g""",
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = rows.withColumn("name", F.col("o_orderkey").cast("string"))
    return routes.status_report(rows, "c_nationkey", "name", F.col("o_orderstatus") != "F", ["o_orderkey"])


@query(
    "archive_cutoff",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def archive_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned line play the manifest of what is archived already."""
    manifest = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return due_for_archive(rows, manifest, ["o_orderkey"], "o_orderdate", F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))


@query(
    "report_order",
    """SELECT row_number() OVER (ORDER BY (CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END), o_orderpriority, o_orderstatus) AS place,
    o_orderstatus, o_orderpriority, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""",
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows with the matching state first, numbered in report order."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rated = counts.withColumn("status", F.when(F.col("o_orderstatus") == "O", "MATCH").otherwise("MISMATCH"))
    return recon.report_order(rated, ["o_orderpriority", "o_orderstatus"], "place").drop("status")


@query(
    "text_cells",
    """SELECT doc_id, upper(trim(lang)) NOT IN ('N', 'NO', 'FALSE', '0', 'DISABLED') AS is_on,
    CASE WHEN lower(source) IN ('web', 'books') THEN lower(source) ELSE 'web' END AS kind,
    len([x FOR x IN string_split(text, ',') IF upper(trim(x)) <> '']) AS parts FROM documents""",
)
def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell cleaning over whole texts."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.is_on(F.col("lang")).alias("is_on"),
        text.choice(F.col("source"), ("web", "books"), "web").alias("kind"),
        F.size(text.name_list(F.col("text"))).cast("bigint").alias("parts"),
    )
