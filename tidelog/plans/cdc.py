"""Change log, state and routing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import changelog, recon, routes, state
from tidelog.operators.ordered import SkewGuard
from tidelog.plans.base import LOG_SQL, Registry, event_log, table

REGISTRY = Registry()
query = REGISTRY.add

LOG_COLUMNS = ["k", "seq", "op_ts", "op_type", "value", "props"]
# Cuts every key with more rows than this, as the defaults do for huge inputs.
SPLIT_ALWAYS = SkewGuard(min_bytes=0, hot_rows=40)

LATEST_SQL = LOG_SQL + """, latest AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY k ORDER BY op_ts DESC, seq DESC) = 1)
"""
STATE_SQL = LATEST_SQL + "SELECT k, seq, op_ts, op_type, value, props FROM latest WHERE is_deleted = 0"


@query("cdc_current_state", STATE_SQL)
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(event_log(spark, sf_dir), ["k"]).select(*LOG_COLUMNS)


@query(
    "cdc_state_by_last_op",
    LATEST_SQL
    + """SELECT op_type, count(*) AS keys, round(sum(value), 2) AS total_value, max(op_ts) AS last_change
    FROM latest GROUP BY op_type""",
)
def state_by_last_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_change(event_log(spark, sf_dir), ["k"]).groupBy("op_type").agg(
        F.count(F.lit(1)).alias("keys"),
        F.round(F.sum("value"), 2).alias("total_value"),
        F.max("op_ts").alias("last_change"),
    )


SCD2_SQL = LOG_SQL + """, spans AS (
  SELECT *, lead(op_ts) OVER (PARTITION BY k ORDER BY op_ts, seq) AS valid_to,
         lead(seq) OVER (PARTITION BY k ORDER BY op_ts, seq) IS NULL AS is_current FROM log)
SELECT k, seq, value, op_ts AS valid_from, valid_to, is_current FROM spans WHERE is_deleted = 0"""
SCD2_COLUMNS = ["k", "seq", "value", "valid_from", "valid_to", "is_current"]


@query("cdc_scd2", SCD2_SQL)
def scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scd2_history(event_log(spark, sf_dir), ["k"]).select(*SCD2_COLUMNS)


@query("cdc_scd2_split_keys", SCD2_SQL)
def scd2_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scd2_history(event_log(spark, sf_dir), ["k"], guard=SPLIT_ALWAYS).select(*SCD2_COLUMNS)


COUNTS_SQL = """count(*) AS total_count, count(*) FILTER (is_deleted = 0) AS active_count,
  count(*) FILTER (is_deleted = 1) AS deleted_count, count(*) FILTER (op_type = 'I') AS insert_count,
  count(*) FILTER (op_type = 'U') AS update_count, count(*) FILTER (op_type = 'D') AS delete_count"""


@query("cdc_totals", LOG_SQL + f"SELECT k, {COUNTS_SQL} FROM log GROUP BY k")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.change_counts(event_log(spark, sf_dir), ["k"])


@query(
    "cdc_totals_by_table",
    LOG_SQL
    + f"""SELECT 'APP' AS schema, 'EVENTS' AS table_name, {COUNTS_SQL} FROM log
    UNION ALL SELECT 'APP', 'ORDERS', count(*), count(*), 0, 0, 0, 0 FROM orders""",
)
def totals_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = {("APP", "EVENTS"): event_log(spark, sf_dir), ("APP", "ORDERS"): table(spark, sf_dir, "orders")}
    return recon.change_counts_by_table(logs)


@query(
    "cdc_active_against_live",
    LATEST_SQL
    + """, alive AS (SELECT op_type, count(*) AS live_count FROM latest WHERE is_deleted = 0 GROUP BY op_type),
    raw AS (SELECT op_type, count(*) FILTER (is_deleted = 0) AS active_count FROM log GROUP BY op_type)
    SELECT op_type, active_count, coalesce(live_count, 0) AS live_count FROM raw LEFT JOIN alive USING (op_type)""",
)
def active_against_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    raw = recon.change_counts(log, ["op_type"]).select("op_type", "active_count")
    live = recon.live_counts(log, ["k"], ["op_type"])
    return raw.join(live, "op_type", "left").fillna(0, ["live_count"])


REPLAY_TIME = "2024-01-15 00:00:00"


@query(
    "cdc_replay",
    LOG_SQL
    + f"""SELECT k, seq, op_ts, op_type, value, props FROM log
    WHERE seq >= (SELECT max(seq) FROM log WHERE op_ts <= TIMESTAMP '{REPLAY_TIME}')""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    start = changelog.position_at(log, F.to_timestamp_ntz(F.lit(REPLAY_TIME))).scalar()
    return changelog.replay_from(log, start).select(*LOG_COLUMNS)


@query(
    "cdc_replay_groups",
    LOG_SQL
    + f"""SELECT l.k, l.seq, l.event_type FROM log l
    JOIN (SELECT event_type, max(seq) AS start_seq FROM log
          WHERE op_ts <= TIMESTAMP '{REPLAY_TIME}' AND event_type <> 'view' GROUP BY event_type) s
    USING (event_type) WHERE l.seq >= s.start_seq""",
)
def replay_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    starts = (
        log.where((F.col("op_ts") <= F.to_timestamp_ntz(F.lit(REPLAY_TIME))) & (F.col("event_type") != "view"))
        .groupBy("event_type")
        .agg(F.max("seq").alias("start_seq"))
    )
    return changelog.replay_groups(log, starts, "event_type").select("k", "seq", "event_type")


@query(
    "cdc_positions_at",
    LOG_SQL
    + """, asked AS (SELECT k, op_ts + INTERVAL 1 HOUR AS op_ts FROM log WHERE event_type = 'purchase')
    SELECT a.k, a.op_ts, l.seq AS position FROM asked a ASOF LEFT JOIN log l ON a.k = l.k AND a.op_ts >= l.op_ts""",
)
def positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    asked = log.where("event_type = 'purchase'").select("k", (F.col("op_ts") + F.expr("INTERVAL 1 HOUR")).alias("op_ts"))
    return changelog.positions_at(log, asked, ["k"])


@query(
    "cdc_before_after",
    LOG_SQL
    + """, images AS (SELECT *, lag(value) OVER w AS prev, lag(is_deleted) OVER w AS prev_deleted FROM log
                      WINDOW w AS (PARTITION BY k ORDER BY op_ts, seq)),
    pairs AS (SELECT k, seq, op_type, CASE WHEN prev_deleted = 0 THEN prev END AS before_value,
                     CASE WHEN is_deleted = 0 THEN value END AS after_value FROM images)
    SELECT *, CASE WHEN before_value IS DISTINCT FROM after_value THEN 'value' ELSE '' END AS changed FROM pairs""",
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.before_after(event_log(spark, sf_dir), ["k"], ["value"])
    return rows.select(
        "k", "seq", "op_type",
        F.col("before.value").alias("before_value"),
        F.col("after.value").alias("after_value"),
        F.array_join("changed", ",").alias("changed"),
    )


@query(
    "cdc_masked",
    "SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer",
)
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.mask_columns(table(spark, sf_dir, "customer"), ["C_ACCTBAL"])


@query("cdc_dropped", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.drop_columns(table(spark, sf_dir, "customer"), ["C_NAME", "C_ACCTBAL"])


@query(
    "cdc_payload_exclusion",
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS masked_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS masked_nation,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS kept_entries FROM customer""",
)
def payload_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-entity log with a map payload: the segment's route names what to hide."""
    listed = small_table(
        spark, [("BUILDING", "name"), ("MACHINERY", " nation ")], "c_mktsegment string, excluded_columns string"
    )
    excluded = listed.select("c_mktsegment", F.split(F.upper(F.trim("excluded_columns")), ",").alias("excluded"))
    payload = F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").withColumn("payload", payload).join(excluded, "c_mktsegment", "left")
    hidden = changelog.mask_payload(F.col("payload"), F.col("excluded"))
    return rows.select(
        "c_custkey",
        hidden["name"].alias("masked_name"),
        hidden["nation"].alias("masked_nation"),
        F.size(changelog.drop_payload(F.col("payload"), F.col("excluded"))).alias("kept_entries"),
    )


ROUTES = [
    # schema, table_name, group_id, target, target_schema, rds_target_schema, enabled
    ("APP", "CLICK", 1, "both", "APP_PROD", "APP_MIRROR", True),
    ("APP", "VIEW", 1, "snowflake", "APP_PROD", "", True),
    ("APP", "PURCHASE", 2, "rds", "", "APP_MIRROR", True),
    ("APP", "SIGNUP", 2, "unheard-of", "", "", True),
    ("APP", "ERROR", 2, "both", "APP_PROD", "APP_MIRROR", False),
]
ROUTES_SQL = """, routes(table_name, target, target_schema) AS (VALUES
  ('CLICK', 'snowflake', 'APP_PROD'), ('CLICK', 'rds', 'APP_MIRROR'), ('VIEW', 'snowflake', 'APP_PROD'),
  ('PURCHASE', 'rds', 'APP_MIRROR'), ('SIGNUP', 'snowflake', 'APP'))
"""


def route_table(spark: SparkSession) -> DataFrame:
    columns = (
        "schema string, table_name string, group_id int, target string, target_schema string, "
        "rds_target_schema string, enabled boolean"
    )
    return routes.normalise_routes(small_table(spark, ROUTES, columns))


def routed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("fqn", F.concat(F.lit("APP."), F.upper("event_type")))
    return routes.route_changes(log, route_table(spark))


@query(
    "cdc_routed",
    LOG_SQL
    + ROUTES_SQL
    + """SELECT seq, k, 'APP.' || upper(event_type) AS fqn, target, target_schema
    FROM log JOIN routes ON upper(event_type) = table_name""",
)
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_log(spark, sf_dir).select("seq", "k", "fqn", "target", "target_schema")


@query(
    "cdc_routed_counts",
    LOG_SQL
    + ROUTES_SQL
    + """SELECT target, target_schema, table_name, count(*) AS changes, round(sum(value), 2) AS total_value
    FROM log JOIN routes ON upper(event_type) = table_name GROUP BY ALL""",
)
def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_log(spark, sf_dir).groupBy("target", "target_schema", "table_name").agg(
        F.count(F.lit(1)).alias("changes"), F.round(F.sum("value"), 2).alias("total_value")
    )


def _halves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    middle = log.agg((F.min("seq") + F.floor((F.max("seq") - F.min("seq")) / 2)).alias("m")).scalar()
    return log.where(F.col("seq") <= middle), log.where(F.col("seq") > middle)


@query("mirror_apply", STATE_SQL)
def mirror_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding the second half of the log into the state of the first."""
    first, second = _halves(event_log(spark, sf_dir))
    merged = state.fold(state.latest_change(first, ["k"]), second, ["k"])
    return merged.where("is_deleted = 0").select(*LOG_COLUMNS)


@query("mirror_apply_late", STATE_SQL)
def mirror_apply_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half arrives late and the newer half twice: same state."""
    first, second = _halves(event_log(spark, sf_dir))
    merged = state.fold(state.latest_change(second, ["k"]), first.unionByName(second), ["k"])
    return merged.where("is_deleted = 0").select(*LOG_COLUMNS)
