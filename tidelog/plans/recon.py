"""Reconciliation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import quality, recon
from tidelog.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

CORE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TOTALS_SQL = " UNION ALL ".join(
    f"SELECT 'APP' AS schema, '{t.upper()}' AS table_name, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM {t}"
    for t in CORE_TABLES
)


@query(
    "control_totals",
    TOTALS_SQL + " UNION ALL SELECT 'APP', 'GONE', CAST(NULL AS BIGINT), 'unreadable'",
)
def control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, and one that does not exist."""
    tables = {("APP", t.upper()): (lambda t=t: table(spark, sf_dir, t)) for t in (*CORE_TABLES, "gone")}
    totals = recon.control_totals(spark, tables)
    return totals.withColumn("error", F.when(F.col("error").isNotNull(), "unreadable"))


@query(
    "control_totals_summary",
    f"""SELECT count(*) AS tables_total, count(*) FILTER (error IS NULL) AS tables_ok,
    count(*) FILTER (error IS NOT NULL) AS tables_error FROM ({REGISTRY.sql['control_totals']})""",
)
def control_totals_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.totals_summary(control_totals(spark, sf_dir))


def _source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per order; every 97th order fails to be counted."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg(F.count(F.lit(1)).alias("row_count"))
    return lines.withColumn("error", F.when(F.col("entity") % 97 == 0, "timeout"))


def _target_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as copied by a faulty pipeline: some orders never arrived,
    some lines came twice; orders without lines arrived as empty."""
    copied = (
        table(spark, sf_dir, "lineitem")
        .where("l_orderkey % 13 <> 0")
        .groupBy("l_orderkey")
        .agg(F.sum(F.when(F.expr("l_orderkey % 7 = 0 AND l_linenumber = 1"), 2).otherwise(1)).alias("row_count"))
    )
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return (
        keys.join(copied, "l_orderkey", "left")
        .select(F.col("l_orderkey").alias("entity"), "row_count")
        .withColumn("error", F.when(F.col("entity") % 101 == 0, "denied").otherwise(""))
    )


SIDES_SQL = """WITH src AS (
  SELECT l_orderkey AS entity, count(*) AS row_count, CASE WHEN l_orderkey % 97 = 0 THEN 'timeout' END AS error
  FROM lineitem GROUP BY l_orderkey),
copied AS (
  SELECT l_orderkey, CAST(sum(CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 2 ELSE 1 END) AS BIGINT) AS row_count
  FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey),
tgt AS (
  SELECT o_orderkey AS entity, row_count, CASE WHEN o_orderkey % 101 = 0 THEN 'denied' END AS error
  FROM orders LEFT JOIN copied ON o_orderkey = l_orderkey WHERE o_orderkey % 13 <> 0),
compared AS (
  SELECT coalesce(s.entity, t.entity) AS entity, s.row_count AS source_count, t.row_count AS target_count,
    CASE WHEN s.error IS NOT NULL THEN 'ORACLE_ERROR' WHEN t.error IS NOT NULL THEN 'SNOWFLAKE_ERROR'
         WHEN s.entity IS NULL THEN 'MISSING_IN_ORACLE' WHEN t.entity IS NULL THEN 'MISSING_IN_SNOWFLAKE'
         WHEN coalesce(s.row_count, 0) = coalesce(t.row_count, 0) THEN 'OK' ELSE 'MISMATCH' END AS status
  FROM src s FULL JOIN tgt t ON s.entity = t.entity),
result AS (
  SELECT entity, source_count, target_count,
    CASE WHEN status IN ('OK', 'MISMATCH') THEN coalesce(source_count, 0) - coalesce(target_count, 0) END AS delta, status
  FROM compared)
"""


def _reconciled(spark: SparkSession, sf_dir: str, show_all: bool = True) -> DataFrame:
    return recon.reconcile(_source_totals(spark, sf_dir), _target_totals(spark, sf_dir), ["entity"], show_all=show_all)


@query("recon_full", SIDES_SQL + "SELECT * FROM result")
def recon_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)


@query("recon_problems", SIDES_SQL + "SELECT * FROM result WHERE status <> 'OK'")
def recon_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir, show_all=False)


@query(
    "recon_summary",
    SIDES_SQL
    + """, counted AS (SELECT count(*) AS tables_compared, count(*) FILTER (status = 'OK') AS tables_ok,
    count(*) FILTER (status = 'MISMATCH') AS mismatches, count(*) FILTER (status = 'MISSING_IN_SNOWFLAKE') AS missing_in_target,
    count(*) FILTER (status = 'MISSING_IN_ORACLE') AS missing_in_source,
    count(*) FILTER (status IN ('ORACLE_ERROR', 'SNOWFLAKE_ERROR')) AS errors FROM result)
    SELECT *, mismatches = 0 AND missing_in_target = 0 AND errors = 0 AS passed FROM counted""",
)
def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.reconcile_summary(_reconciled(spark, sf_dir))


def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
    source = _source_totals(spark, sf_dir).select(
        "entity",
        F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.col("row_count")).alias("row_count"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error"))).otherwise("EXACT").alias("method"),
    )
    target = _target_totals(spark, sf_dir).where("row_count IS NOT NULL").select(
        "entity",
        (F.col("row_count") + 1).alias("total_count"),
        F.when(F.col("entity") % 5 != 0, F.col("row_count")).alias("active_count"),
    )
    return recon.reconcile_threshold(expected, source, target, ["entity"], threshold_pct=20.0)


THRESHOLD_SQL = (
    SIDES_SQL
    + """, pairs AS (
    SELECT o_orderkey AS entity, CASE WHEN s.error IS NOT NULL THEN -1 ELSE s.row_count END AS source_count,
      t.row_count + 1 AS target_total, CASE WHEN t.entity % 5 <> 0 THEN t.row_count ELSE t.row_count + 1 END AS target_active
    FROM orders LEFT JOIN src s ON o_orderkey = s.entity
    LEFT JOIN (SELECT * FROM tgt WHERE row_count IS NOT NULL) t ON o_orderkey = t.entity),
    rated AS (
    SELECT *, CASE WHEN source_count >= 0 THEN source_count - target_active END AS delta,
      CASE WHEN source_count = 0 THEN CASE WHEN target_active = 0 THEN 0.0 ELSE 100.0 END
           WHEN source_count > 0 THEN abs(source_count - target_active) / CAST(source_count AS DOUBLE) * 100 END AS pct
    FROM pairs),
    named AS (
    SELECT *, CASE WHEN source_count < 0 THEN 'ERROR' WHEN pct IS NULL THEN 'MISSING' WHEN pct <= 20 THEN 'MATCH' ELSE 'MISMATCH' END AS status
    FROM rated),
    rated_rows AS (SELECT entity, source_count, target_total, target_active, delta, pct AS delta_pct, status,
      CASE WHEN status = 'MISSING' THEN CASE WHEN target_active IS NULL THEN 'target' ELSE 'source' END END AS side FROM named)
    """
)


@query("recon_threshold", THRESHOLD_SQL + "SELECT * REPLACE (round(delta_pct, 6) AS delta_pct) FROM rated_rows")
def recon_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threshold(spark, sf_dir).withColumn("delta_pct", F.round("delta_pct", 6))


SAMPLES = {"orders": "o_orderkey % 100 = 0", "lineitem": "l_orderkey % 100 = 0"}


@query(
    "sampled_count",
    "SELECT 'APP' AS schema, 'CUSTOMER' AS table_name, count(*) AS row_count, 'EXACT' AS method, CAST(100 AS DOUBLE) AS sample_pct FROM customer"
    + "".join(
        f" UNION ALL SELECT 'APP', '{t.upper()}', CAST(round(count(*) / 0.01) AS BIGINT), 'SAMPLE', CAST(1 AS DOUBLE) FROM {t} WHERE {c}"
        for t, c in SAMPLES.items()
    ),
)
def sampled_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` and ``lineitem`` are estimated from a hundredth of their keys, ``customer`` is counted."""
    tables = {("APP", t.upper()): table(spark, sf_dir, t) for t in ("customer", *SAMPLES)}
    return recon.sampled_totals(tables, {("APP", t.upper()): (F.expr(c), 0.01) for t, c in SAMPLES.items()})


STATS_NOW = "2002-01-01 00:00:00"


@query(
    "statistics_count",
    f"""SELECT 'APP' AS schema, c_name AS table_name, coalesce(n, 0) AS row_count, 'STATS' AS method,
    coalesce(CAST(round((epoch(TIMESTAMP '{STATS_NOW}') - epoch(seen)) / 86400) AS INTEGER), 365) AS days_stale
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS seen FROM orders GROUP BY o_custkey)
    ON c_custkey = o_custkey""",
)
def statistics_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables whose statistics were gathered at their last order."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("num_rows"), F.max("o_orderdate").alias("last_analyzed")
    )
    catalog = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left")
        .select(F.lit("APP").alias("schema"), F.col("c_name").alias("table_name"), "num_rows", "last_analyzed")
    )
    return recon.statistics_totals(catalog, F.to_timestamp_ntz(F.lit(STATS_NOW)))


KEY_SQL = """WITH per_key AS (SELECT {keys}, count(*) AS copies FROM {table} GROUP BY {keys}),
totals AS (SELECT CAST(coalesce(sum(copies), 0) AS BIGINT) AS rows, count(*) AS distinct_keys,
  CAST(coalesce(sum(copies) FILTER ({null}), 0) AS BIGINT) AS null_key_rows,
  count(*) FILTER (copies > 1) AS duplicate_keys, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS surplus_rows FROM per_key)
SELECT *, null_key_rows = 0 AND duplicate_keys = 0 AS passed FROM totals"""


@query(
    "key_quality_lines",
    KEY_SQL.format(keys="l_orderkey, l_linenumber", table="lineitem", null="l_orderkey IS NULL OR l_linenumber IS NULL"),
)
def key_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_quality(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("key_quality_orders", KEY_SQL.format(keys="o_orderkey", table="orders", null="o_orderkey IS NULL"))
def key_quality_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_quality(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
