"""Plans that write a given table in the form of an export, report, listing or log, and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import profile, routes, telemetry
from tidelog.plans.base import Registry, table
from tidelog.plans.cdc import route_table
from tidelog.plans.profile import PROFILE_SQL, _customer_profile
from tidelog.plans.recon import THRESHOLD_SQL, _threshold
from tidelog.plans.streams import finish, workspace
from tidelog.plans.telemetry import LINES_SQL, _lines
from tidelog.sinks.changes import discard, split_valid
from tidelog.sinks.reports import CSV_COLUMNS, write_csv_report, write_nested_reports
from tidelog.sinks.store import Store
from tidelog.sources import counts, inventory, listing, logs, metadata, tables

REGISTRY = Registry()
query = REGISTRY.add

EVERY_FILE = (1 << 33) - 1  # the row number in a monotonically_increasing_id


def text_files(rows: DataFrame, header: str, line, path: str) -> None:
    """Lines as text files that each start with the header."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(EVERY_FILE)) == 0
    rows.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.text(path)


@query(
    "inventory_file",
    """WITH c AS (SELECT *, c_custkey % 10 AS m FROM customer WHERE c_custkey % 10 <> 9),
    named AS (SELECT 'OWNER_' || c_nationkey || '.' || upper(c_name) AS fqn, c_custkey % 3 + 1 AS group_id, m FROM c)
    SELECT CASE WHEN m = 8 THEN 'rejected' ELSE 'route' END AS kind, CASE WHEN m <> 8 THEN fqn END AS fqn, CASE WHEN m <> 8 THEN group_id END AS group_id,
      CASE WHEN m <> 8 THEN m <> 7 END AS enabled, CASE WHEN m = 8 THEN 'group_id is not an integer' END AS reason FROM named""",
)
def inventory_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a route list with an odd header: every tenth line is blank, others are short or have no group."""
    m, home = F.col("c_custkey") % 10, workspace(spark)
    group = F.when(m == 8, "soon").otherwise((F.col("c_custkey") % 3 + 1).cast("string"))
    cells = F.concat(F.lit(" owner_"), F.col("c_nationkey").cast("string"), F.lit("\t "), F.col("c_name"), F.lit(" \t"), group)
    line = F.when(m == 9, "\t \t\t").when(m == 7, F.concat(cells, F.lit("\tno"))).when(m < 4, cells).otherwise(F.concat(cells, F.lit("\tY")))
    text_files(table(spark, sf_dir, "customer"), "﻿ Owner \tTableName\tEXTRACT_GROUP\tActive", line, f"{home}/routes.tsv")
    order = list(inventory.FILE_POSITION)
    good, bad = inventory.parse_inventory(inventory.read_delimited(spark, f"{home}/routes.tsv", keep_position=True), order)
    good = good.select(F.lit("route").alias("kind"), "fqn", "group_id", "enabled", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("fqn", "string"), ("group_id", "int"), ("enabled", "boolean"))]
    return good.unionByName(bad.select(F.lit("rejected").alias("kind"), *none, "reason")).withColumn("group_id", F.col("group_id").cast("bigint"))


@query(
    "active_routes",
    "SELECT upper(event_type) AS table_name, CAST(count(*) AS BIGINT) AS changes FROM events WHERE event_type <> 'signup' GROUP BY 1",
)
def active_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of enabled tables only; an inventory without any would be an error."""
    some = route_table(spark).withColumn("enabled", F.col("table_name") != "SIGNUP")
    active = routes.require_active(some).select("table_name").distinct()
    changes = table(spark, sf_dir, "events").select(F.upper("event_type").alias("table_name"))
    return changes.join(active, "table_name").groupBy("table_name").agg(F.count(F.lit(1)).alias("changes"))


@query(
    "count_exports",
    """WITH s AS (SELECT upper('o' || c_nationkey) AS schema, upper(c_name) AS table_name, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE c_custkey END AS row_count,
      CASE WHEN c_custkey % 4 = 1 THEN 'ERROR: gone' ELSE 'EXACT' END AS method, c_custkey + 1 AS total_count, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 1 END AS active_count
      FROM customer WHERE c_custkey % 20 <> 0)
    SELECT * FROM s""",
)
def count_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target counts as exports: spaces, words in place of numbers, failed counts, rows without a name."""
    key, home = F.col("c_custkey"), workspace(spark)
    rows = table(spark, sf_dir, "customer")
    owner, name = F.concat(F.lit("o"), F.col("c_nationkey").cast("string")), F.when(key % 20 == 0, "  ").otherwise(F.concat(F.col("c_name"), F.lit(" ")))
    count = F.when(key % 4 == 0, "many").when(key % 4 == 1, "-1").otherwise(F.concat(F.lit(" "), key.cast("string")))
    source = rows.select(owner.alias("OWNER"), name.alias("Table_Name"), count.alias("Row_Count"), F.when(key % 4 == 1, "ERROR: gone").otherwise("EXACT").alias("METHOD"))
    target = rows.select(owner.alias("schema"), name.alias("TABLE"), (key + 1).alias("Total_Count"), F.when(key % 3 == 0, key).alias("active_count"))
    source.write.csv(f"{home}/source", header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    target.write.csv(f"{home}/target", header=True)
    both = counts.read_source_counts(spark, f"{home}/source").join(counts.read_target_counts(spark, f"{home}/target"), ["schema", "table_name"])
    return both.select("schema", "table_name", "row_count", "method", "total_count", "active_count")


@query(
    "column_export",
    """SELECT upper(n_name) AS owner, 'T' || n_regionkey AS table_name, 'C' || n_nationkey AS column_name, 'NUMBER' AS data_type, CASE WHEN n_nationkey % 2 = 0 THEN 'N' ELSE 'Y' END AS nullable,
      CAST(n_nationkey AS INTEGER) AS data_length, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS INTEGER) END AS data_precision, CAST(NULL AS INTEGER) AS data_scale, CAST(n_nationkey AS INTEGER) AS column_id
    FROM nation, (SELECT 1 AS u) WHERE n_nationkey % 6 <> 5""",
)
def column_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column metadata as a listing with separator rows and repeated headers."""
    key, home = F.col("n_nationkey"), workspace(spark)
    dash = lambda c, word: F.when(key % 6 != 5, c).when(key % 12 == 5, "------").otherwise(word)
    text = key.cast("string")
    rows = table(spark, sf_dir, "nation").select(
        dash(F.lower("n_name"), "OWNER").alias("Owner"),
        dash(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")), "TABLE_NAME").alias("Table_Name"),
        dash(F.concat(F.lit("c"), text), "COLUMN_NAME").alias("column_name"),
        dash(F.lit("number"), "DATA_TYPE").alias("data_type"),
        dash(F.concat(text, F.lit(".0")), "DATA_LENGTH").alias("data_length"),
        dash(F.when(key % 3 == 0, text).otherwise("null"), "DATA_PRECISION").alias("data_precision"),
        dash(F.when(key % 2 == 0, "N"), "NULLABLE").alias("nullable"),
        dash(text, "COLUMN_ID").alias("column_id"),
    )
    rows.write.csv(f"{home}/columns", header=True)
    return metadata.read_columns(spark, f"{home}/columns", complete=True)


@query(
    "profile_export",
    """WITH c AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'short' WHEN c_custkey % 11 = 0 THEN 'long' WHEN c_custkey % 13 = 0 THEN 'open' ELSE 'good' END AS kind FROM customer)
    SELECT kind = 'good' AS good, count(*) AS lines, CAST(coalesce(sum(CASE WHEN kind = 'good' AND k % 5 > 0 THEN k END), 0) AS BIGINT) AS inserts FROM c GROUP BY 1""",
)
def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile export with broken lines: too few cells, too many, a quote that is never closed; bad numbers count as 0."""
    key, home = F.col("c_custkey"), workspace(spark)
    line = F.concat(F.lit("owner,"), F.col("c_name"), F.lit(","), F.when(key % 5 == 0, "bad").otherwise(key.cast("string")), F.lit(",1"))
    broken = F.when(key % 7 == 0, F.concat(F.lit("owner,"), F.col("c_name"))).when(key % 11 == 0, F.concat(line, F.lit(",2,3"))).when(key % 13 == 0, F.concat(F.lit('owner,"'), F.col("c_name")))
    text_files(table(spark, sf_dir, "customer"), "Owner,Table_Name,Inserts,Updates", F.coalesce(broken, line), f"{home}/profile")
    good, bad = metadata.read_profile(spark, f"{home}/profile")
    rows = good.select(F.lit(True).alias("good"), F.col("inserts").cast("bigint").alias("inserts"))
    rows = rows.unionByName(bad.select(F.lit(False).alias("good"), F.lit(0).cast("bigint").alias("inserts")))
    return rows.groupBy("good").agg(F.count(F.lit(1)).alias("lines"), F.sum("inserts").alias("inserts"))


REPORT_ROWS = """WITH r AS (
  SELECT s_suppkey // 40 AS run, s_suppkey AS position, 's' || s_nationkey AS schema, 't' || s_suppkey % 30 AS table_name,
    CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 10 END AS row_count, CASE WHEN s_suppkey % 9 = 0 THEN 'no access' END AS error FROM supplier),
last AS (SELECT CAST(run AS VARCHAR) AS run, upper(schema) AS schema, upper(table_name) AS table_name, row_count, error FROM r
  QUALIFY row_number() OVER (PARTITION BY run, schema, table_name ORDER BY position DESC) = 1)
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, home = F.col("s_suppkey"), workspace(spark)
    rows = table(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey div 40").alias("run"),
        key.alias("position"),
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("schema"),
        F.concat(F.lit("t"), (key % 30).cast("string")).alias("table_name"),
        F.when(key % 9 != 0, key * 10).cast("bigint").alias("row_count"),
        F.when(key % 9 == 0, "no access").alias("error"),
    )
    write_nested_reports(rows, f"{home}/reports", "source")
    return counts.read_reports(spark, f"{home}/reports", lines=True)


@query("report_runs", REPORT_ROWS + "SELECT * FROM last")
def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several runs as nested JSON; tables that a run lists twice count with their last entry."""
    return _reports(spark, sf_dir)


@query("report_latest_run", REPORT_ROWS + "SELECT schema, table_name, row_count, error FROM last WHERE run = (SELECT max(run) FROM last)")
def report_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.latest_run(_reports(spark, sf_dir))


@query(
    "report_summaries",
    REPORT_ROWS + """SELECT CAST(run AS VARCHAR) AS run_id, 'source' AS source, count(*) AS tables_total, count(*) FILTER (error IS NULL) AS tables_ok,
    count(error) AS tables_error, string_agg(DISTINCT schema, ',' ORDER BY schema) AS schemas FROM r GROUP BY run""",
)
def report_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = workspace(spark)
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey div 40").alias("run"), key.alias("position"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("schema"),
        F.lit("t").alias("table_name"), F.lit(1).cast("bigint").alias("row_count"), F.when(key % 9 == 0, "no access").alias("error"),
    )
    write_nested_reports(rows, f"{home}/reports", "source")
    read = spark.read.schema(counts.REPORT_SCHEMA).json(f"{home}/reports").select("summary.*")
    return read.select("run_id", "source", "tables_total", "tables_ok", "tables_error", F.array_join("schemas", ",").alias("schemas"))


@query(
    "csv_report_file",
    THRESHOLD_SQL + """SELECT 'S' || entity % 3 AS schema, 'T' || entity AS table_name, CAST(source_count AS VARCHAR) AS oracle_count, CAST(target_total AS VARCHAR) AS snowflake_total,
    CAST(target_active AS VARCHAR) AS snowflake_active, CAST(delta AS VARCHAR) AS delta, CASE WHEN delta IS NOT NULL THEN format('{:.2f}', delta_pct) END AS delta_pct, status FROM rated_rows""",
)
def csv_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold report as CSV, read back as text."""
    home = workspace(spark)
    named = {"schema": F.concat(F.lit("S"), (F.col("entity") % 3).cast("string")), "table_name": F.concat(F.lit("T"), F.col("entity").cast("string"))}
    write_csv_report(_threshold(spark, sf_dir).withColumns(named), f"{home}/report")
    return spark.read.csv(f"{home}/report", header=True).select(*CSV_COLUMNS)


MB_PER_MINUTE = "CAST(CASE WHEN grown > 0 THEN grown ELSE 0 END AS DOUBLE) / 1048576 / 10"


@query(
    "listing_scans",
    f"""WITH f AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    s AS (SELECT 1 AS scan, n_regionkey, n_nationkey, size FROM f WHERE n_nationkey % 2 = 0 UNION ALL SELECT 2, n_regionkey, n_nationkey, size FROM f),
    p AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 10 MINUTE * scan AS snapshot_ts, 'r' || n_regionkey AS prefix, count(*) AS files,
      CAST(sum(size) AS BIGINT) AS total_bytes, CAST(max(n_nationkey) AS BIGINT) AS newest_seq, CAST(min(n_nationkey) AS BIGINT) AS oldest_seq FROM s GROUP BY ALL),
    g AS (SELECT b.prefix, b.total_bytes - a.total_bytes AS grown FROM p a JOIN p b ON a.prefix = b.prefix AND a.snapshot_ts < b.snapshot_ts)
    SELECT p.*, (SELECT round(sum({MB_PER_MINUTE}), 9) FROM g) AS growth_mb_min FROM p""",
)
def listing_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of known sizes, scanned twice by the periodic growth check: one per nation, as long as the nation has customers."""
    home = workspace(spark)
    store = Store(spark, f"{home}/dirdat")
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count()
    sizes = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").fillna(0, ["count"]).select("n_regionkey", "n_nationkey", "count").collect()  # 25 nations
    store.create("README", "no trail file")
    disk = small_table(spark, [(None, 10.0, 1.0)], "dir string, free_mb double, disk_pct double")
    for scan in (1, 2):
        for region, nation, size in sizes:
            if scan == 2 or nation % 2 == 0:
                store.create(f"r{region}{nation:09d}", "x" * size)
        at = F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL {10 * scan} MINUTE")
        found = listing.list_files(spark, f"{home}/dirdat", at)
        disk = disk.withColumn("dir", F.lit(found.select("dir").first()[0]))
        checked = listing.growth_check(spark, f"{home}/dirdat", f"{home}/scans", disk, at)
    growth = checked.select(F.round("growth_mb_min", 9).alias("growth_mb_min"))
    stats = telemetry.prefix_stats(telemetry.parse_listing(spark.read.parquet(f"{home}/scans")))
    return stats.select("snapshot_ts", "prefix", "files", "total_bytes", "newest_seq", "oldest_seq").crossJoin(F.broadcast(growth))  # one row


@query(
    "log_lines_file",
    LINES_SQL + "SELECT reader, trim(value) AS value, count(*) AS lines FROM lines, (VALUES ('batch'), ('follow')) t(reader) GROUP BY ALL",
)
def log_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text files with blank lines in between, read at once and followed file by file."""
    home = workspace(spark)
    spaced = _lines(spark, sf_dir).select(F.concat(F.col("value"), F.when(F.col("row") % 5 == 0, "\n  ").otherwise("")).alias("value"))
    spaced.repartition(3).write.text(f"{home}/logs")
    rows = logs.follow_lines(spark, f"{home}/logs", files_per_batch=1).select("value")
    finish(rows.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint"))
    followed = spark.read.schema(rows.schema).parquet(f"{home}/out")
    whole = logs.read_lines(spark, f"{home}/logs").where("value <> ''").select("value")
    both = whole.withColumn("reader", F.lit("batch")).unionByName(followed.withColumn("reader", F.lit("follow")))
    return both.groupBy("reader", "value").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "rejected_rows",
    """WITH o AS (SELECT *, CASE WHEN o_totalprice <= 50000 THEN 'price too low' WHEN NOT coalesce(o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW', false) THEN 'priority' END AS reason FROM orders)
    SELECT coalesce(reason, 'valid') AS reason, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY 1""",
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that fail a check are set aside with the first reason."""
    home, priority = workspace(spark), F.col("o_orderpriority")
    checks = {"price too low": F.col("o_totalprice") > 50_000, "priority": priority.like("1-%") | priority.like("%LOW")}
    valid, rejected = split_valid(table(spark, sf_dir, "orders"), checks)
    discard(rejected, f"{home}/rejected")
    both = valid.select("o_orderkey", F.lit("valid").alias("reason")).unionByName(spark.read.parquet(f"{home}/rejected").select("o_orderkey", "reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))


@query(
    "catalog_tables",
    "SELECT 'nation' AS name, count(*) AS rows, true AS kept FROM nation UNION ALL SELECT 'region', count(*), false FROM region UNION ALL SELECT 'supplier', count(*), true FROM supplier",
)
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a catalog's schema, and those of them that a list names."""
    schema = f"tidelog_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        for name in ("supplier", "region", "nation"):
            table(spark, sf_dir, name).write.saveAsTable(f"{schema}.{name}")
        found = [(schema, name, spark.table(f"{schema}.{name}").count()) for name in tables.list_tables(spark, schema)]
        rows = small_table(spark, found, "owner string, table_name string, rows bigint")
        wanted = small_table(spark, [(f"{schema.upper()}.NATION",), (f"{schema.upper()}.SUPPLIER",)], "fqn string")
        kept = tables.only_schemas(rows, [f" {schema} "], wanted).select("table_name", F.lit(True).alias("kept"))
        out = rows.join(kept, "table_name", "left").select(F.col("table_name").alias("name"), "rows", F.coalesce("kept", F.lit(False)).alias("kept"))
        return small_table(spark, [tuple(r) for r in out.collect()], "name string, rows bigint, kept boolean")  # one row per table
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")


@query(
    "profile_report_top",
    PROFILE_SQL + """SELECT owner, table_name, byte_throughput, num_rows FROM prof ORDER BY owner, byte_throughput DESC, num_rows DESC, table_name LIMIT 50""",
)
def profile_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the profile report, in its order."""
    return profile.report_order(_customer_profile(spark, sf_dir)).select("owner", "table_name", "byte_throughput", "num_rows").limit(50)
