"""Reports and alert logs. Values stay typed in tables; text formats only here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the CSV report, in order.
CSV_COLUMNS = (
    "schema", "table_name", "oracle_count", "snowflake_total", "snowflake_active", "delta", "delta_pct", "status",
)


def csv_report(result: DataFrame) -> DataFrame:
    """Threshold reconciliation in the fixed report layout, ordered by name."""
    renamed = result.withColumnsRenamed(
        {"source_count": "oracle_count", "target_total": "snowflake_total", "target_active": "snowflake_active"}
    )
    return renamed.withColumn("delta_pct", F.format_string("%.2f", F.col("delta_pct"))).withColumn(
        "delta_pct", F.when(F.col("delta").isNotNull(), F.col("delta_pct"))
    ).select(*CSV_COLUMNS).orderBy("schema", "table_name")


def write_csv_report(result: DataFrame, path: str) -> None:
    csv_report(result).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_json_report(summary: DataFrame, tables: DataFrame, path: str, run_id: str) -> None:
    """Summary and detail rows of a run, each as JSON lines under the run's folder."""
    for name, df in (("summary", summary), ("tables", tables)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{path}/{name}/run={run_id}")


def write_nested_reports(rows: DataFrame, path: str, source: str, position: str = "position") -> None:
    """Control totals as one JSON line per run: a summary and the run's tables, in order, as an array of structs.

    ``rows`` holds run, position, schema, table_name, row_count and error. A run lists the tables of one inventory.
    """
    entry = F.struct(position, "schema", F.col("table_name").alias("table"), "row_count", "error")
    runs = rows.groupBy("run").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.array_sort(F.collect_set("schema")).alias("schemas"),
        F.count(F.lit(1)).alias("tables_total"),
        F.count_if(F.col("error").isNull()).alias("tables_ok"),
        F.count_if(F.col("error").isNotNull()).alias("tables_error"),
    )
    summary = F.struct(
        F.col("run").cast("string").alias("run_id"), F.lit(source).alias("source"), "schemas", "tables_total", "tables_ok", "tables_error"
    )
    tables = F.transform("entries", lambda e: e.dropFields(position))
    runs.select(summary.alias("summary"), tables.alias("tables")).write.mode("append").json(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts are never rewritten, one JSON line each."""
    alerts.write.mode("append").json(path)


def stream_alerts(alerts: DataFrame, path: str, checkpoint: str):
    """The same for a stream (exactly once, by the file sink's own log)."""
    return alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
