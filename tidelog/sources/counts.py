"""Row-count exports and control-total reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import identifier, to_count
from tidelog.sources.inventory import read_delimited, resolve_columns

# Header names accepted for each field.
SCHEMA_NAMES = ("schema", "owner", "table_schema")
TABLE_NAMES = ("table_name", "table")

REPORT_SCHEMA = (
    "summary struct<run_id: string, source: string, timestamp_utc: string, schemas: array<string>, "
    "tables_total: bigint, tables_ok: bigint, tables_error: bigint>, "
    "tables array<struct<schema: string, table: string, row_count: bigint, error: string>>"
)


def _export(raw: DataFrame, counts: dict[str, tuple[str, ...]]) -> DataFrame:
    names = {"schema": SCHEMA_NAMES, "table_name": TABLE_NAMES, "method": ("method",), **counts}
    cells = resolve_columns(raw, names, ("schema", "table_name"))
    cells["schema"], cells["table_name"] = identifier(cells["schema"]), identifier(cells["table_name"])
    named = raw.select(*[c.alias(f) for f, c in cells.items()])
    return named.where("schema <> '' AND table_name <> ''")


def source_counts(raw: DataFrame) -> DataFrame:
    """(schema, table_name, row_count, method). A failed count stays negative with
    its ERROR method; ``reconcile_threshold`` rates it as an error."""
    export = _export(raw, {"row_count": ("row_count", "count")})
    return export.select("schema", "table_name", to_count(F.col("row_count")).alias("row_count"), "method")


def target_counts(raw: DataFrame) -> DataFrame:
    """(schema, table_name, total_count, active_count); active defaults to total."""
    export = _export(raw, {"total": ("total_count", "row_count", "count"), "active": ("active_count",)})
    total = to_count(F.col("total"))
    return export.select(
        "schema", "table_name", total.alias("total_count"), F.coalesce(F.trim("active").try_cast("bigint"), total).alias("active_count")
    )


def read_source_counts(spark: SparkSession, path: str) -> DataFrame:
    return source_counts(read_delimited(spark, path))


def read_target_counts(spark: SparkSession, path: str) -> DataFrame:
    return target_counts(read_delimited(spark, path))


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All JSON control-total reports of a folder, one row per run and table.

    Names are upper-cased; a table listed twice in a run counts with its last entry. A file holds one report, and its
    name, which carries the time, orders the runs; with ``lines`` files hold a report per line, as
    ``write_nested_reports`` makes them, and runs are those of their summaries.
    """
    reports = spark.read.schema(REPORT_SCHEMA).json(path, multiLine=not lines)
    run = F.col("summary.run_id") if lines else F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    reports = reports.withColumn("run", run)
    rows = reports.select(
        "run", F.posexplode("tables").alias("pos", "t")
    ).select(
        "run", "pos", F.upper("t.schema").alias("schema"), F.upper("t.table").alias("table_name"), "t.row_count", "t.error"
    )
    last = rows.groupBy("run", "schema", "table_name").agg(F.max_by(F.struct("row_count", "error"), "pos").alias("last"))
    return last.select("run", "schema", "table_name", "last.*")


def latest_run(reports: DataFrame) -> DataFrame:
    newest = reports.agg(F.max("run").alias("run")).scalar()
    return reports.where(F.col("run") == newest).drop("run")
