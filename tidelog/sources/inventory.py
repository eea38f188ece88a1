"""Routing inventory: flexible headers, defaults, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators.routes import keep_first, normalise_routes

# Header names accepted for each field.
ALIASES = {
    "schema": ("schema", "schema_name", "owner", "source_schema"),
    "table_name": ("table_name", "tablename", "table", "name", "object_name"),
    "target_schema": ("target_schema", "target_schema_name", "tgt_schema", "snowflake_schema"),
    "group_id": ("group_id", "group", "extract_group"),
    "enabled": ("enabled", "active", "status"),
    "disabled_reason": ("disabled_reason", "reason", "disable_reason"),
    "disabled_at": ("disabled_at", "disabled_date", "disabled_timestamp"),
    "excluded_columns": ("excluded_columns", "exclude_columns", "colsexcept", "pii_columns"),
    "target": ("target", "target_type", "replication_target", "destination"),
    "rds_target_schema": ("rds_target_schema", "rds_schema", "target_rds_schema", "oracle_target_schema"),
}
REQUIRED = ("schema", "table_name", "group_id")
FILE_POSITION = ("__file", "__block", "__row")


def clean_header(name: str) -> str:
    return name.lstrip("﻿").strip().lower()


def read_delimited(spark: SparkSession, path: str, keep_position: bool = False) -> DataFrame:
    """CSV, or TSV by file name, as text: header and cells trimmed, blank cells
    null, blank rows gone, short rows filled with nulls.

    ``keep_position`` adds columns that give the order of rows inside a file.
    """
    sep = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    raw = spark.read.csv(
        path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8", mode="PERMISSIVE"
    )
    columns = [text.cell(F.col(f"`{c}`")).alias(clean_header(c)) for c in raw.columns]
    if keep_position:
        position = ("_metadata.file_path", "_metadata.file_block_start")
        raw = raw.select("*", *[F.col(p).alias(n) for p, n in zip(position, FILE_POSITION)])
        raw = raw.withColumn(FILE_POSITION[2], F.monotonically_increasing_id())
        return raw.select(*columns, *FILE_POSITION).dropna("all", subset=[clean_header(c) for c in raw.columns[:-3]])
    return raw.select(*columns).dropna("all")


def resolve(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first column, in file order, that is one of the names."""
    return next((c for c in columns if clean_header(c) in aliases), None)


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> dict[str, Column]:
    found = {field: resolve(df.columns, names) for field, names in aliases.items()}
    lacking = [field for field in required if found[field] is None]
    if lacking:
        raise ValueError(f"missing columns {lacking}; found {sorted(clean_header(c) for c in df.columns)}")
    return {
        field: (F.col(f"`{c}`").cast("string") if c is not None else F.lit(None).cast("string")) for field, c in found.items()
    }


def parse_inventory(raw: DataFrame, order: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(routes, rejects) from inventory text cells.

    Rows without schema or table, or with a bad group id, are rejected with a
    reason; with ``strict`` a bad group id fails the job. Of repeated tables the
    first in ``order`` stays. An unknown target becomes the default one and sets
    ``target_warning``.
    """
    cells = {f: text.cell(c) for f, c in resolve_columns(raw, ALIASES, REQUIRED).items()}
    df = raw.select(*[c.alias(f) for f, c in cells.items()], *order)
    group = F.col("group_id").try_cast("int")
    if strict:
        complaint = F.concat(F.lit("group_id must be an integer: "), F.coalesce("group_id", F.lit("(missing)")))
        named = F.col("schema").isNotNull() & F.col("table_name").isNotNull()
        df = df.withColumn("group_id", F.when(named & group.isNull(), F.raise_error(complaint)).otherwise(F.col("group_id")))
    reason = (
        F.when(F.col("schema").isNull() | F.col("table_name").isNull(), "empty schema or table_name")
        .when(group.isNull(), "group_id is not an integer")
    )
    marked = df.withColumn("reason", reason)
    rejects = marked.where("reason IS NOT NULL")
    good = marked.where("reason IS NULL").drop("reason").withColumns(
        {
            "group_id": group,
            "enabled": text.is_on(F.col("enabled")),
            "disabled_reason": F.coalesce("disabled_reason", F.lit("")),
            "disabled_at": F.coalesce("disabled_at", F.lit("")),
            "excluded_columns": text.name_list(F.col("excluded_columns")),
            "target_warning": F.coalesce(~F.lower("target").isin("snowflake", "rds", "both"), F.lit(False)),
        }
    )
    return keep_first(normalise_routes(good), ["fqn"], order), rejects


def read_inventory(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Inventory file to (routes, rejects); an inventory without usable rows is an error."""
    order = list(FILE_POSITION)
    routes, rejects = parse_inventory(read_delimited(spark, path, keep_position=True), order, strict)
    if routes.isEmpty():
        raise ValueError(f"no usable rows in {path}")
    return routes.drop(*order), rejects
