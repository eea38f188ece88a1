"""Tables of a catalog, of files, or of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, format: str, location: str | None = None, schema=None, **options: str) -> DataFrame:
    """Any Spark source by format and options (parquet, orc, csv, json, jdbc, ...)."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(location) if location else reader.load()


def read_database(
    spark: SparkSession, url: str, query_table: str, split_on: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """A database table read by ``parts`` parallel range scans (needs the JDBC driver jar)."""
    return read_table(
        spark, "jdbc", url=url, dbtable=query_table, partitionColumn=split_on,
        lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options,
    )


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """Table names of a schema in order."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def only_schemas(rows: DataFrame, schemas: list[str] | None, tables: DataFrame | None = None) -> DataFrame:
    """Keep rows of some schemas and, if given, of listed tables (fqn) in them."""
    if schemas:
        rows = rows.where(F.upper("owner").isin([s.strip().upper() for s in schemas]))
    if tables is None:
        return rows
    named = rows.withColumn("fqn", F.concat_ws(".", F.upper("owner"), F.upper("table_name")))
    return named.join(tables.select("fqn").distinct(), "fqn", "left_semi").drop("fqn")
