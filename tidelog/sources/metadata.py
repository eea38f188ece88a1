"""Column metadata and table profile exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import identifier, to_int
from tidelog.operators.profile import fill_profile
from tidelog.sources.inventory import clean_header, read_delimited

TEXT_FIELDS = ("owner", "table_name", "column_name", "data_type", "nullable")
NUMBER_FIELDS = ("data_length", "data_precision", "data_scale", "column_id")
BAD_LINE = "_bad_line"


def columns_from(raw: DataFrame, complete: bool = False) -> DataFrame:
    """Typed column metadata. Separator rows and repeated headers are skipped;
    ``complete`` also drops rows without owner, table, column or type."""
    have = set(raw.columns)
    cell = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    df = raw.select(
        *[identifier(cell(c)).alias(c) for c in TEXT_FIELDS], *[to_int(cell(c)).alias(c) for c in NUMBER_FIELDS]
    ).fillna({"data_length": 0, "column_id": 0, "nullable": "Y"})
    df = df.where(F.col("owner").isNotNull() & ~F.col("owner").startswith("-") & (F.col("owner") != "OWNER"))
    return df.dropna("any", subset=list(TEXT_FIELDS[:4])) if complete else df


def read_columns(spark: SparkSession, path: str, complete: bool = False) -> DataFrame:
    return columns_from(read_delimited(spark, path), complete)


def read_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profile, malformed lines) from a profile export with any known columns.

    Lines with too few or too many cells are malformed. Only the header line is
    read on the driver.
    """
    lines = spark.read.text(path)
    header = lines.first()[0]
    names = [clean_header(c.strip('"')) for c in header.split(",")]
    schema = ", ".join(f"`{c}` string" for c in names) + f", {BAD_LINE} string"
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE,
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    }
    body = lines.where((F.col("value") != header) & (F.trim("value") != ""))
    rows = body.select("value", F.from_csv("value", F.lit(schema), options).alias("r"))
    bad = F.col(f"r.{BAD_LINE}").isNotNull()
    good = rows.where(~bad).select(*[F.col(f"r.`{c}`").alias(c) for c in names])
    return fill_profile(good), rows.where(bad).select(F.col("value").alias("line"))
