"""Key quality and readiness of tables for replication."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.profile import LOB_TYPES
from tidelog.session import small_table


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def key_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: can these columns serve as the key of a mirror?"""
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return (
        per_key.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.coalesce(F.sum(F.when(null, F.col("copies"))), F.lit(0)).alias("null_key_rows"),
            F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
        )
        .withColumn("passed", F.expr("null_key_rows = 0 AND duplicate_keys = 0"))
    )


def key_columns(constraints: DataFrame, constraint_columns: DataFrame) -> DataFrame:
    """Primary-key columns per table, in key order, as one text (a key has few columns)."""
    primary = constraints.where("constraint_type = 'P'").select("owner", "table_name", "constraint_name")
    joined = constraint_columns.select("owner", "constraint_name", "column_name", "position").join(
        primary, ["owner", "constraint_name"]
    )
    return joined.groupBy("owner", "table_name").agg(
        F.expr("listagg(column_name, ',') WITHIN GROUP (ORDER BY position)").alias("pk_columns")
    )


def ordered_columns(columns: DataFrame) -> DataFrame:
    """Column names of each table in declared order (databases limit them to about 1000)."""
    return columns.groupBy("owner", "table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column_id", "column_name"))), lambda c: c.column_name).alias("columns")
    )


def readiness(
    routes: DataFrame, tables: DataFrame, keyed: DataFrame, columns: DataFrame, logged: DataFrame
) -> DataFrame:
    """Existence, key, large-object and logging checks of every routed table.

    ``tables`` and ``logged`` hold (owner, table_name), ``keyed`` adds pk_columns,
    ``columns`` adds data_type. A missing table fails no further check.
    """
    by = ["owner", "table_name"]
    mark = lambda df, name: df.select(*by).distinct().withColumn(name, F.lit(True))
    large = columns.where(F.col("data_type").isin(*LOB_TYPES))
    out = routes.select("fqn", F.col("schema").alias("owner"), "table_name")
    for side in (mark(tables, "__exists"), keyed.select(*by, "pk_columns"), mark(large, "__lob"), mark(logged, "__logged")):
        out = out.join(side, by, "left")
    exists = F.col("__exists").isNotNull()
    return out.select(
        "fqn",
        "pk_columns",
        (~exists).alias("missing"),
        (exists & F.col("pk_columns").isNull()).alias("no_pk"),
        (exists & F.col("__logged").isNull()).alias("no_logging"),
        (exists & F.col("__lob").isNotNull()).alias("has_lob"),
    )


# How many names each list of the report shows.
SHOWN = {"missing": 20, "no_pk": 20, "no_logging": 20, "has_lob": 10}


def readiness_lists(checks: DataFrame, shown: dict[str, int] = SHOWN) -> DataFrame:
    """Per check: the first failing names and how many more there are.

    Names are cut to the shown number per task before they are gathered.
    """
    failing = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in shown]))
    hits = checks.select("fqn", F.explode(failing).alias("check"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in shown.items() for x in pair]), F.col("check"))
    first = Window.partitionBy("check").orderBy("fqn")
    names = (
        hits.withColumn("__rn", F.row_number().over(first))
        .where(F.col("__rn") <= max(shown.values()))
        .where(F.col("__rn") <= limit)
        .groupBy("check")
        .agg(F.array_sort(F.collect_list("fqn")).alias("names"))
    )
    totals = hits.groupBy("check").agg(F.count(F.lit(1)).alias("__total"))
    listed = small_table(checks.sparkSession, list(shown.items()), "check string, __shown int")
    return (
        listed.join(totals, "check", "left")
        .join(names, "check", "left")
        .select(
            "check",
            F.coalesce("names", F.array().cast("array<string>")).alias("names"),
            F.greatest(F.coalesce("__total", F.lit(0)) - F.col("__shown"), F.lit(0)).alias("more"),
        )
    )


def readiness_summary(checks: DataFrame) -> DataFrame:
    """Logging and large objects are reported but do not fail the check."""
    n = F.count_if
    return checks.agg(
        F.count(F.lit(1)).alias("checked"),
        n(~F.col("missing") & ~F.col("no_pk")).alias("ok"),
        n("missing").alias("missing"),
        n("no_pk").alias("no_pk"),
        n("no_logging").alias("no_logging"),
        n("has_lob").alias("has_lob"),
    ).withColumn("passed", F.expr("missing = 0 AND no_pk = 0"))
