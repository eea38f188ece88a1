"""Control totals and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.ordered import global_rank
from tidelog.operators.state import ORDER, current_state
from tidelog.session import small_table

TableName = tuple[str, str]
TOTALS_SCHEMA = "schema string, table_name string, row_count bigint, error string"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _named(df: DataFrame, name: TableName) -> DataFrame:
    return df.select(F.lit(name[0]).alias("schema"), F.lit(name[1]).alias("table_name"), "*")


def control_totals(spark: SparkSession, tables: Mapping[TableName, Callable[[], DataFrame]]) -> DataFrame:
    """Exact row count per table, counted at once in one job.

    A table that cannot be opened, or fails while it is read, becomes an error row
    instead of failing the run: after a failure the tables are counted in halves.
    """
    opened, rows = [], []
    for name, open_table in tables.items():
        try:
            opened.append((name, _named(open_table().agg(F.count(F.lit(1)).alias("row_count")), name)))
        except AnalysisException as problem:
            rows.append((*name, None, str(problem).splitlines()[0]))
    return small_table(spark, _counted(opened) + rows, TOTALS_SCHEMA)


def _counted(opened: list[tuple[TableName, DataFrame]]) -> list[tuple]:
    """One row per table; a failure is narrowed down to the tables that cause it."""
    if not opened:
        return []
    try:
        return [(*r, None) for r in union_all([df for _, df in opened]).collect()]
    except (PySparkException, Py4JJavaError) as problem:
        if len(opened) == 1:
            return [(*opened[0][0], None, str(problem).splitlines()[0])]
    half = len(opened) // 2
    return _counted(opened[:half]) + _counted(opened[half:])


def totals_summary(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.count(F.lit(1)).alias("tables_total"),
        F.count_if(F.col("error").isNull()).alias("tables_ok"),
        F.count_if(F.col("error").isNotNull()).alias("tables_error"),
    )


def change_counts(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Raw counts over an append-all log. ``active_count`` counts log rows that
    are no deletes, so it grows with every update (see ``live_counts``)."""
    active = F.count_if(F.col("is_deleted") == 0) if "is_deleted" in log.columns else F.count(F.lit(1))
    deleted = F.count_if(F.col("is_deleted") == 1) if "is_deleted" in log.columns else F.lit(0).cast("bigint")
    ops = {"insert_count": "I", "update_count": "U", "delete_count": "D"}
    typed = "op_type" in log.columns
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_count"),
        active.alias("active_count"),
        deleted.alias("deleted_count"),
        *[(F.count_if(F.col("op_type") == code) if typed else F.lit(0).cast("bigint")).alias(n) for n, code in ops.items()],
    )


def live_counts(log: DataFrame, keys: list[str], by: list[str] = (), order: list[str] = ORDER) -> DataFrame:
    """Rows alive after all changes: the number a source count can equal."""
    return current_state(log, keys, order).groupBy(*by).agg(F.count(F.lit(1)).alias("live_count"))


def change_counts_by_table(logs: Mapping[TableName, DataFrame]) -> DataFrame:
    return union_all([_named(change_counts(log), name) for name, log in logs.items()])


def sampled_totals(tables: Mapping[TableName, DataFrame], samples: Mapping[TableName, tuple[Column, float]]) -> DataFrame:
    """Counts where the tables named in ``samples`` are estimated, all others exact.

    A sample is a condition and the share of rows that meets it, so it is repeatable. A condition on
    partition or sorted columns reads fewer files; one on a key's residue saves no reading.
    """
    parts = []
    for name, df in tables.items():
        condition, share = samples.get(name, (F.lit(True), 1.0))
        total = F.round(F.count(F.lit(1)) / F.lit(share)).cast("bigint")
        counted = _named(df.where(condition).agg(total.alias("row_count")), name)
        method = F.lit("SAMPLE" if name in samples else "EXACT").alias("method")
        parts.append(counted.select("*", method, F.lit(share * 100).alias("sample_pct")))
    return union_all(parts)


def statistics_totals(catalog: DataFrame, now: Column) -> DataFrame:
    """Counts from stored statistics and their age; never analysed counts as 365 days."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_analyzed").cast("timestamp"))) / 86400
    return catalog.select(
        "schema",
        "table_name",
        F.coalesce("num_rows", F.lit(0)).cast("bigint").alias("row_count"),
        F.lit("STATS").alias("method"),
        F.coalesce(F.round(age).cast("int"), F.lit(365)).alias("days_stale"),
    )


def map_schemas(totals: DataFrame, routes: DataFrame) -> DataFrame:
    """Rename target schemas to source schemas, so both sides share one name."""
    names = routes.select(
        F.col("schema").alias("__source"), F.upper("target_schema").alias("__target"), F.col("table_name").alias("__table")
    ).distinct()
    same = (F.upper(totals["schema"]) == F.col("__target")) & (F.upper(totals["table_name"]) == F.col("__table"))
    return (
        totals.join(names, same, "left")
        .withColumn("schema", F.coalesce("__source", "schema"))
        .drop("__source", "__target", "__table")
    )


def reconcile(
    source: DataFrame,
    target: DataFrame,
    keys: list[str] = ("schema", "table_name"),
    source_name: str = "ORACLE",
    target_name: str = "SNOWFLAKE",
    show_all: bool = True,
    newest: str | None = None,
) -> DataFrame:
    """Full outer comparison of two sets of totals (row_count, error per key).

    An error outranks a missing side, which outranks the counts. A null count
    compares as 0. Text keys compare in upper case. Of several rows of one key the last
    by ``newest`` counts; without that column an error, else the largest count.
    """
    keys = list(keys)

    def side(df: DataFrame, p: str) -> DataFrame:
        named = [(F.upper(k) if isinstance(df.schema[k].dataType, T.StringType) else F.col(k)).alias(k) for k in keys]
        error = F.nullif("error", F.lit(""))
        rank = [F.col(newest).alias("newest")] if newest else []
        value = F.struct(*rank, error.isNotNull().alias("failed"), F.col("row_count").alias("n"), error.alias("error"))
        last = df.select(*named, value.alias("__value")).groupBy(*keys).agg(F.max("__value").alias("__value"))
        return last.select(
            *keys, F.col("__value.n").alias(f"{p}_count"), F.col("__value.error").alias(f"{p}_error"), F.lit(True).alias(f"{p}_here")
        )

    both = side(source, "source").join(side(target, "target"), keys, "full_outer")
    s_count, t_count = (F.coalesce(f"{p}_count", F.lit(0)) for p in ("source", "target"))
    status = (
        F.when(F.col("source_error").isNotNull(), f"{source_name}_ERROR")
        .when(F.col("target_error").isNotNull(), f"{target_name}_ERROR")
        .when(F.col("source_here").isNull(), f"MISSING_IN_{source_name}")
        .when(F.col("target_here").isNull(), f"MISSING_IN_{target_name}")
        .when(s_count == t_count, "OK")
        .otherwise("MISMATCH")
    )
    result = both.withColumn("status", status).select(
        *keys,
        "source_count",
        "target_count",
        F.when(F.col("status").isin("OK", "MISMATCH"), s_count - t_count).alias("delta"),
        "status",
    )
    return result if show_all else result.where("status <> 'OK'")


def reconcile_summary(result: DataFrame, source_name: str = "ORACLE", target_name: str = "SNOWFLAKE") -> DataFrame:
    """One row; rows missing in the source do not fail the run."""
    n = lambda *words: F.count_if(F.col("status").isin(*words))
    return result.agg(
        F.count(F.lit(1)).alias("tables_compared"),
        n("OK").alias("tables_ok"),
        n("MISMATCH").alias("mismatches"),
        n(f"MISSING_IN_{target_name}").alias("missing_in_target"),
        n(f"MISSING_IN_{source_name}").alias("missing_in_source"),
        n(f"{source_name}_ERROR", f"{target_name}_ERROR").alias("errors"),
    ).withColumn("passed", F.expr("mismatches = 0 AND missing_in_target = 0 AND errors = 0"))


def reconcile_threshold(
    expected: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], threshold_pct: float = 1.0
) -> DataFrame:
    """Counts of every expected entity within a percentage of the source.

    ``source``: keys, row_count[, method]; ``target``: keys, total_count,
    active_count. A negative count or an ERROR method is a failed count and
    never matches. ``side`` tells which input lacks the entity. Text keys compare in upper case. An entity is one row: of several
    counts of a side a failed one outranks others, else the largest counts.
    """
    method = F.col("method") if "method" in source.columns else F.lit(None).cast("string")

    def one(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        named = [(F.upper(k) if isinstance(df.schema[k].dataType, T.StringType) else F.col(k)).alias(k) for k in keys]
        last = df.select(*named, F.struct(*[c.alias(n) for n, c in values.items()]).alias("__value")).groupBy(*keys).agg(F.max("__value").alias("__value"))
        return last.select(*keys, "__value.*").drop("__rank")

    errs = F.coalesce(method.startswith("ERROR"), F.lit(False)) | F.coalesce(F.col("row_count") < 0, F.lit(False))
    left = one(source, {"__rank": errs, "source_count": F.col("row_count"), "__method": method})
    right = one(target, {"target_total": F.col("total_count"), "target_active": F.coalesce("active_count", "total_count")})
    rows = one(expected, {"__rank": F.lit(1)}).join(left, keys, "left").join(right, keys, "left")
    s, t = F.col("source_count"), F.col("target_active")
    failed = (s < 0) | F.coalesce(F.col("__method").startswith("ERROR"), F.lit(False))
    pct = F.when(s == 0, F.when(t == 0, 0.0).otherwise(100.0)).otherwise(F.abs(s - t) / s * 100)
    known = s.isNotNull() & t.isNotNull()
    rows = rows.withColumn("__failed", F.coalesce(failed, F.lit(False))).withColumn("delta_pct", F.when(known & ~F.col("__failed"), pct))
    status = (
        F.when(F.col("__failed"), "ERROR")
        .when(F.col("delta_pct").isNull(), "MISSING")
        .when(F.col("delta_pct") <= threshold_pct, "MATCH")
        .otherwise("MISMATCH")
    )
    side = F.when(F.col("status") != "MISSING", F.lit(None)).when(t.isNull(), "target").otherwise("source")
    return (
        rows.withColumn("delta", F.when(known & ~F.col("__failed"), s - t))
        .withColumn("status", status)
        .withColumn("side", side)
        .select(*keys, "source_count", "target_total", "target_active", "delta", "delta_pct", "status", "side")
    )


def report_order(result: DataFrame, keys: list[str], place: str | None = None) -> DataFrame:
    """Matches first, then by name; with ``place`` the rows are numbered in that order."""
    marked = result.withColumn("__other", F.col("status") != "MATCH")
    order = [F.asc("__other"), *[F.asc(k) for k in keys]]
    return (global_rank(marked, order, place) if place else marked.orderBy(*order)).drop("__other")
