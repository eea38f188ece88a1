"""Routing dimension: which entity goes where, and applying it to a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import choice, identifier, qualified

# Target words and what each stands for.
WAREHOUSE, MIRROR, BOTH = "snowflake", "rds", "both"
TARGETS = (WAREHOUSE, MIRROR, BOTH)


def target_list(target: Column) -> Column:
    """``both`` fans out to two targets."""
    return (
        F.when(target == BOTH, F.array(F.lit(WAREHOUSE), F.lit(MIRROR)))
        .otherwise(F.array(target))
    )


def normalise_routes(inventory: DataFrame) -> DataFrame:
    """Routing rows with canonical names, targets and default target schemas."""
    schema, table = identifier(F.col("schema")), identifier(F.col("table_name"))
    or_source = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), schema)
    return inventory.withColumns(
        {
            "schema": schema,
            "table_name": table,
            "fqn": qualified(schema, table),
            "target": choice(F.col("target"), TARGETS, WAREHOUSE),
            "target_schema": or_source("target_schema"),
            "rds_target_schema": or_source("rds_target_schema"),
        }
    ).withColumn("targets", target_list(F.col("target")))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order (a group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def apply_overrides(routes: DataFrame, overrides: DataFrame) -> DataFrame:
    """The latest enable/disable entry per table replaces the inventory's flag.

    ``overrides`` is an append-only log (fqn, enabled, reason, changed_at).
    """
    newest = Window.partitionBy("fqn").orderBy(F.desc("changed_at"), F.asc("enabled"))
    latest = (
        overrides.withColumn("__rn", F.row_number().over(newest))
        .where("__rn = 1")
        .select("fqn", F.col("enabled").alias("__on"), F.col("reason").alias("__why"), F.col("changed_at").alias("__at"))
    )
    joined = routes.join(latest, "fqn", "left")
    was_set = F.col("__on").isNotNull()
    off = was_set & ~F.col("__on")
    return joined.withColumns(
        {
            "enabled": F.coalesce("__on", "enabled"),
            "disabled_reason": F.when(off, F.coalesce(F.nullif("__why", F.lit("")), F.lit("manually disabled")))
            .when(was_set, "")
            .otherwise(F.col("disabled_reason")),
            "disabled_at": F.when(off, F.date_format("__at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(was_set, "")
            .otherwise(F.col("disabled_at")),
        }
    ).drop("__on", "__why", "__at")


def require_active(routes: DataFrame) -> DataFrame:
    """Enabled routes; an inventory without any is an error, not an empty run."""
    active = routes.where("enabled")
    if active.isEmpty():
        raise ValueError("no enabled tables in the inventory")
    return active


def route_changes(log: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per change and target, with the schema it goes to.

    Only the needed route columns travel. No broadcast hint: Spark broadcasts
    the dimension when its measured size allows and else splits skewed tables.
    """
    wanted = routes.where("enabled").select("fqn", "table_name", "targets", "target_schema", "rds_target_schema")
    routed = log.join(wanted, "fqn").withColumn("target", F.explode("targets"))
    schema = F.when(F.col("target") == MIRROR, F.col("rds_target_schema")).otherwise(F.col("target_schema"))
    return routed.withColumn("target_schema", schema).drop("targets", "rds_target_schema")


def routes_for(routes: DataFrame, target: str) -> DataFrame:
    return routes.where(F.array_contains("targets", target))


def target_summary(routes: DataFrame) -> DataFrame:
    """Per group: tables with one target only, with both, and per-target totals."""
    hits = lambda *words: F.count_if(F.col("target").isin(*words))
    return routes.where("enabled").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("tables"),
        hits(WAREHOUSE).alias("warehouse_only"),
        hits(MIRROR).alias("mirror_only"),
        hits(BOTH).alias("both"),
        hits(WAREHOUSE, BOTH).alias("to_warehouse"),
        hits(MIRROR, BOTH).alias("to_mirror"),
    )


def group_members(rows: DataFrame, group: str, member: str, name: str) -> DataFrame:
    """Sorted distinct members per group, for member domains that are small
    (schemas of a group): the distinct step runs before anything is collected."""
    return (
        rows.select(group, member).distinct()
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(member)).alias(name))
    )


def status_report(rows: DataFrame, group: str, name: str, enabled: Column, order: list[str], shown: int = 3) -> DataFrame:
    """Per group: enabled, disabled and total rows, and the first disabled names."""
    counts = rows.groupBy(group).agg(
        F.count_if(enabled).alias("enabled"), F.count_if(~enabled).alias("disabled"), F.count(F.lit(1)).alias("total")
    )
    first = Window.partitionBy(group).orderBy(*order)
    names = (
        rows.where(~enabled)
        .withColumn("__rn", F.row_number().over(first))
        .where(F.col("__rn") <= shown)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("__rn", name))).getField(name).alias("__names"))
    )
    more = F.greatest(F.col("disabled") - shown, F.lit(0))
    text = F.concat(
        F.coalesce(F.array_join("__names", ", "), F.lit("")),
        F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""),
    )
    return counts.join(names, group, "left").withColumn("disabled_names", text).drop("__names")


def most_common(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent value per key; a tie goes to the value seen first.

    ``values`` tells how many different ones the key has, for warnings.
    """
    per_value = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first")
    )
    return per_value.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("__n"), "__first")).alias(value),
        F.max("__n").alias("occurrences"),
        F.count(F.lit(1)).alias("values"),
    )


def oversized_groups(rows: DataFrame, group: str, limit: int = 75) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > limit)


def routes_from_profile(profile: DataFrame, schema_map: DataFrame | None = None) -> DataFrame:
    """Inventory rows for a grouped profile; ``schema_map`` holds (owner, target_schema)."""
    if schema_map is None:
        mapped = profile.withColumn("target_schema", F.upper("owner"))
    else:
        lookup = schema_map.select(F.upper("owner").alias("__o"), F.col("target_schema").alias("__t"))
        mapped = (
            profile.join(lookup, F.upper(profile["owner"]) == F.col("__o"), "left")
            .withColumn("target_schema", F.coalesce("__t", F.upper("owner")))
            .drop("__o", "__t")
        )
    return mapped.select(
        F.col("owner").alias("schema"),
        "table_name",
        "target_schema",
        "group_id",
        F.lit("Y").alias("enabled"),
        "profile",
        F.round("extract_cost").cast("bigint").alias("extract_cost"),
        F.round("byte_throughput").cast("bigint").alias("byte_throughput"),
        *[c for c in ("num_rows", "churn_rate", "lob_count", "needs_keycols") if c in mapped.columns],
    ).orderBy("group_id", "schema", "table_name")
