"""Change-activity profile: how much an entity changes, what it costs, its class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import score
from tidelog.functions.text import to_number

# Column defaults of an incomplete profile.
NUMBER_DEFAULTS = {
    "inserts": 0, "updates": 0, "deletes": 0, "num_rows": 0, "avg_row_len": 100,
    "segment_mb": 0, "dml_total": 0, "dml_cost": 0, "byte_throughput": 0,
    "churn_rate": 0, "update_pct": 0, "col_count": 10, "lob_count": 0,
    "partition_count": 0, "days_since_analyze": 0,
}
TEXT_DEFAULTS = {"has_pk": "Y", "partitioned": "NO"}
LOB_TYPES = ("BLOB", "CLOB", "NCLOB", "LONG", "LONG RAW")
# Owners of the source database itself.
SYSTEM_OWNERS = (
    "SYS", "SYSTEM", "DBSNMP", "SYSMAN", "OUTLN", "MDSYS", "ORDSYS", "EXFSYS",
    "DMSYS", "WMSYS", "CTXSYS", "ANONYMOUS", "XDB", "ORDDATA", "ORDPLUGINS",
    "SI_INFORMTN_SCHEMA", "OLAPSYS", "MDDATA", "APEX_030200", "APEX_PUBLIC_USER",
    "FLOWS_FILES", "OWBSYS", "OWBSYS_AUDIT", "AURORA$ORB$UNAUTHENTICATED",
    "LBACSYS", "OJVMSYS", "GSMADMIN_INTERNAL", "APPQOSSYS", "GSMCATUSER",
    "GSMUSER", "DIP", "AUDSYS", "RDSADMIN",
)


def user_tables(tables: DataFrame) -> DataFrame:
    """Ordinary tables: no system owner, temporary, index-organised or nested one."""
    return tables.where(
        ~F.col("owner").isin(*SYSTEM_OWNERS)
        & (F.col("temporary") == "N")
        & F.col("iot_type").isNull()
        & (F.col("nested") == "NO")
    )


def change_activity(log: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts, updates and deletes per entity, counted map-side first."""
    count = lambda code: F.count_if(F.col("op_type") == code)
    return log.groupBy(*keys).agg(count("I").alias("inserts"), count("U").alias("updates"), count("D").alias("deletes"))


def column_counts(columns: DataFrame) -> DataFrame:
    return columns.groupBy("owner", "table_name").agg(
        F.count(F.lit(1)).alias("col_count"), F.count_if(F.col("data_type").isin(*LOB_TYPES)).alias("lob_count")
    )


def partition_counts(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("owner", "table_name").agg(F.count(F.lit(1)).alias("partition_count"))


def profile_columns(profile: DataFrame) -> DataFrame:
    """Derived measures from counts, row length and row count (nulls count as 0,
    a missing row length as 100)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    i, u, d = zero("inserts"), zero("updates"), zero("deletes")
    length = F.coalesce(F.col("avg_row_len"), F.lit(100))
    rows = zero("num_rows")
    total = score.change_total(i, u, d)
    return profile.withColumns(
        {
            "inserts": i, "updates": u, "deletes": d, "num_rows": rows, "avg_row_len": length,
            "dml_total": total,
            "dml_cost": score.weighted_changes(i, u, d),
            "byte_throughput": F.round(score.byte_throughput(i, u, d, length)),
            "churn_rate": F.round(score.churn(total, rows), 4),
            "update_pct": F.round(F.when(total > 0, u * 100.0 / total).otherwise(0.0), 1),
        }
    )


def activity_profile(log: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity of the snapshot (keys, num_rows, avg_row_len) with its activity."""
    return profile_columns(snapshot.join(change_activity(log, keys), keys, "left"))


def table_profile(
    tables: DataFrame, activity: DataFrame, segments: DataFrame, columns: DataFrame,
    partitions: DataFrame, primary_keys: DataFrame, now: Column,
) -> DataFrame:
    """The profile of dictionary tables: five left joins of reduced sides.

    ``activity`` rows of single partitions and ``segments`` of other types are
    dropped before the joins.
    """
    by = ["owner", "table_name"]
    moved = activity.where("partition_name IS NULL").select(*by, "inserts", "updates", "deletes")
    sized = segments.where("segment_type = 'TABLE'").select(*by, F.round(F.col("bytes") / 1048576, 2).alias("segment_mb"))
    keyed = primary_keys.where("constraint_type = 'P'").select(*by).distinct().withColumn("has_pk", F.lit("Y"))
    joined = user_tables(tables)
    for side in (moved, sized, column_counts(columns), partition_counts(partitions), keyed):
        joined = joined.join(side, by, "left")
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_analyzed").cast("timestamp"))) / 86400
    return profile_columns(
        joined.withColumns(
            {
                "segment_mb": F.coalesce("segment_mb", F.lit(0.0)),
                "col_count": F.coalesce("col_count", F.lit(0)),
                "lob_count": F.coalesce("lob_count", F.lit(0)),
                "partition_count": F.coalesce("partition_count", F.lit(0)),
                "has_pk": F.coalesce("has_pk", F.lit("N")),
                "days_since_analyze": F.coalesce(F.round(age).cast("int"), F.lit(365)),
            }
        )
    )


def report_order(profile: DataFrame) -> DataFrame:
    return profile.orderBy("owner", F.desc("byte_throughput"), F.desc("num_rows"), "table_name")


def fill_profile(profile: DataFrame) -> DataFrame:
    """Lower-case the header, add missing columns, turn bad numbers into defaults."""
    df = profile.toDF(*[c.strip().lower() for c in profile.columns])
    have = set(df.columns)
    numbers = {
        c: to_number(F.col(c), d) if c in have else F.lit(float(d)) for c, d in NUMBER_DEFAULTS.items()
    }
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d) for c, d in TEXT_DEFAULTS.items()}
    return df.withColumns({**numbers, **texts})


def _rebuilt(empty: dict[str, Column], weights: score.CostWeights) -> dict[str, Column]:
    i, u, d = F.col("inserts"), F.col("updates"), F.col("deletes")
    fresh = {
        "dml_total": i + u + d,
        "byte_throughput": score.byte_throughput(i, u, d, F.col("avg_row_len"), weights),
        "churn_rate": score.churn(i + u + d, F.col("num_rows")),
    }
    return {c: F.when(empty[c], value).otherwise(F.col(c)) for c, value in fresh.items()}


def _is_empty(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)) == 0


def rebuild_empty_measures(profile: DataFrame, weights: score.CostWeights = score.CostWeights()) -> DataFrame:
    """Throughput, churn and change totals that are 0 everywhere are recomputed
    (exports of older queries lack them). One scalar query decides for all rows."""
    measures = ("byte_throughput", "churn_rate", "dml_total")
    probe = profile.agg(F.struct(*[_is_empty(c).alias(c) for c in measures]).alias("empty")).scalar()
    marked = profile.withColumn("__empty", probe)
    empty = {c: F.col(f"__empty.{c}") for c in measures}
    return marked.withColumns(_rebuilt(empty, weights)).drop("__empty")


def score_profile(
    profile: DataFrame, weights: score.CostWeights = score.CostWeights(), limits: score.ClassLimits = score.ClassLimits()
) -> DataFrame:
    """Composite cost, cost on a 0-1000 scale, class, and the missing-key flag.

    ``profile`` is evaluated twice: once for three sums and the highest cost, once
    for the rows. Pass a materialised one if that is expensive.
    """
    measures = ("byte_throughput", "churn_rate", "dml_total")
    cost = lambda b: score.composite_cost(b, F.col("lob_count"), F.col("partition_count"), F.col("col_count"), weights)
    always = {c: F.lit(True) for c in measures}
    # The highest cost for both outcomes of the emptiness check, so that one pass suffices.
    probe = profile.agg(
        F.struct(
            *[_is_empty(c).alias(c) for c in measures],
            F.when(_is_empty("byte_throughput"), F.max(cost(_rebuilt(always, weights)["byte_throughput"])))
            .otherwise(F.max(cost(F.col("byte_throughput"))))
            .alias("highest"),
        ).alias("probe")
    ).scalar()
    marked = profile.withColumn("__probe", probe)
    rebuilt = marked.withColumns(_rebuilt({c: F.col(f"__probe.{c}") for c in measures}, weights))
    highest = F.col("__probe.highest")
    costed = rebuilt.withColumn("extract_cost", cost(F.col("byte_throughput")))
    return costed.withColumns(
        {
            "cost_normalized": F.when(highest > 0, F.round(F.col("extract_cost") / highest * 1000, 1)).otherwise(0.0),
            "profile": score.activity_class(F.col("churn_rate"), F.col("dml_total"), F.col("byte_throughput"), limits),
            "needs_keycols": F.upper("has_pk") == "N",
        }
    ).drop("__probe")


def class_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("profile").agg(
        F.count(F.lit(1)).alias("tables"), F.round(F.avg("extract_cost"), 2).alias("avg_cost")
    )


def heaviest(rows: DataFrame, measure: str, tie_break: list[str], n: int = 20) -> DataFrame:
    """Top rows by a measure; planned as a per-task top-n, not a full sort."""
    return rows.orderBy(F.desc(measure), *tie_break).limit(n)


def group_plan(grouped: DataFrame, min_size: int = 50) -> DataFrame:
    """Per group: size, schemas, costs, class counts and what is wrong with it."""
    heavy = F.col("profile").isin("BATCH_HEAVY", "OLTP_HEAVY")
    plan = grouped.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("tables"),
        # Distinct schema names of one group: a small domain by design.
        F.array_join(F.array_sort(F.collect_set("owner")), ", ").alias("schemas"),
        F.sum("extract_cost").alias("total_cost"),
        F.sum("byte_throughput").alias("total_bytes"),
        F.count_if("needs_keycols").alias("no_pk_count"),
        F.count_if(F.col("profile") == "OLTP_HEAVY").alias("oltp_heavy"),
        F.count_if(F.col("profile") == "BATCH_HEAVY").alias("batch_heavy"),
        F.count_if(F.col("lob_count") > 0).alias("lob_tables"),
        F.count_if(heavy).alias("__heavy"),
    )
    flag = lambda c, word: F.when(c, F.lit(word))
    flags = F.array_compact(
        F.array(
            flag(F.col("batch_heavy") > 2, "MANY_BATCH_HEAVY"),
            flag((F.col("__heavy") > 0) & (F.col("__heavy") == F.col("tables")), "ONLY_HEAVY"),
            flag((F.col("lob_tables") > 0) & (F.col("total_bytes") > 10_000_000), "LOB_MIX"),
            flag(F.col("tables") < min_size, "BELOW_MIN"),
        )
    )
    return plan.withColumn("flags", F.array_join(flags, ",")).drop("__heavy")


def plan_balance(plan: DataFrame) -> DataFrame:
    """One row over all groups: imbalance of cost and what it is called."""
    lowest, highest = F.min("total_cost"), F.max("total_cost")
    return (
        plan.agg(
            F.count(F.lit(1)).alias("groups"),
            score.imbalance_pct(lowest, highest).alias("imbalance_pct"),
            ((highest - lowest) / F.greatest(highest, F.lit(1)) * 100).alias("__preview"),
        )
        .withColumn("balance", score.balance_word(F.col("__preview")))
        .withColumn("warn", F.col("imbalance_pct") > 40)
        .drop("__preview")
    )
