"""Activity profile, scoring and grouping plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.functions.score import ClassLimits
from tidelog.operators import balance, profile, quality, routes
from tidelog.operators.ordered import shared_checkpoint
from tidelog.plans.base import LOG_SQL, Registry, event_log, table

REGISTRY = Registry()
query = REGISTRY.add


def _customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables: their orders are the rows, their events the changes."""
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("num_rows"))
    snapshot = (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("k"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("owner"),
            F.col("c_name").alias("table_name"),
            F.when(F.col("c_nationkey") != 3, 50 + F.col("c_nationkey") * 10).alias("avg_row_len"),
            F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0).alias("lob_count"),
            F.when(F.col("c_mktsegment") == "MACHINERY", 4).otherwise(0).alias("partition_count"),
            (F.col("c_custkey") % 120).cast("int").alias("col_count"),
            F.when(F.col("c_custkey") % 11 == 0, "n").otherwise("Y").alias("has_pk"),
        )
        .join(sizes, "k", "left")
    )
    return profile.activity_profile(event_log(spark, sf_dir), snapshot, ["k"])


PROFILE_SQL = LOG_SQL + """, activity AS (
  SELECT k, count(*) FILTER (op_type = 'I') AS inserts, count(*) FILTER (op_type = 'U') AS updates,
         count(*) FILTER (op_type = 'D') AS deletes FROM log GROUP BY k),
base AS (
  SELECT c_custkey AS k, 'NATION_' || c_nationkey AS owner, c_name AS table_name,
    coalesce(n, 0) AS num_rows, CASE WHEN c_nationkey <> 3 THEN 50 + c_nationkey * 10 ELSE 100 END AS avg_row_len,
    coalesce(inserts, 0) AS inserts, coalesce(updates, 0) AS updates, coalesce(deletes, 0) AS deletes,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END AS lob_count,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 4 ELSE 0 END AS partition_count,
    CAST(c_custkey % 120 AS INTEGER) AS col_count, CASE WHEN c_custkey % 11 = 0 THEN 'n' ELSE 'Y' END AS has_pk
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
  LEFT JOIN activity ON k = c_custkey),
prof AS (
  SELECT *, inserts + updates + deletes AS dml_total, inserts + 2 * updates + deletes AS dml_cost,
    inserts * avg_row_len + updates * avg_row_len * 2 + deletes * 64 AS byte_throughput,
    CASE WHEN num_rows > 0 THEN round((inserts + updates + deletes) / CAST(num_rows AS DOUBLE), 4) ELSE 0 END AS churn_rate,
    CASE WHEN inserts + updates + deletes > 0
         THEN CAST(round(updates * 100.0 / (inserts + updates + deletes), 1) AS DOUBLE) ELSE 0 END AS update_pct
  FROM base)
"""
PROFILE_COLUMNS = [
    "k", "owner", "table_name", "num_rows", "avg_row_len", "inserts", "updates", "deletes", "dml_total",
    "dml_cost", "byte_throughput", "churn_rate", "update_pct",
]


@query("activity_profile", PROFILE_SQL + f"SELECT {', '.join(PROFILE_COLUMNS)} FROM prof")
def activity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_profile(spark, sf_dir).select(*PROFILE_COLUMNS)


# Limits scaled down to the test tables, so that every class occurs.
SMALL_LIMITS = ClassLimits(churn_high=9.0, churn_low=6.0, batch_changes=70, batch_bytes=20_000, busy_bytes=21_000, busy_changes=72)
_L = SMALL_LIMITS
SCORE_SQL = PROFILE_SQL + f""", costed AS (
  SELECT *, CAST(byte_throughput + lob_count * 50000 + partition_count * 5000 + greatest(col_count - 80, 0) * 200 AS BIGINT) AS extract_cost
  FROM prof),
scored AS (
  SELECT *, round(extract_cost / CAST((SELECT max(extract_cost) FROM costed) AS DOUBLE) * 1000, 1) AS cost_normalized,
    upper(has_pk) = 'N' AS needs_keycols,
    CASE WHEN dml_total = 0 THEN 'REFERENCE'
         WHEN churn_rate >= {_L.churn_high} THEN CASE WHEN byte_throughput > 0 THEN 'OLTP_HEAVY' ELSE 'OLTP_LIGHT' END
         WHEN churn_rate <= {_L.churn_low} THEN CASE WHEN dml_total > {_L.batch_changes} OR byte_throughput > {_L.batch_bytes} THEN 'BATCH_HEAVY' ELSE 'BATCH_LIGHT' END
         WHEN byte_throughput > {_L.busy_bytes} OR dml_total > {_L.busy_changes} THEN 'OLTP_HEAVY'
         WHEN dml_total > {_L.batch_changes} THEN 'OLTP_LIGHT' ELSE 'REFERENCE' END AS profile
  FROM costed)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile is one row per entity, and read several times: written once."""
    entities = shared_checkpoint(_customer_profile(spark, sf_dir))
    return profile.score_profile(entities, limits=SMALL_LIMITS)


@query("score_classify", SCORE_SQL + "SELECT k, extract_cost, cost_normalized, profile, needs_keycols FROM scored")
def score_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("k", F.col("extract_cost").cast("bigint").alias("extract_cost"), "cost_normalized", "profile", "needs_keycols")


@query(
    "class_distribution",
    SCORE_SQL + "SELECT profile, count(*) AS tables, round(avg(extract_cost), 2) AS avg_cost FROM scored GROUP BY profile",
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_distribution(_scored(spark, sf_dir))


PER_GROUP = 75
SNAKE = f"CASE WHEN ((rank - 1) // {{n}}) % 2 = 0 THEN (rank - 1) % {{n}} + 1 ELSE {{n}} - (rank - 1) % {{n}} END"
GROUPED_SQL = SCORE_SQL + f""", ranked AS (
  SELECT *, row_number() OVER (ORDER BY extract_cost DESC, owner, table_name) AS rank, greatest(1, (count(*) OVER () + {PER_GROUP - 1}) // {PER_GROUP}) AS groups
  FROM scored),
grouped AS (SELECT *, {SNAKE.format(n='groups')} AS group_id FROM ranked),
plan AS (
  SELECT group_id, count(*) AS tables, string_agg(DISTINCT owner, ', ' ORDER BY owner) AS schemas,
    CAST(sum(extract_cost) AS BIGINT) AS total_cost, CAST(sum(byte_throughput) AS BIGINT) AS total_bytes,
    count(*) FILTER (needs_keycols) AS no_pk_count, count(*) FILTER (profile = 'OLTP_HEAVY') AS oltp_heavy,
    count(*) FILTER (profile = 'BATCH_HEAVY') AS batch_heavy, count(*) FILTER (lob_count > 0) AS lob_tables FROM grouped GROUP BY group_id),
flagged AS (
  SELECT *, concat_ws(',', CASE WHEN batch_heavy > 2 THEN 'MANY_BATCH_HEAVY' END,
    CASE WHEN oltp_heavy + batch_heavy > 0 AND oltp_heavy + batch_heavy = tables THEN 'ONLY_HEAVY' END,
    CASE WHEN lob_tables > 0 AND total_bytes > 10000000 THEN 'LOB_MIX' END, CASE WHEN tables < 50 THEN 'BELOW_MIN' END) AS flags FROM plan)
"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    ids = ["owner", "table_name"]
    groups = balance.deal_snake(scored, ids, "extract_cost", balance.groups_for(scored, PER_GROUP)).select(*ids, "group_id")
    return scored.join(groups, ids)


@query("group_plan", GROUPED_SQL + "SELECT * FROM flagged")
def group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = profile.group_plan(_grouped(spark, sf_dir))
    return plan.withColumns({c: F.col(c).cast("bigint") for c in ("total_cost", "total_bytes")})


@query(
    "plan_balance",
    GROUPED_SQL
    + """, ends AS (SELECT count(*) AS groups, min(total_cost) AS lo, max(total_cost) AS hi FROM plan),
    rated AS (SELECT groups, CASE WHEN hi > 0 THEN (hi - lo) / CAST(hi AS DOUBLE) * 100 ELSE 0 END AS pct FROM ends)
    SELECT groups, round(pct, 4) AS imbalance_pct, CASE WHEN pct < 30 THEN 'GOOD' WHEN pct < 50 THEN 'FAIR' ELSE 'POOR' END AS balance,
    pct > 40 AS warn FROM rated""",
)
def plan_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = profile.plan_balance(profile.group_plan(_grouped(spark, sf_dir)))
    return rated.withColumn("imbalance_pct", F.round("imbalance_pct", 4))


@query(
    "routes_from_profile",
    GROUPED_SQL
    + """SELECT owner AS schema, table_name, CASE owner WHEN 'NATION_1' THEN 'FIRST' WHEN 'NATION_2' THEN 'SECOND' ELSE owner END AS target_schema,
    group_id, 'Y' AS enabled, profile, extract_cost, CAST(byte_throughput AS BIGINT) AS byte_throughput, num_rows, churn_rate, lob_count, needs_keycols
    FROM grouped""",
)
def routes_from_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = small_table(spark, [("nation_1", "FIRST"), ("NATION_2", "SECOND")], "owner string, target_schema string")
    return routes.routes_from_profile(_grouped(spark, sf_dir), names)


# The dealing in SQL: batch-heavy entities by turns, transaction-heavy ones in five rounds, the rest over free places.
HEAVY_ROUNDS = 5
ASSIGN_SQL = SCORE_SQL + f""", e AS (SELECT owner, table_name, profile, extract_cost AS cost FROM scored),
n0 AS (SELECT greatest(1, (count(*) + {PER_GROUP - 1}) // {PER_GROUP}) AS n FROM e),
batch AS (SELECT *, row_number() OVER (ORDER BY cost DESC, owner, table_name) - 1 AS i FROM e WHERE profile = 'BATCH_HEAVY'),
batch_groups AS (SELECT owner, table_name, cost, CASE WHEN i < 2 * n THEN i % n + 1 ELSE n + 1 + (i - 2 * n) // 2 END AS group_id FROM batch, n0),
planned AS (SELECT n + greatest(0, (SELECT count(*) FROM batch) - 2 * n + 1) // 2 AS n FROM n0),
ids AS (SELECT unnest(range(1, n + 1)) AS group_id FROM planned),
oltp AS (SELECT *, row_number() OVER (ORDER BY cost DESC, owner, table_name) AS rank FROM e WHERE profile = 'OLTP_HEAVY'),
t0 AS (SELECT group_id, coalesce(sum(cost), 0) AS total FROM ids LEFT JOIN batch_groups USING (group_id) GROUP BY group_id)"""
for _r in range(HEAVY_ROUNDS):
    ASSIGN_SQL += f""",
p{_r} AS (SELECT group_id, total, row_number() OVER (ORDER BY total, group_id) AS place FROM t{_r}),
o{_r} AS (SELECT owner, table_name, cost, group_id FROM oltp, planned JOIN p{_r} ON rank = {_r} * n + place),
t{_r + 1} AS (SELECT group_id, total + coalesce(cost, 0) AS total FROM p{_r} LEFT JOIN o{_r} USING (group_id))"""
ASSIGN_SQL += f""",
placed AS (SELECT * FROM batch_groups {' '.join(f'UNION ALL SELECT owner, table_name, cost, group_id FROM o{r}' for r in range(HEAVY_ROUNDS))}),
room AS (SELECT group_id, {PER_GROUP} - count(cost) AS free, coalesce(sum(cost), 0) AS total FROM ids LEFT JOIN placed USING (group_id) GROUP BY group_id),
places AS (SELECT group_id, total, unnest(range(1, free + 1)) AS level FROM room),
numbered AS (SELECT group_id, row_number() OVER (ORDER BY level, CASE WHEN level % 2 = 1 THEN total ELSE -total END, CASE WHEN level % 2 = 1 THEN group_id ELSE -group_id END) AS rank FROM places),
ends AS (SELECT count(*) AS taken, coalesce(max(group_id), (SELECT n FROM planned)) AS top FROM numbered),
light AS (
  SELECT owner, table_name, row_number() OVER (ORDER BY cost DESC, owner, table_name) AS rank
  FROM (SELECT owner, table_name, cost FROM e WHERE profile NOT IN ('BATCH_HEAVY', 'OLTP_HEAVY')
        UNION ALL SELECT owner, table_name, cost FROM oltp, planned WHERE rank > {HEAVY_ROUNDS} * n)),
dealt AS (SELECT owner, table_name, group_id FROM placed
  UNION ALL SELECT owner, table_name, coalesce(group_id, top + 1 + (rank - taken - 1) // {PER_GROUP}) FROM light LEFT JOIN numbered USING (rank), ends)
SELECT owner, table_name, profile, cost AS extract_cost, group_id FROM e JOIN dealt USING (owner, table_name)"""


@query("assign_groups", ASSIGN_SQL)
def assign_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dealing: batch-heavy, transaction-heavy and light entities."""
    dealt = balance.assign_groups(_scored(spark, sf_dir), max_per_group=PER_GROUP)
    return dealt.select("owner", "table_name", "profile", F.col("extract_cost").cast("bigint").alias("extract_cost"), "group_id")


@query(
    "heavy_topk",
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS total_price FROM lineitem GROUP BY l_partkey
    ORDER BY total_price DESC, l_partkey LIMIT 20""",
)
def heavy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total_price"))
    return profile.heaviest(totals, "total_price", ["l_partkey"], 20)


def _supplier_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("cost")
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(sums, "s_suppkey", "left").fillna(0.0, ["cost"])


SUPPLIER_SQL = """WITH costs AS (
  SELECT s_suppkey, coalesce(cost, 0) AS cost FROM supplier LEFT JOIN
  (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey),
ranked AS (SELECT *, row_number() OVER (ORDER BY cost DESC, s_suppkey) AS rank FROM costs)
"""


@query(
    "balance_batch_heavy",
    SUPPLIER_SQL
    + "SELECT s_suppkey, cost, rank, CASE WHEN rank <= 24 THEN (rank - 1) % 12 + 1 ELSE 13 + (rank - 25) // 2 END AS group_id FROM ranked",
)
def balance_batch_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.deal_round_robin(_supplier_costs(spark, sf_dir), ["s_suppkey"], "cost", 12, 2)


ROUNDS, ROUND_BUCKETS = 5, 20
_ROUND_SQL = ", t0 AS (SELECT b AS group_id, CAST(0 AS DOUBLE) AS total FROM range(1, 21) r(b))"
for _r in range(ROUNDS):
    _ROUND_SQL += f""", p{_r} AS (SELECT group_id, row_number() OVER (ORDER BY total, group_id) AS place FROM t{_r}),
    g{_r} AS (SELECT s_suppkey, cost, rank, group_id FROM ranked JOIN p{_r} ON rank = {_r * ROUND_BUCKETS} + place),
    t{_r + 1} AS (SELECT group_id, sum(total) AS total FROM
      (SELECT group_id, total FROM t{_r} UNION ALL SELECT group_id, cost FROM g{_r}) GROUP BY group_id)"""
_LATER = f"(rank - {ROUNDS * ROUND_BUCKETS + 1})"
_REST_SQL = f"""UNION ALL SELECT s_suppkey, cost, rank, group_id FROM ranked
  JOIN (SELECT group_id, row_number() OVER (ORDER BY total, group_id) AS place FROM t{ROUNDS})
  ON place = CASE WHEN {_LATER} // {ROUND_BUCKETS} % 2 = 0 THEN {_LATER} % {ROUND_BUCKETS} + 1 ELSE {ROUND_BUCKETS} - {_LATER} % {ROUND_BUCKETS} END
  WHERE rank > {ROUNDS * ROUND_BUCKETS}"""


@query(
    "balance_rounds",
    SUPPLIER_SQL + _ROUND_SQL + " " + " UNION ALL ".join(f"SELECT * FROM g{r}" for r in range(ROUNDS)) + " " + _REST_SQL,
)
def balance_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = spark.range(1, ROUND_BUCKETS + 1).select(F.col("id").alias("group_id"), F.lit(0.0).alias("total_cost"))
    dealt = balance.ranked(_supplier_costs(spark, sf_dir), ["s_suppkey"], "cost")
    return balance.deal_rounds(dealt, buckets, ["s_suppkey"], "cost", ROUND_BUCKETS, ROUNDS, rest=True)


def _customer_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return rows.join(sums, "c_custkey", "left").fillna(0.0, ["cost"])


CUSTOMER_SQL = """WITH costs AS (
  SELECT c_custkey, c_nationkey, coalesce(cost, 0) AS cost FROM customer LEFT JOIN
  (SELECT o_custkey, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)
"""


@query(
    "balance_snake",
    CUSTOMER_SQL
    + f""", ranked AS (SELECT c_custkey, cost, row_number() OVER (ORDER BY cost DESC, c_custkey) AS rank FROM costs)
    SELECT *, {SNAKE.format(n=20)} AS group_id FROM ranked""",
)
def balance_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.deal_snake(_customer_costs(spark, sf_dir), ["c_custkey"], "cost", 20)


@query(
    "balance_owners",
    CUSTOMER_SQL
    + f""", owners AS (SELECT c_nationkey, sum(CAST(cost AS DECIMAL(18, 2))) AS total FROM costs GROUP BY c_nationkey),
    ranked AS (SELECT c_nationkey, row_number() OVER (ORDER BY total DESC, c_nationkey) AS rank FROM owners)
    SELECT c_custkey, c_nationkey, {SNAKE.format(n=4)} AS group_id FROM costs JOIN ranked USING (c_nationkey)""",
)
def balance_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_costs(spark, sf_dir).withColumn("cost", F.col("cost").cast("decimal(18,2)"))
    return balance.deal_owners(rows, "c_nationkey", "cost", 4).select("c_custkey", "c_nationkey", "group_id")


# -- profile of dictionary tables, derived from parts and their order lines --


def _dictionary(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Brand and type play owner and table, parts their columns, lines the activity."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("owner"), F.col("p_type").alias("table_name"), "p_size"
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus")
    by = ["owner", "table_name"]
    kinds = {"inserts": "N", "updates": "R", "deletes": "A"}
    activity = lines.join(part, "p_partkey").groupBy(*by, "l_linestatus").agg(
        *[F.count_if(F.col("l_returnflag") == code).alias(n) for n, code in kinds.items()]
    )
    return {
        "tables": part.groupBy(*by).agg(
            (F.count(F.lit(1)) * 25).alias("num_rows"),
            F.when(F.max("p_size") > 45, F.max("p_size") * 3).alias("avg_row_len"),
            F.lit("N").alias("temporary"),
            F.lit(None).cast("string").alias("iot_type"),
            F.when(F.col("owner") == "Brand#9", "YES").otherwise("NO").alias("nested"),
            F.lit("NO").alias("partitioned"),
            F.lit(None).cast("timestamp_ntz").alias("last_analyzed"),
        ),
        "activity": activity.withColumn("partition_name", F.when(F.col("l_linestatus") == "O", "P1")),
        "segments": part.groupBy(*by).agg(F.sum(F.col("p_size") * 1048576).alias("bytes")).withColumn("segment_type", F.lit("TABLE")),
        "columns": part.withColumn("data_type", F.when(F.col("p_size") < 5, "CLOB").when(F.col("p_size") < 8, "BLOB").otherwise("NUMBER")),
        "partitions": part.where("p_size > 40"),
        "keys": part.where("p_size = 1").withColumn("constraint_type", F.lit("P")),
    }


@query(
    "table_profile",
    """WITH act AS (SELECT p_brand AS owner, p_type AS table_name, count(*) FILTER (l_returnflag = 'N') AS i,
      count(*) FILTER (l_returnflag = 'R') AS u, count(*) FILTER (l_returnflag = 'A') AS d
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus <> 'O' GROUP BY ALL),
    tab AS (SELECT p_brand AS owner, p_type AS table_name, count(*) * 25 AS num_rows,
      coalesce(CASE WHEN max(p_size) > 45 THEN max(p_size) * 3 END, 100) AS avg_row_len, CAST(sum(p_size) AS DOUBLE) AS segment_mb,
      count(*) AS col_count, count(*) FILTER (p_size < 8) AS lob_count, count(*) FILTER (p_size > 40) AS partition_count,
      CASE WHEN count(*) FILTER (p_size = 1) > 0 THEN 'Y' ELSE 'N' END AS has_pk FROM part WHERE p_brand <> 'Brand#9' GROUP BY ALL),
    both_ AS (SELECT tab.*, coalesce(i, 0) AS inserts, coalesce(u, 0) AS updates, coalesce(d, 0) AS deletes
      FROM tab LEFT JOIN act USING (owner, table_name))
    SELECT *, inserts + updates + deletes AS dml_total, (inserts + 2 * updates) * avg_row_len + deletes * 64 AS byte_throughput,
      round((inserts + updates + deletes) / CAST(num_rows AS DOUBLE), 4) AS churn_rate, 365 AS days_since_analyze FROM both_""",
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir)
    rows = profile.table_profile(
        d["tables"], d["activity"], d["segments"], d["columns"], d["partitions"], d["keys"], F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))
    )
    return rows.select(
        "owner", "table_name", "num_rows", "avg_row_len", "segment_mb", "inserts", "updates", "deletes", "dml_total",
        "byte_throughput", "churn_rate", "col_count", "lob_count", "partition_count", "has_pk", "days_since_analyze",
    )


@query(
    "profile_defaults",
    """WITH cells AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS i,
      CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS u FROM orders),
    nums AS (SELECT id, coalesce(TRY_CAST(i AS DOUBLE), 0) AS inserts, coalesce(TRY_CAST(u AS DOUBLE), 0) AS updates FROM cells)
    SELECT id, inserts, updates, CAST(100 AS DOUBLE) AS avg_row_len, 'Y' AS has_pk, inserts + updates AS dml_total,
      (inserts + 2 * updates) * 100 AS byte_throughput FROM nums""",
)
def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text export with bad numbers and missing columns."""
    key = F.col("o_orderkey")
    export = table(spark, sf_dir, "orders").select(
        key.alias("ID "),
        F.when(key % 3 == 0, "n/a").otherwise((key % 50).cast("string")).alias(" Inserts"),
        F.when(key % 4 != 0, (key % 9).cast("string")).alias("UPDATES"),
    )
    filled = profile.rebuild_empty_measures(profile.fill_profile(export))
    return filled.select("id", "inserts", "updates", "avg_row_len", "has_pk", "dml_total", "byte_throughput")


# -- readiness ---------------------------------------------------------------


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as routed tables, checked against what order lines say of them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, "l_partkey")
    named = lines.select(
        F.lit("APP").alias("owner"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("table_name"),
        "p_size", "l_linenumber", "l_returnflag", "l_suppkey",
    )
    listed = table(spark, sf_dir, "supplier").select(
        F.lit("APP").alias("schema"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("table_name")
    ).withColumn("fqn", F.concat_ws(".", "schema", "table_name"))
    constraints = named.where("l_suppkey % 4 <> 0").select("owner", "table_name").distinct().select(
        "*", F.lit("P").alias("constraint_type"), F.concat(F.lit("PK_"), F.col("table_name")).alias("constraint_name")
    )
    parts = named.select(
        "owner", F.concat(F.lit("PK_"), F.col("table_name")).alias("constraint_name"),
        F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name"), (-F.col("l_linenumber")).alias("position"),
    ).distinct()
    columns = named.withColumn("data_type", F.when((F.col("p_size") == 7) & (F.col("l_suppkey") % 3 == 0), "CLOB").otherwise("NUMBER"))
    return quality.readiness(
        listed, named.where("l_suppkey % 10 <> 0"), quality.key_columns(constraints, parts), columns,
        named.where("l_returnflag = 'A' AND l_suppkey % 7 <> 0"),
    )


CHECKS_SQL = """WITH facts AS (
  SELECT 'APP' AS owner, 'S' || s_suppkey AS t, s_suppkey, count(l_suppkey) AS n,
    string_agg(DISTINCT 'C' || l_linenumber, ',' ORDER BY 'C' || l_linenumber DESC) AS cols,
    count(*) FILTER (p_size = 7) AS sevens, count(*) FILTER (l_returnflag = 'A') AS a
  FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL),
checks AS (
  SELECT 'APP.' || t AS fqn, CASE WHEN n > 0 AND s_suppkey % 4 <> 0 THEN cols END AS pk_columns,
    NOT (n > 0 AND s_suppkey % 10 <> 0) AS missing,
    n > 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 4 = 0 AS no_pk,
    n > 0 AND s_suppkey % 10 <> 0 AND NOT (a > 0 AND s_suppkey % 7 <> 0) AS no_logging,
    n > 0 AND s_suppkey % 10 <> 0 AND sevens > 0 AND s_suppkey % 3 = 0 AS has_lob FROM facts)
"""


@query("readiness", CHECKS_SQL + "SELECT * FROM checks")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@query(
    "readiness_summary",
    CHECKS_SQL
    + """, s AS (SELECT count(*) AS checked, count(*) FILTER (NOT missing AND NOT no_pk) AS ok, count(*) FILTER (missing) AS missing,
    count(*) FILTER (no_pk) AS no_pk, count(*) FILTER (no_logging) AS no_logging, count(*) FILTER (has_lob) AS has_lob FROM checks)
    SELECT *, missing = 0 AND no_pk = 0 AS passed FROM s""",
)
def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.readiness_summary(_checks(spark, sf_dir))


@query(
    "readiness_lists",
    CHECKS_SQL
    + " UNION ALL ".join(
        f"""SELECT '{flag}' AS "check", coalesce((SELECT string_agg(fqn, ',' ORDER BY fqn) FROM
        (SELECT fqn FROM checks WHERE {flag} ORDER BY fqn LIMIT {n})), '') AS names,
        greatest((SELECT count(*) FROM checks WHERE {flag}) - {n}, 0) AS more"""
        for flag, n in quality.SHOWN.items()
    ),
)
def readiness_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.readiness_lists(shared_checkpoint(_checks(spark, sf_dir))).withColumn("names", F.array_join("names", ","))
