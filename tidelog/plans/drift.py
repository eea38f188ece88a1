"""Schema and key-set drift plans.

Metadata snapshots are derived from ``part``: a brand is an owner, a block of 400
keys a table (so that tables keep their size at any scale), each part one column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import typemap
from tidelog.operators import changelog, drift, profile, quality, routes
from tidelog.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.add

# -- keys -------------------------------------------------------------------

KEYS_SQL = """WITH src AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS gone FROM orders),
tgt AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey % 19 <> 0
        UNION SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 1000 = 0),
both_ AS (SELECT coalesce(s.key, t.key) AS key, coalesce(gone = 0, false) AS live, coalesce(gone = 1, false) AS dead, t.key IS NOT NULL AS there
          FROM src s FULL JOIN tgt t ON s.key = t.key),
drift AS (SELECT key, live AND NOT there AS missing_in_target, there AND NOT live AS extra_in_target, there AND dead AS deleted_but_live FROM both_)
"""


def _key_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    source = orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0).alias("is_deleted"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 19 <> 0").select(F.col("l_orderkey").alias("key"))
    strays = orders.where("o_orderkey % 1000 = 0").select((-F.col("o_orderkey") - 1).alias("key"))
    return source, lines.unionByName(strays)


@query("key_drift", KEYS_SQL + "SELECT * FROM drift WHERE missing_in_target OR extra_in_target")
def key_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.key_drift(*_key_sets(spark, sf_dir), ["key"])


@query(
    "key_drift_summary",
    KEYS_SQL
    + """SELECT count(*) FILTER (missing_in_target) AS missing_in_target, count(*) FILTER (extra_in_target) AS extra_in_target,
    count(*) FILTER (deleted_but_live) AS deleted_but_live FROM drift""",
)
def key_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.key_drift_summary(drift.key_drift(*_key_sets(spark, sf_dir), ["key"]))


@query(
    "key_drift_by_bucket",
    """SELECT o_orderkey AS key, true AS missing_in_target, false AS extra_in_target, false AS deleted_but_live
    FROM orders WHERE o_orderkey % 4999 = 7
    UNION ALL SELECT -o_orderkey - 1, false, true, false FROM orders WHERE o_orderkey % 5001 = 9""",
)
def key_drift_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearly equal unique key sets: digests first, then only differing buckets."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    copy = keys.where("key % 4999 <> 7").unionByName(keys.where("key % 5001 = 9").select((-F.col("key") - 1).alias("key")))
    return drift.key_drift(keys, copy, ["key"], only_drifted=1024)


@query(
    "bucket_drift",
    """WITH s AS (SELECT o_orderkey % 64 AS bucket, count(*) AS n, CAST(sum((o_orderkey % 2147483648) * (o_orderkey % 2147483648) % 2147483648) AS BIGINT) AS d FROM orders GROUP BY 1),
    t AS (SELECT key % 64 AS bucket, count(*) AS n, CAST(sum((key % 2147483648) * (key % 2147483648) % 2147483648) AS BIGINT) AS d
          FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) GROUP BY 1)
    SELECT coalesce(s.bucket, t.bucket) AS bucket, s.n AS source_keys, s.d AS source_digest, t.n AS target_keys, t.d AS target_digest
    FROM s FULL JOIN t ON s.bucket = t.bucket WHERE s.n IS DISTINCT FROM t.n OR s.d IS DISTINCT FROM t.d""",
)
def bucket_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a digest SQL can repeat (the default digest is xxhash64)."""
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    target = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    squared = lambda k: (F.col(k[0]) % (1 << 31)) * (F.col(k[0]) % (1 << 31)) % (1 << 31)
    found = drift.drifted_buckets(source, target, ["key"], hashed=squared, bucket=lambda k: F.col(k[0]) % 64)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("source_digest", "target_digest")})


@query("keys_missing_downstream", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def keys_missing_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "keys_deleted_upstream",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def keys_deleted_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orders count as deleted; their lines are still there."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


# -- metadata ---------------------------------------------------------------

# Source types dealt to the parts by key.
TYPES = (
    "NUMBER", "VARCHAR2", "nvarchar2", "CHAR", "NCHAR", "DATE", "TIMESTAMP(6)", "TIMESTAMP(6) WITH TIME ZONE",
    "TIMESTAMP(6) WITH LOCAL TIME ZONE", "CLOB", "NCLOB", "BLOB", "RAW", "LONG", "LONG RAW", " FLOAT ", "BINARY_FLOAT",
    "BINARY_DOUBLE", "XMLTYPE", "INTERVAL YEAR(2) TO MONTH", "INTERVAL DAY(2) TO SECOND(6)", "ROWID", "UROWID", "SDO_GEOMETRY",
)
TYPE_LIST_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.lower("p_brand")).alias("owner"),
        F.concat(F.lit("t_"), F.floor(key / 400).cast("string")).alias("table_name"),
        F.concat(F.lit("c"), key.cast("string")).alias("column_name"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (key % len(TYPES) + 1).cast("int")).alias("data_type"),
        F.col("p_size").alias("data_length"),
        F.when(key % 48 == 0, F.lit(None)).when(key % 24 == 0, key % 38 + 1).cast("int").alias("data_precision"),
        F.when(key % 24 == 0, key % 5 - 1).cast("int").alias("data_scale"),
        F.when(key % 2 == 0, "Y").otherwise("N").alias("nullable"),
        key.alias("column_id"),
    )


COLUMNS_SQL = f"""WITH cols AS (
  SELECT p_partkey AS id, upper(p_brand) AS owner, 'T_' || (p_partkey // 400) AS table_name, 'C' || p_partkey AS column_name,
    upper(trim(({TYPE_LIST_SQL})[p_partkey % {len(TYPES)} + 1])) AS data_type, p_size AS len,
    CASE WHEN p_partkey % 48 = 0 THEN NULL WHEN p_partkey % 24 = 0 THEN CAST(p_partkey % 38 + 1 AS INTEGER) END AS prec,
    CASE WHEN p_partkey % 24 = 0 THEN CAST(p_partkey % 5 - 1 AS INTEGER) END AS scale FROM part)
"""


def _typed(f, df: DataFrame) -> Column:
    return f(*[F.col(c) for c in ("data_type", "data_length", "data_precision", "data_scale")])


@query(
    "type_mapping",
    COLUMNS_SQL
    + """SELECT id, CASE WHEN data_type = 'NUMBER' AND prec IS NULL THEN 'NUMBER(38,10)'
      WHEN data_type = 'NUMBER' THEN 'NUMBER(' || prec || ',' || CASE WHEN scale > 0 THEN scale ELSE 0 END || ')'
      WHEN data_type IN ('VARCHAR2', 'NVARCHAR2') THEN 'VARCHAR(' || len || ')' WHEN data_type IN ('CHAR', 'NCHAR') THEN 'CHAR(' || len || ')'
      WHEN data_type LIKE '%WITH LOCAL TIME ZONE' THEN 'TIMESTAMP_LTZ' WHEN data_type LIKE '%WITH TIME ZONE' THEN 'TIMESTAMP_TZ'
      WHEN data_type = 'DATE' OR data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP_NTZ' WHEN data_type = 'BLOB' THEN 'BINARY'
      WHEN data_type = 'RAW' THEN 'BINARY(' || len || ')' WHEN data_type IN ('FLOAT', 'BINARY_FLOAT') THEN 'FLOAT'
      WHEN data_type = 'BINARY_DOUBLE' THEN 'DOUBLE' WHEN data_type = 'XMLTYPE' THEN 'VARIANT' WHEN data_type LIKE 'INTERVAL%' THEN 'VARCHAR(100)'
      WHEN data_type IN ('ROWID', 'UROWID') THEN 'VARCHAR(200)' ELSE 'VARCHAR(16777216)' END AS target_type,
      data_type = 'SDO_GEOMETRY' AS warned FROM cols""",
)
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = _columns(spark, sf_dir)
    return cols.select(
        F.col("column_id").alias("id"),
        _typed(typemap.target_type, cols).alias("target_type"),
        typemap.is_unmapped(F.col("data_type")).alias("warned"),
    )


SIGNATURE_SQL = "concat_ws('|', data_type, CAST(prec AS VARCHAR), CAST(scale AS VARCHAR), CAST(nullif(len, 0) AS VARCHAR))"


@query("type_signatures", COLUMNS_SQL + f"SELECT id, {SIGNATURE_SQL} AS signature FROM cols")
def type_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = _columns(spark, sf_dir)
    return cols.select(F.col("column_id").alias("id"), _typed(typemap.type_signature, cols).alias("signature"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, previous): columns added, dropped, retyped, renamed; one owner is new."""
    cols = _columns(spark, sf_dir)
    previous = cols.where("column_id % 41 <> 0 AND upper(trim(owner)) <> 'BRAND#3'")
    current = (
        cols.where("column_id % 43 <> 0")
        .withColumn("data_length", F.when(F.col("column_id") % 47 == 0, F.col("data_length") + 1).otherwise(F.col("data_length")))
        .withColumn("column_name", F.when(F.col("column_id") % 37 == 0, F.concat("column_name", F.lit("_new"))).otherwise(F.col("column_name")))
    )
    return current, previous


DIFF_SQL = COLUMNS_SQL + f""", signed AS (SELECT id, owner || '.' || table_name AS fqn, owner, column_name, data_type, len, prec, scale FROM cols),
prev AS (SELECT fqn, column_name, data_type, {SIGNATURE_SQL} AS sig FROM signed WHERE id % 41 <> 0 AND owner <> 'BRAND#3'),
cur AS (SELECT fqn, CASE WHEN id % 37 = 0 THEN column_name || '_NEW' ELSE column_name END AS column_name, data_type, {SIGNATURE_SQL} AS sig
  FROM (SELECT * REPLACE (CASE WHEN id % 47 = 0 THEN len + 1 ELSE len END AS len) FROM signed) WHERE id % 43 <> 0),
shared AS (SELECT fqn FROM prev INTERSECT SELECT fqn FROM cur),
pairs AS (SELECT coalesce(p.fqn, c.fqn) AS fqn, coalesce(p.column_name, c.column_name) AS column_name,
    p.data_type AS old_type, c.data_type AS new_type, p.sig AS old_sig, c.sig AS new_sig,
    CASE WHEN p.sig IS NULL THEN 'ADD' WHEN c.sig IS NULL THEN 'DROP' WHEN p.sig <> c.sig THEN 'TYPE' END AS change
  FROM prev p FULL JOIN cur c ON p.fqn = c.fqn AND p.column_name = c.column_name),
changed AS (SELECT * FROM pairs WHERE change IS NOT NULL AND fqn IN (SELECT fqn FROM shared)),
moved AS (SELECT a.fqn, d.column_name AS old_name, a.column_name AS new_name, d.old_type, a.new_type
  FROM changed a JOIN changed d ON a.fqn = d.fqn AND a.change = 'ADD' AND d.change = 'DROP' AND a.new_sig = d.old_sig
  WHERE a.fqn IN (SELECT fqn FROM changed GROUP BY fqn HAVING count(*) FILTER (change = 'ADD') = 1 AND count(*) FILTER (change = 'DROP') = 1)),
diff AS (
  SELECT fqn, change, column_name, CAST(NULL AS VARCHAR) AS renamed_to, old_type, new_type FROM changed
  WHERE NOT (change IN ('ADD', 'DROP') AND fqn IN (SELECT fqn FROM moved))
  UNION ALL SELECT fqn, 'POSSIBLE_RENAME', old_name, new_name, old_type, new_type FROM moved),
rated AS (SELECT *, CASE WHEN change = 'ADD' THEN 'SAFE' ELSE 'WARN' END AS severity FROM diff)
"""


@query("schema_diff", DIFF_SQL + "SELECT * FROM rated")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_diff(*_snapshots(spark, sf_dir))


@query(
    "schema_diff_summary",
    DIFF_SQL
    + """SELECT count(DISTINCT fqn) AS tables, count(*) FILTER (severity = 'SAFE') AS safe,
    count(*) FILTER (severity = 'WARN') AS warnings FROM rated""",
)
def schema_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_diff_summary(drift.schema_diff(*_snapshots(spark, sf_dir)))


@query(
    "schema_diff_by_kind_filtered",
    DIFF_SQL + "SELECT fqn, change, count(*) AS columns FROM rated WHERE fqn LIKE '%\\_1' ESCAPE '\\' GROUP BY fqn, change",
)
def schema_diff_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted to listed tables by a semi join."""
    current, previous = _snapshots(spark, sf_dir)
    listed = current.select(F.concat_ws(".", F.upper(F.trim("owner")), F.upper("table_name")).alias("fqn")).where(F.col("fqn").endswith("_1"))
    return drift.schema_diff(current, previous, listed).groupBy("fqn", "change").agg(F.count(F.lit(1)).alias("columns"))


@query(
    "declared_diff",
    """SELECT DISTINCT upper(p_brand) AS column_name, 'ADD' AS change FROM part
    UNION ALL SELECT DISTINCT upper(p_type), 'ADD' FROM part WHERE upper(p_type) <> 'ECONOMY'
    UNION ALL SELECT 'P_NAME', 'DROP' UNION ALL SELECT 'P_SIZE', 'DROP'""",
)
def declared_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names found in the data against the schema of a stored table."""
    part = table(spark, sf_dir, "part")
    found = part.select(F.col("p_brand").alias("column_name")).unionByName(part.select(F.col("p_type").alias("column_name")))
    stored = part.select(
        "p_name", "p_size", F.col("p_type").alias("Economy"), F.lit("I").alias("op_type"), F.lit(0).alias("is_deleted"),
        F.current_timestamp().alias("op_ts"),
    ).schema
    return drift.declared_diff(found, stored)


RAW_SQL = """WITH raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'oops' ELSE CAST(o_custkey AS VARCHAR) END AS n,
  CASE WHEN o_orderkey % 29 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 2 = 0 THEN 'never' END AS d FROM orders),
cast_ AS (SELECT *, TRY_CAST(n AS BIGINT) AS n2, TRY_CAST(d AS TIMESTAMP) AS d2 FROM raw),
failed AS (SELECT *, concat_ws(',', CASE WHEN n2 IS NULL AND n IS NOT NULL THEN 'n' END, CASE WHEN d2 IS NULL AND d IS NOT NULL THEN 'd' END) AS bad FROM cast_)
"""


def _conformed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 31 == 0, "oops").otherwise(F.col("o_custkey").cast("string")).alias("n"),
        F.when(key % 29 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(key % 2 == 0, "never").alias("d"),
    )
    return drift.conform(raw, [("id", "NUMBER", 18, 0), ("n", "NUMBER", 18, 0), ("d", "DATE", None, None)])


@query("conform_rows", RAW_SQL + "SELECT id, n2 AS n, d2 AS d FROM failed WHERE bad = ''")
def conform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _conformed(spark, sf_dir)
    return good.select(F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"), "d")


@query("conform_rejects", RAW_SQL + "SELECT CAST(id AS VARCHAR) AS id, n, d, 'cast failed: ' || bad AS reason FROM failed WHERE bad <> ''")
def conform_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir)[1]


@query(
    "evolve_union",
    """SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS INTEGER) AS loyalty FROM customer WHERE c_nationkey < 12
    UNION ALL SELECT c_custkey, NULL, TRY_CAST(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE), c_nationkey
    FROM customer WHERE c_nationkey >= 12""",
)
def evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir)[0]


@query(
    "evolve_rejects",
    """SELECT c_custkey, 'n/a' AS c_acctbal, c_nationkey AS loyalty, 'cast failed: c_acctbal' AS reason
    FROM customer WHERE c_nationkey >= 12 AND c_custkey % 9 = 0""",
)
def evolve_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir)[1]


def _evolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newer part lacks a column, brings one, and has one of another type."""
    customer = table(spark, sf_dir, "customer")
    old = customer.where("c_nationkey < 12").select("c_custkey", "c_name", "c_acctbal")
    text = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    new = customer.where("c_nationkey >= 12").select("c_custkey", text.alias("c_acctbal"), F.col("c_nationkey").alias("loyalty"))
    union, rejects, _ = drift.evolve(old, new)
    return union, rejects


@query(
    "columns_of_tables",
    COLUMNS_SQL
    + """SELECT owner, table_name, string_agg(column_name, ',' ORDER BY id) AS columns FROM cols
    WHERE owner || '.' || table_name IN (SELECT upper(p_brand) || '.T_' || (p_partkey // 400) FROM part WHERE p_size > 45)
    GROUP BY owner, table_name""",
)
def columns_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns joined to their tables (system owners out), in declared order."""
    by = ["owner", "table_name"]
    named = _columns(spark, sf_dir).withColumns(
        {c: F.upper(F.trim(c)) for c in ("owner", "table_name", "column_name")}
    )
    tables = table(spark, sf_dir, "part").where("p_size > 45").select(
        F.upper("p_brand").alias("owner"),
        F.concat(F.lit("T_"), F.floor(F.col("p_partkey") / 400).cast("string")).alias("table_name"),
        F.lit("N").alias("temporary"), F.lit(None).cast("string").alias("iot_type"), F.lit("NO").alias("nested"),
    ).distinct()
    joined = named.join(profile.user_tables(tables).select(*by), by)
    return quality.ordered_columns(joined).withColumn("columns", F.array_join("columns", ","))


# -- rows --------------------------------------------------------------------

LINE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "dedup_keep_first",
    f"SELECT {', '.join(LINE_COLUMNS)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_COLUMNS[2:])}) = 1",
)
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return routes.keep_first(lines, ["l_orderkey", "l_linenumber"], list(LINE_COLUMNS[2:])).select(*LINE_COLUMNS)


@query(
    "dedup_removed",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem",
)
def dedup_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_quality(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.col("surplus_rows").alias("removed"))


@query(
    "set_operations",
    """SELECT 'both' AS side, count(*) AS keys FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'source only', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'either', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    parts = {"both": keys.intersect(lines), "source only": keys.subtract(lines), "either": keys.union(lines).distinct()}
    counted = [df.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(name).alias("side"), "keys") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


@query(
    "replayed_rows_masked",
    """SELECT o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders
    WHERE o_orderkey >= (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01')""",
)
def replayed_rows_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay from the position of the last order up to a date, prices masked."""
    orders = table(spark, sf_dir, "orders")
    start = changelog.position_at(orders, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), "o_orderdate", "o_orderkey").scalar()
    rows = changelog.replay_from(orders, start, "o_orderkey")
    return changelog.mask_columns(rows.select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_totalprice"])
