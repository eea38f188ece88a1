import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import rules, score, status, text, typemap


def column(spark, values, expr, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {schema}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("c"))).collect()]


def test_switch_words(spark):
    off = ["N", " no ", "False", "0", "disabled"]
    on = ["Y", "yes", "1", "", "  ", None, "off"]
    assert column(spark, off, text.is_on) == [False] * len(off)
    assert column(spark, on, text.is_on) == [True] * len(on)


def test_integers(spark):
    assert column(spark, ["12", " 12.0 ", "", "null", "None", "x", None], text.to_int) == [12, 12, None, None, None, None, None]


def test_name_list(spark):
    assert column(spark, ["ssn, tax_id ", "", None, " , "], text.name_list) == [["SSN", "TAX_ID"], [], [], []]


# Source type, length, precision, scale, target type.
MAPPED = [
    ("NUMBER", 22, 10, 2, "NUMBER(10,2)"), ("NUMBER", 22, 10, 0, "NUMBER(10,0)"), ("NUMBER", 22, 10, None, "NUMBER(10,0)"),
    ("NUMBER", 22, 10, -2, "NUMBER(10,0)"), ("NUMBER", 22, None, None, "NUMBER(38,10)"), ("varchar2", 30, None, None, "VARCHAR(30)"),
    ("NCHAR", 3, None, None, "CHAR(3)"), ("DATE", 7, None, None, "TIMESTAMP_NTZ"), ("TIMESTAMP(6)", 11, None, 6, "TIMESTAMP_NTZ"),
    ("TIMESTAMP(6) WITH TIME ZONE", 13, None, 6, "TIMESTAMP_TZ"), ("TIMESTAMP(6) WITH LOCAL TIME ZONE", 11, None, 6, "TIMESTAMP_LTZ"),
    ("CLOB", 4000, None, None, "VARCHAR(16777216)"), ("BLOB", 4000, None, None, "BINARY"), ("RAW", 16, None, None, "BINARY(16)"),
    ("LONG RAW", 0, None, None, "VARCHAR(16777216)"), ("FLOAT", 22, 126, None, "FLOAT"), ("BINARY_DOUBLE", 8, None, None, "DOUBLE"),
    ("XMLTYPE", 2000, None, None, "VARIANT"), ("INTERVAL DAY(2) TO SECOND(6)", 11, 2, 6, "VARCHAR(100)"), ("UROWID", 4000, None, None, "VARCHAR(200)"),
    ("BFILE", 530, None, None, "VARCHAR(16777216)"),
]


def test_type_mapping(spark):
    rows = spark.createDataFrame([m[:4] for m in MAPPED], "t string, n int, p int, s int")
    cols = [F.col(c) for c in "tnps"]
    got = rows.select(typemap.target_type(*cols).alias("m"), typemap.is_unmapped(F.col("t")).alias("w")).collect()
    assert [r.m for r in got] == [m[4] for m in MAPPED]
    assert [m[0] for m, r in zip(MAPPED, got) if r.w] == ["BFILE"]


def test_signature(spark):
    rows = spark.createDataFrame([("number", 0, 10, None), ("CHAR", 3, None, None), ("NUMBER", 22, 10, 0)], "t string, n int, p int, s int")
    got = [r[0] for r in rows.select(typemap.type_signature(*[F.col(c) for c in "tnps"])).collect()]
    assert got == ["NUMBER|10", "CHAR|3", "NUMBER|10|0|22"]


def test_spark_types():
    assert typemap.spark_type("NUMBER", 10, 2) == T.DecimalType(10, 2)
    assert typemap.spark_type("NUMBER") == T.DecimalType(38, 10)
    assert typemap.spark_type("NUMBER", 2, 4) == T.DecimalType(4, 4)
    assert typemap.spark_type("NUMBER", 5, -2) == T.DecimalType(5, 0)
    assert typemap.spark_type("date") == T.TimestampNTZType()
    assert typemap.spark_type("TIMESTAMP(6) WITH TIME ZONE") == T.TimestampType()
    assert typemap.spark_type("RAW") == T.BinaryType()
    assert typemap.spark_type("BFILE") == T.StringType()


@pytest.mark.parametrize(
    "line, error_class, label",
    [
        ("2024 ERROR OGG-01004 no table", "PERMANENT", "OGG-01004: table not found in source"),
        ("OGG-00868 then ogg-01028", "PERMANENT", "OGG-01028: missing primary key"),
        ("Warehouse WH_1 IS SUSPENDED", "TRANSIENT", "Warehouse .* is suspended: Snowflake warehouse suspended"),
        ("row 14290 of 9", "TRANSIENT", "429: Snowflake rate limited"),
        ("sqlexception: connection REFUSED", "TRANSIENT", "SQLException: Connection refused: Snowflake connection refused"),
        ("all is well", "UNKNOWN", "Unrecognized error pattern"),
    ],
)
def test_classification(spark, line, error_class, label):
    row = column(spark, [line], rules.classify)[0]
    assert (row.error_class, row.error_pattern) == (error_class, label)


def test_custom_rules(spark):
    mine = [rules.Rule("TRANSIENT", r"code \d+", "numbered", False)]
    assert column(spark, ["code 7"], lambda c: rules.classify(c, mine))[0].error_class == "TRANSIENT"
    assert column(spark, ["OGG-01004"], lambda c: rules.classify(c, []))[0].error_class == "UNKNOWN"


def test_process_and_last_match(spark):
    assert column(spark, ["EXTRACT ext01 ABENDED", "replicat  Rdb02 stopped", "nothing"], rules.process_name) == ["EXT01", "RDB02", None]
    assert column(spark, ["OGG-1 OGG-22", "none"], lambda c: rules.last_match(c, rules.ERROR_CODE)) == ["OGG-22", None]


def test_lag_scales(spark):
    seconds = [60, 61, 300, 301]
    assert column(spark, seconds, status.lag_status, "int") == ["OK", "WARNING", "WARNING", "CRITICAL"]
    on_monitor = column(spark, [300, 301, 1800, 1801], lambda c: status.lag_status(c, status.MONITOR_LAG), "int")
    assert on_monitor == ["OK", "WARN", "WARN", "CRITICAL"]
    assert column(spark, ["lag 01:02:03 x", "none"], status.hms_seconds) == [3723, None]


def test_backoff_grows_and_stops(spark):
    assert column(spark, [1, 2, 3, 4, 5], status.backoff_seconds, "int") == [60, 120, 240, 240, 240]


def test_freshness_and_disk(spark):
    assert column(spark, [5, 6, 30, 31], status.staleness, "int") == ["ACTIVE", "IDLE", "IDLE", "STALE"]
    assert column(spark, [75, 76, 90, 91], status.disk_level, "int") == ["OK", "WARN", "WARN", "FAIL"]


# churn, changes, bytes -> class; the limits themselves are included.
CLASSES = [
    (9.0, 0, 9, "REFERENCE"), (0.5, 1, 1, "OLTP_HEAVY"), (0.5, 1, 0, "OLTP_LIGHT"), (0.05, 10_000, 1_000_000, "BATCH_LIGHT"),
    (0.05, 10_001, 0, "BATCH_HEAVY"), (0.05, 1, 1_000_001, "BATCH_HEAVY"), (0.2, 1, 5_000_001, "OLTP_HEAVY"), (0.2, 100_001, 0, "OLTP_HEAVY"),
    (0.2, 100_000, 5_000_000, "OLTP_LIGHT"), (0.2, 10_000, 0, "REFERENCE"),
]


def test_activity_classes(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CLASSES)], "i int, churn double, n bigint, b bigint").orderBy("i")
    got = [r[0] for r in rows.select(score.activity_class(F.col("churn"), F.col("n"), F.col("b"))).collect()]
    assert got == [c[3] for c in CLASSES]


def test_cost_and_throughput(spark):
    row = spark.range(1).select(
        score.byte_throughput(F.lit(2), F.lit(3), F.lit(4), F.lit(100)).alias("b"),
        score.composite_cost(F.lit(10), F.lit(1), F.lit(2), F.lit(82)).alias("c"),
        score.churn(F.lit(3), F.lit(0)).alias("none"),
    ).first()
    assert (row.b, row.c, row.none) == (2 * 100 + 3 * 200 + 4 * 64, 10 + 50_000 + 10_000 + 400, 0.0)
