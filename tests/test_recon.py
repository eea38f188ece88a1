import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import recon
from tidelog.sources.counts import source_counts, target_counts

TOTALS = "schema string, table_name string, row_count bigint, error string"


def totals(spark, rows):
    return spark.createDataFrame([("S", *r) for r in rows], TOTALS)


@pytest.fixture(scope="module")
def result(spark):
    source = totals(spark, [
        ("SAME", 5, None), ("LESS", 5, None), ("LEFT", 5, None), ("SRC_BAD", None, "x"), ("BOTH_BAD", None, "x"),
        ("TGT_BAD", 5, None), ("NULLS", None, None), ("LEFT_BAD", None, "x"),
    ])
    target = totals(spark, [
        ("SAME", 5, ""), ("LESS", 3, None), ("RIGHT", 5, None), ("SRC_BAD", 5, None), ("BOTH_BAD", None, "y"),
        ("TGT_BAD", None, "y"), ("NULLS", 0, None), ("RIGHT_BAD", None, "y"),
    ])
    return recon.reconcile(source, target)


def test_every_status(result):
    got = {r.table_name: (r.status, r.delta) for r in result.collect()}
    assert got == {
        "SAME": ("OK", 0), "LESS": ("MISMATCH", 2), "LEFT": ("MISSING_IN_SNOWFLAKE", None), "RIGHT": ("MISSING_IN_ORACLE", None),
        "SRC_BAD": ("ORACLE_ERROR", None), "BOTH_BAD": ("ORACLE_ERROR", None), "TGT_BAD": ("SNOWFLAKE_ERROR", None),
        "NULLS": ("OK", 0), "LEFT_BAD": ("ORACLE_ERROR", None), "RIGHT_BAD": ("SNOWFLAKE_ERROR", None),
    }


def test_summary(spark, result):
    row = recon.reconcile_summary(result).first()
    assert row.asDict() == {
        "tables_compared": 10, "tables_ok": 2, "mismatches": 1, "missing_in_target": 1, "missing_in_source": 1, "errors": 5, "passed": False,
    }


def test_rows_missing_in_the_source_do_not_fail_a_run(spark):
    out = recon.reconcile(totals(spark, [("A", 1, None)]), totals(spark, [("A", 1, None), ("B", 1, None)]))
    assert recon.reconcile_summary(out).first().passed


def test_missing_side_with_null_count_is_told_apart(spark):
    out = recon.reconcile(totals(spark, [("A", None, None)]), totals(spark, [("B", None, None)]))
    row = recon.reconcile_summary(out).first()
    assert (row.missing_in_target, row.missing_in_source) == (1, 1)


def test_threshold_statuses(spark):
    names = ["EXACT", "AT_LIMIT", "OVER", "NO_SOURCE", "NO_TARGET", "ZERO_ZERO", "ZERO_SOME", "FAILED", "NEGATIVE"]
    expected = spark.createDataFrame([(n,) for n in names], "e string")
    source = spark.createDataFrame(
        [("EXACT", 100, "EXACT"), ("AT_LIMIT", 100, "EXACT"), ("OVER", 100, "EXACT"), ("NO_TARGET", 1, "EXACT"), ("ZERO_ZERO", 0, "EXACT"),
         ("ZERO_SOME", 0, "EXACT"), ("FAILED", 0, "ERROR: no grant"), ("NEGATIVE", -1, "EXACT")], "e string, row_count bigint, method string")
    target = spark.createDataFrame(
        [("EXACT", 120, 100), ("AT_LIMIT", 99, None), ("OVER", 98, 98), ("NO_SOURCE", 1, 1), ("ZERO_ZERO", 0, 0), ("ZERO_SOME", 1, 1),
         ("FAILED", 0, 0), ("NEGATIVE", 1, 1)], "e string, total_count bigint, active_count bigint")
    got = {r.e: (r.status, r.side, r.delta_pct) for r in recon.reconcile_threshold(expected, source, target, ["e"], 1.0).collect()}
    assert got == {
        "EXACT": ("MATCH", None, 0.0), "AT_LIMIT": ("MATCH", None, 1.0), "OVER": ("MISMATCH", None, 2.0), "NO_SOURCE": ("MISSING", "source", None),
        "NO_TARGET": ("MISSING", "target", None), "ZERO_ZERO": ("MATCH", None, 0.0), "ZERO_SOME": ("MISMATCH", None, 100.0),
        "FAILED": ("ERROR", None, None), "NEGATIVE": ("ERROR", None, None),
    }


def test_matches_come_first(spark):
    rows = spark.createDataFrame([("b", "MATCH"), ("a", "MISMATCH"), ("a", "MATCH")], "n string, status string")
    assert [tuple(r) for r in recon.report_order(rows, ["n"]).collect()] == [("a", "MATCH"), ("b", "MATCH"), ("a", "MISMATCH")]


def test_unreadable_table_is_a_row(spark):
    out = recon.control_totals(spark, {("S", "A"): lambda: spark.range(3), ("S", "B"): lambda: spark.read.parquet("/nowhere/at/all")})
    got = {r.table_name: (r.row_count, r.error is None) for r in out.collect()}
    assert got == {"A": (3, True), "B": (None, False)}


def test_active_count_is_no_live_count(spark):
    log = spark.createDataFrame([(1, 1, "I", 0), (1, 2, "U", 0), (1, 3, "D", 1)], "k int, seq int, op_type string, is_deleted int")
    log = log.withColumn("op_ts", F.col("seq"))
    assert recon.change_counts(log).first().active_count == 2
    assert recon.live_counts(log, ["k"]).first().live_count == 0


def test_counts_without_delete_flag(spark):
    row = recon.change_counts(spark.range(4)).first()
    assert (row.total_count, row.active_count, row.deleted_count) == (4, 4, 0)


def test_sampled_count_is_repeatable_and_opt_in(spark):
    tables = {("S", "BIG"): spark.range(400_000), ("S", "SMALL"): spark.range(10)}
    got = {r.table_name: tuple(r)[2:] for r in recon.sampled_totals(tables, {("S", "BIG"): (F.expr("id % 10 = 3"), 0.1)}).collect()}
    assert got == {"BIG": (400_000, "SAMPLE", 10.0), "SMALL": (10, "EXACT", 100.0)}


def test_damaged_file_is_a_row(spark, tmp_path):
    for name in ("a", "bad", "c"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / name))
    schema = spark.range(1).schema
    for part in (tmp_path / "bad").glob("*.parquet"):
        part.write_bytes(b"PAR1 damaged PAR1")
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    tables = {("S", n): (lambda n=n: spark.read.schema(schema).parquet(str(tmp_path / n))) for n in ("a", "bad", "c")}
    got = {r.table_name: (r.row_count, r.error is None) for r in recon.control_totals(spark, tables).collect()}
    assert got == {"a": (3, True), "bad": (None, False), "c": (3, True)}


def test_keys_compare_in_upper_case_and_once(spark):
    source = totals(spark, [("emp", 5, None), ("EMP", 7, None), ("Dep", 1, None)])
    target = totals(spark, [("Emp", 7, None), ("DEP", 1, None)])
    assert {(r.table_name, r.status) for r in recon.reconcile(source, target).collect()} == {("EMP", "OK"), ("DEP", "OK")}
    runs = [df.withColumn("run", F.col("row_count") * -1) for df in (source, target)]
    got = {r.table_name: r.delta for r in recon.reconcile(*runs, newest="run").collect()}
    assert got == {"EMP": -2, "DEP": 0}


def test_schema_names_are_mapped_before_comparing(spark):
    routes = spark.createDataFrame([("HR", "HR_PROD", "EMP")], "schema string, target_schema string, table_name string")
    target = spark.createDataFrame([("hr_prod", "emp", 3, None), ("OTHER", "X", 1, None)], TOTALS)
    assert {(r.schema, r.row_count) for r in recon.map_schemas(target, routes).collect()} == {("HR", 3), ("OTHER", 1)}


def test_count_exports(spark):
    source = spark.createDataFrame([(" hr", "emp", "12", "EXACT"), ("hr", "dep", "many", None), ("hr", "job", "-1", "ERROR: x"), ("", "z", "1", None)],
                                   "owner string, table string, count string, method string")
    got = {r.table_name: (r.schema, r.row_count, r.method) for r in source_counts(source).collect()}
    assert got == {"EMP": ("HR", 12, "EXACT"), "DEP": ("HR", 0, None), "JOB": ("HR", -1, "ERROR: x")}
    target = spark.createDataFrame([("hr", "emp", "12", "10"), ("hr", "dep", "7", ""), ("hr", "job", "x", None)],
                                   "schema string, table_name string, total_count string, active_count string")
    got = {r.table_name: (r.total_count, r.active_count) for r in target_counts(target).collect()}
    assert got == {"EMP": (12, 10), "DEP": (7, 7), "JOB": (0, 0)}


def test_threshold_compares_an_entity_once(spark):
    counts = lambda rows: small_table(spark, rows, "name string, row_count bigint, method string")
    source = counts([("a", 10, "EXACT"), ("A", 12, "EXACT"), ("b", 5, "EXACT"), ("B", -1, "ERROR: x")])
    target = small_table(spark, [("A", 12, None), ("a", 3, 3), ("b", 5, 5)], "name string, total_count bigint, active_count bigint")
    expected = small_table(spark, [("a",), ("A",), ("b",), ("c",)], "name string")
    got = recon.reconcile_threshold(expected, source, target, ["name"]).collect()
    assert sorted((r.name, r.source_count, r.target_active, r.status) for r in got if r.name != "C") == [("A", 12, 12, "MATCH"), ("B", -1, 5, "ERROR")]
    assert [(r.status, r.side) for r in got if r.name == "C"] == [("MISSING", "target")]
