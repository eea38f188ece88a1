import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import routes
from tidelog.sinks import archive, changes, reports
from tidelog.sources import counts, inventory, listing, logs, metadata, tables

T0 = datetime.datetime(2024, 1, 1)

INVENTORY = """﻿Schema , Table_Name,group,target_schema,target,rds_schema,enabled,reason,disabled_at,pii_columns
hr,people,1,hr_p, Both ,hr_m,Y,,,"ssn, tax_id"
hr,rooms,1,,rds,,,
,,,,
hr,moves,2,,tape,,no,broken,2026-01-01T00:00:00Z
HR , People ,9,again,snowflake,,Y,,,
"""


@pytest.fixture()
def inventory_file(tmp_path):
    path = tmp_path / "inventory.csv"
    path.write_text(INVENTORY)
    return str(path)


def test_inventory(spark, inventory_file):
    good, rejects = inventory.read_inventory(spark, inventory_file)
    rows = {r.fqn: r for r in good.collect()}
    assert set(rows) == {"HR.PEOPLE", "HR.ROOMS", "HR.MOVES"} and rejects.count() == 0
    people, rooms, moves = rows["HR.PEOPLE"], rows["HR.ROOMS"], rows["HR.MOVES"]
    assert (people.group_id, people.targets, people.target_schema, people.excluded_columns) == (1, ["snowflake", "rds"], "hr_p", ["SSN", "TAX_ID"])
    assert (rooms.targets, rooms.rds_target_schema, rooms.enabled, rooms.excluded_columns) == (["rds"], "HR", True, [])
    assert (moves.target, moves.target_warning, moves.enabled, moves.disabled_reason) == ("snowflake", True, False, "broken")


def test_minimal_inventory_gets_defaults(spark, tmp_path):
    path = tmp_path / "small.tsv"
    path.write_text("table\towner\textract_group\nA\ts\t3\n")
    row = inventory.read_inventory(spark, str(path))[0].first()
    assert (row.fqn, row.group_id, row.target, row.target_schema, row.enabled) == ("S.A", 3, "snowflake", "S", True)


def test_inventory_problems(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("schema,table_name,other\na,b,c\n")
    with pytest.raises(ValueError, match="group_id"):
        inventory.read_inventory(spark, str(path))
    raw = small_table(spark, [("a", "b", "x", 1), ("a", None, "1", 2), ("a", "c", "2", 3)], "schema string, table string, group string, n int")
    good, rejects = inventory.parse_inventory(raw, ["n"])
    assert [r.fqn for r in good.collect()] == ["A.C"]
    assert {(r.n, r.reason) for r in rejects.collect()} == {(1, "group_id is not an integer"), (2, "empty schema or table_name")}
    with pytest.raises(Exception, match="group_id must be an integer: x"):
        inventory.parse_inventory(raw, ["n"], strict=True)[0].collect()


def test_routing_a_log(spark, inventory_file):
    log = small_table(spark, [(1, "HR.PEOPLE"), (2, "HR.ROOMS"), (3, "HR.MOVES"), (4, "HR.UNKNOWN")], "seq int, fqn string")
    table = inventory.read_inventory(spark, inventory_file)[0]
    got = {(r.seq, r.target, r.target_schema) for r in routes.route_changes(log, table).collect()}
    assert got == {(1, "snowflake", "hr_p"), (1, "rds", "hr_m"), (2, "rds", "HR")}


def test_overrides(spark, inventory_file):
    table = inventory.read_inventory(spark, inventory_file)[0]
    entries = small_table(
        spark,
        [("HR.PEOPLE", False, "failing", T0), ("HR.MOVES", False, "x", T0), ("HR.MOVES", True, "", T0 + datetime.timedelta(1)), ("HR.ROOMS", False, "", T0)],
        "fqn string, enabled boolean, reason string, changed_at timestamp_ntz",
    )
    got = {r.fqn: (r.enabled, r.disabled_reason, r.disabled_at) for r in routes.apply_overrides(table, entries).collect()}
    assert got == {
        "HR.PEOPLE": (False, "failing", "2024-01-01T00:00:00Z"), "HR.MOVES": (True, "", ""),
        "HR.ROOMS": (False, "manually disabled", "2024-01-01T00:00:00Z"),
    }
    with pytest.raises(ValueError):
        routes.require_active(table.where("NOT enabled"))


def test_reports(spark, tmp_path):
    for run, rows in {"totals_20240101_1": [("a", "t", 1, None)], "totals_20240102_1": [("a", "t", 1, None), ("A", "T", 2, None), ("a", "u", None, "x")]}.items():
        body = {"summary": {"run_id": run}, "tables": [dict(zip(("schema", "table", "row_count", "error"), r)) for r in rows]}
        (tmp_path / f"{run}.json").write_text(json.dumps(body, indent=1))
    newest = counts.latest_run(counts.read_reports(spark, str(tmp_path)))
    assert {tuple(r) for r in newest.collect()} == {("A", "T", 2, None), ("A", "U", None, "x")}


def test_column_metadata(spark, tmp_path):
    path = tmp_path / "cols.csv"
    path.write_text(
        "owner,table_name,column_name,data_type,data_length,data_precision,data_scale,nullable,column_id\n"
        "hr,emp,id,number,22,10.0,0,N,1\n-----,---,---,---,,,,,\nOWNER,TABLE_NAME,COLUMN_NAME,DATA_TYPE,,,,,\nhr,emp,,CHAR,1,,,,2\n"
    )
    rows = metadata.read_columns(spark, str(path)).orderBy("column_id").collect()
    assert [(r.column_name, r.data_type, r.data_precision, r.nullable) for r in rows] == [("ID", "NUMBER", 10, "N"), (None, "CHAR", None, "Y")]
    assert metadata.read_columns(spark, str(path), complete=True).count() == 1


def test_profile_export_with_malformed_lines(spark, tmp_path):
    path = tmp_path / "profile.csv"
    path.write_text("OWNER,Table_Name,INSERTS\nA,t,5\nA,u\nA,v,6,7\nA,w,many\n")
    good, bad = metadata.read_profile(spark, str(path))
    assert {(r.table_name, r.inserts) for r in good.collect()} == {("t", 5.0), ("w", 0.0)}
    assert bad.count() == 2


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        got = [r.value for r in lines.orderBy("block", "row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(20_000)]


def test_listing_reads_no_content(spark, tmp_path):
    for name, size in (("e1000000001", 10), ("e1000000002", 20), ("other.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = listing.list_files(spark, str(tmp_path), F.lit(T0))
    assert "content:" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.name, r.size_bytes) for r in rows.collect()} == {("e1000000001", 10), ("e1000000002", 20), ("other.txt", 5)}
    listing.keep_snapshot(rows, str(tmp_path / "scans"))
    listing.keep_snapshot(rows, str(tmp_path / "scans"))
    assert spark.read.parquet(str(tmp_path / "scans")).count() == 6


def test_growth_check_rates_scan_after_scan(spark, tmp_path):
    folder, scans = tmp_path / "trails", str(tmp_path / "scans")
    folder.mkdir()
    where = f"file:{folder}"
    disk = small_table(spark, [(where, 60.0, 50.0), ("file:/gone", 1.0, 50.0)], "dir string, free_mb double, disk_pct double")
    check = lambda minute: {
        r.dir: r for r in listing.growth_check(spark, str(folder), scans, disk, F.lit(T0 + datetime.timedelta(minutes=minute))).collect()
    }
    (folder / "e1000000001").write_bytes(b"x" * 1024 * 1024)
    assert check(0)[where].growth_mb_min == 0
    (folder / "e1000000002").write_bytes(b"x" * 2 * 1024 * 1024)
    second = check(2)
    assert (second[where].growth_mb_min, second[where].hours_to_fill, second[where].trend) == (1.0, 1.0, "GROWING")
    assert second["file:/gone"].exists is False
    (folder / "e1000000003").write_bytes(b"x" * 4 * 1024 * 1024)
    assert check(2 + 48 * 60)[where].growth_mb_min > 0  # the scan before is two days old


def test_tables_by_catalog_and_filters(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tide_db LOCATION '" + str(tmp_path / "db") + "'")
    for name in ("b", "a", "c"):
        spark.range(1).write.mode("overwrite").saveAsTable(f"tide_db.{name}")
    assert tables.list_tables(spark, "tide_db") == ["a", "b", "c"]
    spark.sql("DROP DATABASE tide_db CASCADE")
    rows = small_table(spark, [("hr", "emp"), ("hr", "dep"), ("fin", "led")], "owner string, table_name string")
    listed = small_table(spark, [("HR.EMP",), ("FIN.LED",)], "fqn string")
    assert tables.only_schemas(rows, [" hr "], listed).collect() == [("hr", "emp")]
    assert tables.only_schemas(rows, None).count() == 3


def test_routed_write(spark, tmp_path):
    rows = small_table(spark, [(1, "snowflake", "P", "T"), (2, "rds", "M", "T")], "seq int, target string, target_schema string, table_name string")
    changes.write_routed(rows, str(tmp_path / "out"))
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "out/target=rds/target_schema=M")).collect()] == [2]


def test_exclusion_style_depends_on_the_target(spark):
    rows = spark.createDataFrame([("snowflake", {"a": "1", "b": "2"}, ["A"]), ("rds", {"a": "1", "b": "2"}, ["A"])],
                                 "target string, payload map<string,string>, excluded_columns array<string>")
    got = {r.target: r.payload for r in changes.exclude_for_target(rows).collect()}
    assert got == {"snowflake": {"a": None, "b": "2"}, "rds": {"b": "2"}}


def test_append_all_and_discard(spark, tmp_path):
    rows = small_table(spark, [(1, "I", T0), (2, "Z", T0), (None, "U", T0)], "k int, op_type string, op_ts timestamp_ntz")
    good, bad = changes.split_valid(rows, {"key is null": F.col("k").isNotNull(), "unknown operation": F.col("op_type").isin("I", "U", "D")})
    changes.append_changes(good, str(tmp_path / "log"))
    changes.append_changes(good, str(tmp_path / "log"))
    changes.discard(bad, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert {(r.op_type, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {("Z", "unknown operation"), ("U", "key is null")}


def test_csv_report(spark, tmp_path):
    rows = small_table(spark, [("S", "B", 3, 4, 3, 0, 0.0, "MATCH", None), ("S", "A", None, 4, 4, None, None, "MISSING", "source")],
                       "schema string, table_name string, source_count bigint, target_total bigint, target_active bigint, delta bigint, delta_pct double, status string, side string")
    reports.write_csv_report(rows, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.splitlines()[-2:] == ["S,A,,4,4,,,MISSING", "S,B,3,4,3,0,0.00,MATCH"]
    assert text.splitlines()[0] == "schema,table_name,oracle_count,snowflake_total,snowflake_active,delta,delta_pct,status"


def test_json_report_and_alerts(spark, tmp_path):
    reports.write_json_report(spark.range(1), spark.range(3), str(tmp_path / "r"), "run1")
    reports.write_json_report(spark.range(1), spark.range(3), str(tmp_path / "r"), "run1")
    assert spark.read.json(str(tmp_path / "r/tables")).count() == 3
    reports.append_alerts(spark.range(2), str(tmp_path / "a"))
    reports.append_alerts(spark.range(2), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4


def test_archive_takes_each_row_once(spark, tmp_path):
    rows = small_table(spark, [(i, T0 + datetime.timedelta(hours=i)) for i in range(10)], "id int, ts timestamp_ntz")
    run = lambda hours, name: archive.archive(
        rows, str(tmp_path / "m"), str(tmp_path / "a"), ["id"], "ts", F.lit(T0 + datetime.timedelta(hours=hours)), name
    ).count()
    assert (run(4, "r1"), run(6, "r2"), run(6, "r3")) == (4, 2, 0)
    assert (run(4, "r1"), run(6, "r2")) == (4, 2)  # repeated after they succeeded
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6
