import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import small_table
from tidelog.operators import drift, quality

COLUMNS = "owner string, table_name string, column_name string, data_type string, data_length int, data_precision int, data_scale int"


def meta(spark, rows):
    return small_table(spark, [(r[0], r[1], r[2], r[3], r[4], None, None) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def changes(spark):
    previous = meta(spark, [
        ("s", "grow", "a", "CHAR", 1), ("s", "shrink", "a", "CHAR", 1), ("s", "shrink", "b", "CHAR", 1), ("s", "retype", "a", "CHAR", 1),
        ("s", "moved", "a", "CHAR", 1), ("s", "moved", "keep", "CHAR", 1), ("s", "swap", "a", "CHAR", 1), ("s", "same", "a", "CHAR", 1), ("s", "gone", "a", "CHAR", 1),
        ("s", "two", "a", "CHAR", 1), ("s", "two", "b", "CHAR", 1),
    ])
    current = meta(spark, [
        (" S", "GROW ", "A", "char", 1), ("s", "grow", "b", "DATE", 7), ("s", "shrink", "a", "CHAR", 1), ("s", "retype", "a", "CHAR", 2),
        ("s", "moved", "z", "CHAR", 1), ("s", "moved", "keep", "CHAR", 1), ("s", "swap", "z", "DATE", 7), ("s", "same", "a", "CHAR", 1), ("s", "fresh", "a", "CHAR", 1),
        ("s", "two", "c", "CHAR", 1), ("s", "two", "d", "CHAR", 1),
    ])
    return drift.schema_diff(current, previous)


def test_schema_changes(changes):
    got = {(r.fqn, r.change, r.column_name, r.renamed_to, r.severity) for r in changes.collect()}
    assert got == {
        ("S.GROW", "ADD", "B", None, "SAFE"), ("S.SHRINK", "DROP", "B", None, "WARN"), ("S.RETYPE", "TYPE", "A", None, "WARN"),
        ("S.MOVED", "POSSIBLE_RENAME", "A", "Z", "WARN"), ("S.SWAP", "ADD", "Z", None, "SAFE"), ("S.SWAP", "DROP", "A", None, "WARN"),
        ("S.TWO", "ADD", "C", None, "SAFE"), ("S.TWO", "ADD", "D", None, "SAFE"), ("S.TWO", "DROP", "A", None, "WARN"), ("S.TWO", "DROP", "B", None, "WARN"),
    }


def test_schema_summary(changes):
    row = drift.schema_diff_summary(changes).first()
    assert (row.tables, row.safe, row.warnings) == (6, 4, 6)


def test_no_drift_against_itself(spark):
    rows = meta(spark, [("s", "t", "a", "CHAR", 1)])
    assert drift.schema_diff(rows, rows).count() == 0
    keys = spark.range(100)
    assert drift.key_drift(keys, keys, ["id"]).count() == 0
    assert drift.drifted_buckets(keys, keys, ["id"]).count() == 0


def test_declared_diff_ignores_cdc_columns(spark):
    stored = T.StructType().add("A", "integer").add("old", "integer").add("OP_TYPE", "string").add("op_ts", "timestamp").add("is_deleted", "integer")
    want = meta(spark, [("s", "t", "a", "NUMBER", 1), ("s", "t", "new", "NUMBER", 1)])
    assert {tuple(r) for r in drift.declared_diff(want, stored).collect()} == {("NEW", "ADD"), ("OLD", "DROP")}


def test_key_drift(spark):
    source = small_table(spark, [(1, 0), (2, 0), (3, 1), (4, 1)], "id bigint, is_deleted int")
    target = small_table(spark, [(1,), (1,), (3,), (5,)], "id bigint")
    for buckets in (None, 4, 64):
        got = {r.id: tuple(r)[1:] for r in drift.key_drift(source, target, ["id"], only_drifted=buckets).collect()}
        assert got == {2: (True, False, False), 3: (False, True, True), 5: (False, True, False)}


def test_digest_sees_a_key_that_came_twice_more(spark):
    once = spark.range(10)
    thrice = once.union(once.where("id = 3")).union(once.where("id = 3"))
    assert drift.drifted_buckets(once, thrice, ["id"], buckets=8).count() == 1


def test_digests_differ_in_their_low_bits(spark):
    one_bucket = spark.range(20_000).where(F.pmod(F.xxhash64("id"), F.lit(64)) == 5)
    hashes = one_bucket.select(drift._hashed(["id"]).alias("h"))
    assert hashes.select(F.pmod("h", F.lit(64))).distinct().count() == 64


def test_conform(spark):
    raw = small_table(spark, [("1", "1.5"), ("x", "2"), (None, "y"), ("123456", None)], "a string, b string")
    good, bad = drift.conform(raw, [("a", "NUMBER", 5, 0), ("b", "NUMBER", 5, 1)])
    assert [f.dataType.simpleString() for f in good.schema] == ["decimal(5,0)", "decimal(5,1)"]
    assert good.count() == 1
    assert {(r.a, r.reason) for r in bad.collect()} == {("x", "cast failed: a"), (None, "cast failed: b"), ("123456", "cast failed: a")}


def test_evolve(spark):
    old = small_table(spark, [(1, 2)], "a int, gone int")
    new = small_table(spark, [("7", "n"), ("x", "m")], "a string, fresh string")
    rows, rejects, clashes = drift.evolve(old, new)
    assert [tuple(r) for r in rejects.collect()] == [("x", "m", "cast failed: a")]
    assert drift.evolve(old, old)[1].count() == 0
    assert clashes == [("a", "int", "string")]
    assert {tuple(r) for r in rows.select("a", "gone", "fresh").collect()} == {(1, 2, None), (7, None, "n"), (None, None, "m")}


def test_key_quality(spark):
    rows = small_table(spark, [(1, 1), (1, 1), (1, 2), (None, 1)], "a int, b int")
    row = quality.key_quality(rows, ["a", "b"]).first()
    assert (row.rows, row.distinct_keys, row.null_key_rows, row.duplicate_keys, row.surplus_rows, row.passed) == (4, 3, 1, 1, 1, False)
    assert quality.key_quality(rows.where("false"), ["a"]).first().passed


def test_readiness_lists_are_cut(spark):
    rows = small_table(spark, [(f"S.T{i:02d}", i % 2 == 0, False, False, False) for i in range(50)],
                       "fqn string, missing boolean, no_pk boolean, no_logging boolean, has_lob boolean")
    lists = {r.check: r for r in quality.readiness_lists(rows).collect()}
    assert len(lists["missing"].names) == 20 and lists["missing"].more == 5 and lists["missing"].names[:2] == ["S.T00", "S.T02"]
    assert lists["has_lob"].names == [] and lists["has_lob"].more == 0
    summary = quality.readiness_summary(rows).first()
    assert (summary.checked, summary.ok, summary.passed) == (50, 25, False)
