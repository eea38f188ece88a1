import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.cdc import with_cdc_columns
from tidelog.operators import changelog, state

SCHEMA = "k int, seq bigint, op_ts timestamp_ntz, op_type string, is_deleted int, v string"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def change(k, seq, minute, op, v=None):
    return (k, seq, at(minute), op, int(op == "D"), v)


LOG = [
    change(1, 1, 0, "I", "a"), change(1, 2, 5, "U", "b"), change(1, 3, 9, "D"),            # ends deleted
    change(2, 4, 1, "I", "c"), change(2, 5, 2, "D"), change(2, 6, 3, "I", "d"),            # inserted again
    change(3, 7, 4, "I", "e"), change(3, 8, 4, "U", "f"),                                  # same time, later position
    change(4, 9, 4, "X", "g"),                                                             # unknown operation
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, SCHEMA)


def values(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_cdc_columns(spark):
    raw = spark.createDataFrame([(1, "INSERT"), (2, "UPDATE"), (3, "DELETE"), (4, "TRUNCATE"), (5, "DDL")], "id int, op_name string")
    rows = with_cdc_columns(raw.withColumn("commit_ts", F.lit(at(0)))).orderBy("id").collect()
    assert [(r.op_type, r.is_deleted) for r in rows] == [("I", 0), ("U", 0), ("D", 1), ("T", 0), ("D", 1)]


def test_current_state(log):
    assert values(state.current_state(log, ["k"])) == [(2, "d"), (3, "f"), (4, "g")]


def test_fold_keeps_tombstones(spark, log):
    folded = state.latest_change(log, ["k"])
    late = spark.createDataFrame([change(1, 2, 5, "U", "late"), change(2, 5, 2, "D")], SCHEMA)
    assert values(state.fold(folded, late, ["k"]).where("is_deleted = 0")) == [(2, "d"), (3, "f"), (4, "g")]


@pytest.mark.parametrize("seed", range(5))
def test_fold_of_parts_is_fold_of_all(spark, seed):
    rng = random.Random(seed)
    rows = [change(rng.randrange(6), s, rng.randrange(10), rng.choice("IUD"), str(s)) for s in range(60)]
    rng.shuffle(rows)
    cut = rng.randrange(len(rows))
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    whole = state.latest_change(frame(rows), ["k"])
    parts = state.fold(state.latest_change(frame(rows[:cut]), ["k"]), frame(rows[cut:]), ["k"])
    again = state.fold(parts, frame(rows[cut:]), ["k"])
    assert values(whole) == values(parts) == values(again)


def test_history(log):
    spans = state.scd2_history(log, ["k"]).orderBy("k", "seq").collect()
    got = [(r.k, r.v, r.valid_from, r.valid_to, r.is_current) for r in spans]
    assert got == [
        (1, "a", at(0), at(5), False), (1, "b", at(5), at(9), False),
        (2, "c", at(1), at(2), False), (2, "d", at(3), None, True),
        (3, "e", at(4), at(4), False), (3, "f", at(4), None, True),
        (4, "g", at(4), None, True),
    ]


def test_open_intervals_are_the_current_state(log):
    open_rows = state.scd2_history(log, ["k"]).where("is_current")
    assert values(open_rows) == values(state.current_state(log, ["k"]))


def test_before_and_after(log):
    rows = changelog.before_after(log, ["k"], ["v"]).orderBy("seq").collect()
    images = [(r.before and r.before.v, r.after and r.after.v, r.changed) for r in rows[:6]]
    assert images == [
        (None, "a", ["v"]), ("a", "b", ["v"]), ("b", None, ["v"]),
        (None, "c", ["v"]), ("c", None, ["v"]), (None, "d", ["v"]),
    ]


def test_masking_and_dropping(log):
    masked = changelog.mask_columns(log, ["V"])
    assert masked.schema["v"].dataType == log.schema["v"].dataType
    assert masked.where("v IS NOT NULL").count() == 0
    assert "v" not in changelog.drop_columns(log, ["V"]).columns


def test_target_decides_how_columns_are_hidden(spark):
    people = spark.createDataFrame([(1, "123", "n", "I", 0)], "id int, ssn string, name string, op_type string, is_deleted int")
    assert changelog.for_target(people, "snowflake", ["SSN"]).collect() == [(1, None, "n", "I", 0)]
    assert changelog.for_target(people, "rds", ["SSN"]).collect() == [(1, "n")]


def test_payload_exclusion(spark):
    rows = spark.createDataFrame([(1, {"ssn": "1", "name": "n"}, ["SSN"]), (2, {"ssn": "2"}, None)], "id int, p map<string,string>, x array<string>")
    out = rows.select(
        "id", changelog.mask_payload(F.col("p"), F.col("x")).alias("m"), changelog.drop_payload(F.col("p"), F.col("x")).alias("d")
    ).orderBy("id").collect()
    assert (out[0].m, out[0].d) == ({"ssn": None, "name": "n"}, {"name": "n"})
    assert (out[1].m, out[1].d) == ({"ssn": "2"}, {"ssn": "2"})


def test_replay(log):
    assert {r.seq for r in changelog.replay_from(log, 7).collect()} == {7, 8, 9}
    assert changelog.position_at(log, F.lit(at(4))).first().position == 9
    assert changelog.position_at(log, F.lit(at(2))).first().position == 5


def test_positions_at(spark, log):
    asked = spark.createDataFrame([(1, at(-1)), (1, at(6)), (2, at(2)), (9, at(2))], "k int, op_ts timestamp_ntz")
    got = {(r.k, r.op_ts): r.position for r in changelog.positions_at(log, asked, ["k"]).collect()}
    assert got == {(1, at(-1)): None, (1, at(6)): 2, (2, at(2)): 5, (9, at(2)): None}
