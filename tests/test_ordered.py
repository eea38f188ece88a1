"""Cut keys give what the plain window gives, whatever the skew."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators.ordered import OrderedRows, SkewGuard, checked_broadcast, estimated_bytes, global_rank
from tidelog.operators.state import scd2_history

ALWAYS = SkewGuard(min_bytes=0, hot_rows=20)
ORDER = ["op_ts", "seq"]
START = datetime.datetime(2024, 1, 1)


def skewed_rows(shape):
    """One key holds most rows; times are spread, bursty, or all the same."""
    rng = random.Random(shape)
    rows = []
    for seq in range(1500):
        key = 1 if rng.random() < 0.6 else (None if rng.random() < 0.2 else rng.randrange(2, 60))
        at = {
            "spread": START + datetime.timedelta(seconds=seq * 37),
            "burst": START + datetime.timedelta(microseconds=seq) if seq % 50 else START + datetime.timedelta(days=seq),
            "same": START,
        }[shape]
        rows.append((key, at, seq, rng.choice("IUD"), rng.choice([None, 1, 2, 3])))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=["spread", "burst", "same"])
def skewed(request, spark):
    schema = "k int, op_ts timestamp_ntz, seq bigint, op string, v int"
    return small_table(spark, skewed_rows(request.param), schema)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = (sorted(map(str, df.select(*columns).collect())) for df in (a, b))
    assert left == right


def test_hot_keys_are_cut_into_bounded_pieces(skewed):
    cut = OrderedRows(skewed, ["k"], ORDER, ALWAYS)
    largest = cut.df.groupBy("k", *cut.pieces).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * ALWAYS.hot_rows
    # Pieces are consecutive: none overlaps the next one of its key.
    ends = cut.df.groupBy("k", *cut.pieces).agg(F.min(F.struct(*ORDER)).alias("lo"), F.max(F.struct(*ORDER)).alias("hi"))
    w = Window.partitionBy("k").orderBy(*cut.pieces)
    assert ends.withColumn("next", F.lead("lo").over(w)).where("next <= hi").count() == 0


def test_every_hot_key_is_cut(spark):
    rows = spark.range(0, 300_000, 1, 5).select((F.col("id") % 10_000).alias("k"), "id")
    cut = OrderedRows(rows, ["k"], ["id"], SkewGuard(min_bytes=0, hot_rows=10))
    pieces = cut.df.groupBy("k", *cut.pieces).count()
    assert pieces.agg(F.max("count")).first()[0] <= 20
    assert pieces.select("k").groupBy("k").count().where("count = 1").count() == 0
    total = cut.running_sum({"s": F.lit(1)}).frame().groupBy("k").agg(F.max("s").alias("s"))
    assert total.where("s <> 30").count() == 0 and total.count() == 10_000


def test_pieces_of_a_log_that_thins_out(spark):
    # Half of the rows in the first second, half of the rest in the next one, and so on.
    at = F.pow(F.lit(2.0), F.floor(-F.log2((F.col("id") + 1) / 100_000))) + F.col("id") / 1e6
    rows = spark.range(0, 100_000, 1, 8).select(F.lit("k").alias("k"), at.alias("at"), "id")
    guard = SkewGuard(min_bytes=0, hot_rows=2000, samples=200)
    cut = OrderedRows(rows, ["k"], ["at", "id"], guard)
    sizes = [r["count"] for r in cut.df.groupBy("k", *cut.pieces).count().collect()]
    assert max(sizes) <= 2 * guard.hot_rows and len(sizes) > 50


@pytest.mark.parametrize(
    "order", ["concat('x', lpad(seq, 6, '0'))", "CAST(seq AS DECIMAL(30, 3)) / 7", "CAST(seq AS DOUBLE) - 700", "named_struct('a', seq % 3, 'b', seq)", "to_binary(lpad(seq, 6, '0'), 'utf-8')"]
)
def test_any_order_column_can_be_cut(skewed, order):
    rows = skewed.withColumn("by", F.expr(order))
    cut = OrderedRows(rows, ["k"], ["by"], ALWAYS)
    assert cut.df.groupBy("k", *cut.pieces).count().agg(F.max("count")).first()[0] <= 2 * ALWAYS.hot_rows
    columns = {"t": F.col("op_ts"), "n": F.col("v")}
    same(OrderedRows(rows, ["k"], ["by"]).following(columns).frame(), cut.following(columns).frame())


def test_null_order_values_come_first(skewed):
    rows = skewed.withColumn("by", F.when(F.col("seq") % 3 > 0, F.col("seq")))
    cut = OrderedRows(rows, ["k"], ["by", "seq"], ALWAYS)
    assert cut.pieces
    same(OrderedRows(rows, ["k"], ["by", "seq"]).preceding({"n": F.col("v")}).frame(), cut.preceding({"n": F.col("v")}).frame())


@pytest.mark.parametrize("resets", ["false", "op = 'D'", "v = 99"])
def test_sum_since_a_reset(skewed, resets):
    resets = F.expr(resets)
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    marked = skewed.withColumn("run", F.sum(F.coalesce(resets, F.lit(False)).cast("int")).over(w))
    added = F.when(F.coalesce(resets, F.lit(False)), 0).otherwise(F.coalesce(F.col("v"), F.lit(0)))
    within = Window.partitionBy("k", "run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    plain = marked.withColumn("s", F.sum(added.cast("long")).over(within)).drop("run")
    same(plain, OrderedRows(skewed, ["k"], ORDER, ALWAYS).sum_since("s", F.col("v"), resets).frame())
    same(plain, OrderedRows(skewed, ["k"], ORDER).sum_since("s", F.col("v"), resets).frame())


def test_more_cut_points_than_are_broadcast(skewed):
    guard = SkewGuard(min_bytes=0, hot_rows=20, broadcast_cuts=3)
    same(OrderedRows(skewed, ["k"], ORDER, guard).preceding({"n": F.col("v")}).frame(), OrderedRows(skewed, ["k"], ORDER).preceding({"n": F.col("v")}).frame())


def test_small_inputs_are_left_whole(skewed):
    assert OrderedRows(skewed, ["k"], ORDER).pieces == []


@pytest.mark.parametrize("step", ["following", "preceding"])
def test_neighbours(skewed, step):
    columns = {"t": F.col("op_ts"), "n": F.col("v")}
    same(
        getattr(OrderedRows(skewed, ["k"], ORDER), step)(columns).frame(),
        getattr(OrderedRows(skewed, ["k"], ORDER, ALWAYS), step)(columns).frame(),
    )


def test_running_sum(skewed):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    ones = (F.col("op") == "D").cast("bigint")
    cut = OrderedRows(skewed, ["k"], ORDER, ALWAYS).running_sum({"s": ones}).frame()
    same(cut, skewed.withColumn("s", F.sum(ones).over(w)))


def test_last_known(skewed):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    cut = OrderedRows(skewed, ["k"], ORDER, ALWAYS).last_known({"s": F.col("v")}).frame()
    same(cut, skewed.withColumn("s", F.last("v", ignorenulls=True).over(w)))


def test_history_of_cut_keys(skewed):
    log = skewed.withColumn("is_deleted", (F.col("op") == "D").cast("int"))
    same(scd2_history(log, ["k"]), scd2_history(log, ["k"], guard=ALWAYS))


def test_input_of_unknown_size_is_examined(spark):
    rows = spark.createDataFrame([(1, i) for i in range(9)], "k int, seq int")
    assert OrderedRows(rows, ["k"], ["seq"]).pieces == []
    assert OrderedRows(rows, ["k"], ["seq"], SkewGuard(hot_rows=4)).pieces


def test_global_rank_with_ties_on_the_first_column(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 7919, F.lit(3)).alias("cost"), "id")
    ranked = global_rank(rows, [F.desc("cost"), F.asc("id")])
    plain = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cost"), "id")).cast("bigint"))
    same(ranked, plain)


def test_size_estimate_follows_the_columns_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert 0 < estimated_bytes(df.select("l_orderkey")) < estimated_bytes(df)


def test_local_times_keep_their_order_in_a_zone_with_summer_time(spark, skewed):
    expected = OrderedRows(skewed, ["k"], ORDER).following({"n": F.col("seq")}).frame().collect()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = OrderedRows(skewed, ["k"], ORDER, ALWAYS).following({"n": F.col("seq")}).frame().collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_only_small_tables_are_broadcast(spark):
    small, large = spark.range(5), spark.range(50)
    plan = lambda side: spark.range(100).join(checked_broadcast(side, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small)
    assert "strategy=broadcast" not in plan(large)
    assert spark.range(100).join(checked_broadcast(large, 10), "id").count() == 50
