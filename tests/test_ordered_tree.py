"""Cut points of a hot key form a tree: a row meets few of them, and only they are kept, not the sample they come from."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import ordered
from tidelog.operators.ordered import OrderedRows, SkewGuard


@pytest.mark.parametrize("broadcast_cuts", [1_000_000, 50])
def test_a_row_meets_a_few_cut_points_of_its_key(spark, monkeypatch, broadcast_cuts):
    monkeypatch.setattr(ordered, "FAN_OUT", 4)
    met, kept = [], []
    join, checkpoint = ordered.join_null_safe, ordered.shared_checkpoint
    monkeypatch.setattr(ordered, "join_null_safe", lambda left, right, *args: (met.append(right.agg(F.max(F.size("__cuts"))).first()[0]), join(left, right, *args))[1])
    monkeypatch.setattr(ordered, "shared_checkpoint", lambda df: (out := checkpoint(df), kept.append(out.count()))[0])
    key = F.when(F.col("id") % 5 < 3, F.lit("hot")).when(F.col("id") % 5 == 3, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 300).cast("string")))
    rows = spark.range(0, 3000, 1, 4).select(key.alias("k"), F.when(F.col("id") > 20, F.col("id") % 97).alias("at"), "id")
    cut = OrderedRows(rows, ["k"], ["at", "id"], SkewGuard(min_bytes=0, hot_rows=20, broadcast_cuts=broadcast_cuts))
    assert len(met) >= 3 and max(met) <= 4 and sum(kept) < 1000
    pieces = cut.df.groupBy("k", *cut.pieces).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi"))
    assert pieces.where("k = 'hot'").count() > 100 and pieces.agg(F.max("n")).first()[0] <= 20
    after = F.lag("hi").over(Window.partitionBy("k").orderBy(*cut.pieces))
    assert pieces.withColumn("after", after).where("lo <= after").count() == 0
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumn("s", F.sum("id").over(w))
    assert sorted(map(str, cut.running_sum({"s": F.col("id")}).frame().select("k", "at", "id", "s").collect())) == sorted(map(str, plain.collect()))
