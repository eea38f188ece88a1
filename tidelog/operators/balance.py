"""Dealing entities into groups of similar cost.

All forms are set operations on a global rank: nothing is assigned row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import global_rank, shared_checkpoint


def round_robin_bucket(rank: Column, buckets: int, cap: int = 2) -> Column:
    """Bucket of the rank-th costliest batch entity: ``cap`` turns over all
    buckets, then new buckets that take ``cap`` each."""
    i = rank - 1
    over = i - buckets * cap
    return F.when(over < 0, i % buckets + 1).otherwise(buckets + 1 + F.floor(over / cap)).cast("bigint")


def snake_bucket(rank: Column, buckets: int) -> Column:
    """1..n, then n..1, and so on; group sizes differ by at most one."""
    i = rank - 1
    turn, place = F.floor(i / buckets), i % buckets
    return F.when(turn % 2 == 0, place + 1).otherwise(buckets - place).cast("bigint")


def ranked(rows: DataFrame, ids: list[str], cost: str) -> DataFrame:
    """Rank by falling cost, ties by name; only these columns are sorted."""
    return global_rank(rows.select(*ids, cost), [F.desc(cost), *[F.asc(c) for c in ids]])


def deal_round_robin(rows: DataFrame, ids: list[str], cost: str, buckets: int, cap: int = 2) -> DataFrame:
    return ranked(rows, ids, cost).withColumn("group_id", round_robin_bucket(F.col("rank"), buckets, cap))


def deal_snake(rows: DataFrame, ids: list[str], cost: str, buckets: int) -> DataFrame:
    return ranked(rows, ids, cost).withColumn("group_id", snake_bucket(F.col("rank"), buckets))


def deal_owners(rows: DataFrame, owner: str, cost: str, buckets: int) -> DataFrame:
    """Affinity: whole owners are dealt by their total cost."""
    owners = rows.groupBy(owner).agg(F.sum(cost).alias("__cost"))
    dealt = deal_snake(owners, [owner], "__cost", buckets).select(owner, "group_id")
    return rows.join(dealt, owner)


def groups_for(rows: DataFrame, max_per_group: int = 75) -> int:
    """How many groups hold all rows."""
    return max(1, math.ceil(rows.count() / max_per_group))


def by_load(held: DataFrame, name: str = "__place") -> DataFrame:
    """Buckets numbered by falling room: the cheapest so far is 1."""
    return global_rank(held, [F.asc("total_cost"), F.asc("group_id")], name)


def deal_rounds(
    dealt: DataFrame, buckets: DataFrame, ids: list[str], cost: str, n: int, rounds: int = 5, rest: bool = False
) -> DataFrame:
    """Longest processing time first, a round at a time: each round hands the next n rows, costliest first, to the
    buckets in order of their cost so far.

    ``dealt`` comes from ``ranked``; rows beyond n * rounds are left out (``assign_groups`` has
    its own use for them) or, with ``rest``, dealt in snake order to the buckets in order of their cost after the rounds.
    ``buckets`` has n rows (group_id, total_cost). Buckets are ranked by a range-partitioned sort, whose checkpoint carries
    their costs from round to round: one small table a round, however many buckets there are.
    """
    heavy = dealt.where(F.col("rank") <= n * rounds).select(
        F.floor((F.col("rank") - 1) / n).alias("__round"), ((F.col("rank") - 1) % n + 1).alias("__place"), *ids, cost, "rank"
    )
    held = buckets.select("group_id", F.col("total_cost").cast("double").alias("total_cost"))
    out = None
    for r in range(rounds):
        placed = by_load(held)
        turn = heavy.where(F.col("__round") == r).drop("__round")
        given = placed.join(turn, "__place")
        out = given.select(*ids, cost, "rank", "group_id") if out is None else out.unionByName(given.select(*ids, cost, "rank", "group_id"))
        grown = placed.join(turn.select("__place", F.col(cost).cast("double").alias("__more")), "__place", "left")
        held = grown.select("group_id", (F.col("total_cost") + F.coalesce("__more", F.lit(0.0))).alias("total_cost"))
    if not rest:
        return out
    later = F.col("rank") - n * rounds - 1
    step = later % n
    turn = F.when(F.floor(later / n) % 2 == 0, step + 1).otherwise(n - step)
    light = dealt.where(F.col("rank") > n * rounds).select(*ids, cost, "rank", turn.alias("__place"))
    return out.unionByName(light.join(by_load(held).select("group_id", "__place"), "__place").select(*out.columns))


def assign_groups(
    scored: DataFrame,
    max_per_group: int = 75,
    target_groups: int | None = None,
    max_batch_heavy: int = 2,
    max_oltp_heavy: int = 5,
) -> DataFrame:
    """Group ids for a scored profile: batch-heavy entities by round robin,
    transaction-heavy ones in rounds, everything else by snake deal over the
    places that are left. ``max_per_group`` always holds; a group beyond the
    planned ones is opened when all places are taken."""
    ids, cost = ["owner", "table_name"], "extract_cost"
    spark, everything = scored.sparkSession, scored
    # Dealt in several passes, hence written once.
    scored = shared_checkpoint(scored.select(*ids, cost, "profile"))
    n = target_groups or groups_for(scored, max_per_group)
    is_batch, is_oltp = F.col("profile") == "BATCH_HEAVY", F.col("profile") == "OLTP_HEAVY"

    cap = min(max_batch_heavy, max_per_group)
    batch = deal_round_robin(scored.where(is_batch), ids, cost, n, cap).select(*ids, cost, "group_id")
    n += math.ceil(max(0, batch.count() - n * cap) / cap)
    planned = spark.range(1, n + 1).withColumnRenamed("id", "group_id")
    so_far = planned.join(batch.groupBy("group_id").agg(F.sum(cost).alias("total_cost")), "group_id", "left").fillna(0.0)

    rounds = max(0, min(max_oltp_heavy, max_per_group - max_batch_heavy))
    oltp = ranked(scored.where(is_oltp), ids, cost)
    placed = batch
    if rounds:
        placed = placed.unionByName(deal_rounds(oltp, so_far, ids, cost, n, rounds).select(*ids, cost, "group_id"))
        placed = shared_checkpoint(placed)
    rest = (
        scored.where(~(is_batch | is_oltp)).select(*ids, cost)
        .unionByName(oltp.where(F.col("rank") > n * rounds).select(*ids, cost))
    )

    used = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("__used"), F.sum(cost).alias("__cost"))
    room = (
        planned.join(used, "group_id", "left").fillna({"__used": 0, "__cost": 0.0})
        .withColumn("__free", max_per_group - F.col("__used"))
        .where("__free > 0")
    )
    level = F.col("__level")
    places = room.withColumn("__level", F.explode(F.sequence(F.lit(1), F.col("__free").cast("int"))))
    places = places.withColumn("__turn", F.when(level % 2 == 1, F.col("__cost")).otherwise(-F.col("__cost")))
    places = places.withColumn("__tie", F.when(level % 2 == 1, F.col("group_id")).otherwise(-F.col("group_id")))
    numbered = global_rank(
        places.select("__level", "__turn", "__tie", "group_id"), [F.asc("__level"), F.asc("__turn"), F.asc("__tie")]
    ).select("rank", "group_id")

    taken = numbered.agg(F.count(F.lit(1)).alias("c")).scalar()
    top = numbered.agg(F.coalesce(F.max("group_id"), F.lit(n)).alias("g")).scalar()
    light = (
        ranked(rest, ids, cost)
        .join(numbered, "rank", "left")
        .withColumn(
            "group_id",
            F.coalesce("group_id", top + 1 + F.floor((F.col("rank") - taken - 1) / max_per_group)),
        )
        .select(*ids, cost, "group_id")
    )
    groups = placed.unionByName(light).select(*ids, F.col("group_id").cast("bigint").alias("group_id"))
    return everything.join(groups, ids)
