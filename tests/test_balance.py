"""Closed forms against a row-by-row simulation of the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import small_table
from tidelog.operators import balance, profile


def simulate_round_robin(count, buckets, cap):
    held, out, turn = [0] * buckets, [], 0
    for _ in range(count):
        for _ in range(len(held) + 1):
            spot = turn % len(held)
            turn += 1
            if held[spot] < cap:
                break
        else:
            held.append(0)
            spot = len(held) - 1
        held[spot] += 1
        out.append(spot + 1)
    return out


@pytest.mark.parametrize("count, buckets, cap", [(7, 3, 2), (6, 3, 2), (20, 3, 2), (9, 1, 4), (5, 8, 1), (30, 4, 3)])
def test_round_robin(spark, count, buckets, cap):
    rows = spark.range(1, count + 1).select("id", balance.round_robin_bucket(F.col("id"), buckets, cap).alias("b"))
    assert [r.b for r in rows.orderBy("id").collect()] == simulate_round_robin(count, buckets, cap)


def test_snake(spark):
    rows = spark.range(1, 9).select(balance.snake_bucket(F.col("id"), 3).alias("b"))
    assert [r.b for r in rows.collect()] == [1, 2, 3, 3, 2, 1, 1, 2]


@pytest.mark.parametrize("seed", range(2))
def test_rounds_pick_the_least_loaded_bucket(spark, seed):
    rng = random.Random(seed)
    n, rounds = 4, 3
    start = {b: float(rng.randrange(50)) for b in range(1, n + 1)}
    rows = [("o", f"t{i:02d}", float(rng.randrange(1, 100))) for i in range(n * rounds - 2)]
    expected, load, held = {}, dict(start), {b: 0 for b in start}
    for owner, name, cost in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        best = min(load, key=lambda b: (held[b], load[b], b))
        expected[name] = best
        load[best] += cost
        held[best] += 1
    table = small_table(spark, rows, "owner string, table_name string, cost double")
    buckets = small_table(spark, list(start.items()), "group_id bigint, total_cost double")
    dealt = balance.deal_rounds(balance.ranked(table, ["owner", "table_name"], "cost"), buckets, ["owner", "table_name"], "cost", n, rounds)
    assert {r.table_name: r.group_id for r in dealt.collect()} == expected


def profile_rows(n_batch, n_oltp, n_light):
    rng = random.Random(n_batch)
    rows = []
    for kind, count in (("BATCH_HEAVY", n_batch), ("OLTP_HEAVY", n_oltp), ("REFERENCE", n_light)):
        rows += [(f"O{i % 5}", f"{kind}_{i:03d}", kind, float(rng.randrange(1, 10_000))) for i in range(count)]
    return rows


@pytest.mark.parametrize("shape, max_size, groups", [((5, 12, 60), 20, None), ((30, 9, 20), 10, None), ((2, 40, 10), 8, None), ((0, 0, 50), 10, 3)])
def test_assigned_groups_keep_their_promises(spark, shape, max_size, groups):
    rows = profile_rows(*shape)
    scored = small_table(spark, rows, "owner string, table_name string, profile string, extract_cost double")
    out = balance.assign_groups(scored, max_per_group=max_size, target_groups=groups)
    got = out.select("owner", "table_name", "profile", "group_id").collect()
    assert len(got) == len(rows) and len({(r.owner, r.table_name) for r in got}) == len(rows)
    sizes, batch = {}, {}
    for r in got:
        assert r.group_id >= 1
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
        batch[r.group_id] = batch.get(r.group_id, 0) + (r.profile == "BATCH_HEAVY")
    assert max(sizes.values()) <= max_size
    assert max(batch.values()) <= 2


def test_owner_affinity_keeps_owners_together(spark):
    rows = small_table(spark, profile_rows(3, 3, 30), "owner string, table_name string, profile string, extract_cost double")
    out = balance.deal_owners(rows, "owner", "extract_cost", 2)
    assert out.groupBy("owner").agg(F.count_distinct("group_id").alias("n")).where("n > 1").count() == 0


def test_plan_flags(spark):
    rows = [(1, "A", f"t{i}", "BATCH_HEAVY", 10.0, 20_000_000, 0, False) for i in range(3)]
    rows += [(2, "B", "x", "REFERENCE", 40.0, 20_000_000, 1, True), (2, "A", "y", "OLTP_HEAVY", 1.0, 0, 0, False)]
    schema = "group_id int, owner string, table_name string, profile string, extract_cost double, byte_throughput bigint, lob_count int, needs_keycols boolean"
    plan = {r.group_id: r for r in profile.group_plan(small_table(spark, rows, schema), min_size=3).collect()}
    assert plan[1].flags == "MANY_BATCH_HEAVY,ONLY_HEAVY"
    assert plan[2].flags == "LOB_MIX,BELOW_MIN"
    assert (plan[2].schemas, plan[2].no_pk_count, plan[2].lob_tables) == ("A, B", 1, 1)


@pytest.mark.parametrize("costs, word, warn", [([100, 71], "GOOD", False), ([100, 70], "FAIR", False), ([100, 50], "POOR", True), ([0, 0], "GOOD", False)])
def test_balance_words(spark, costs, word, warn):
    plan = small_table(spark, [(float(c),) for c in costs], "total_cost double")
    row = profile.plan_balance(plan).first()
    assert (row.balance, row.warn) == (word, warn)


def test_profile_columns_that_are_empty_everywhere_are_rebuilt(spark):
    raw = small_table(spark, [("a", "2", "1", "0", "bad", "10"), ("b", "0", None, "4", "100", "0")],
                      "Table_Name string, inserts string, Updates string, deletes string, avg_row_len string, num_rows string")
    rows = {r.table_name: r for r in profile.rebuild_empty_measures(profile.fill_profile(raw)).collect()}
    assert rows["a"].byte_throughput == 2 * 100 + 2 * 100 and rows["b"].byte_throughput == 4 * 64
    assert rows["a"].churn_rate == 0.3 and rows["b"].churn_rate == 0.0
    assert rows["a"].dml_total == 3 and rows["a"].col_count == 10 and rows["a"].has_pk == "Y"
