"""Cost and class of an entity's change activity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostWeights:
    """Penalties of the composite cost."""

    lob: int = 50_000
    partition: int = 5_000
    wide_from: int = 80
    wide: int = 200
    delete_bytes: int = 64
    default_row_len: int = 100


@dataclass(frozen=True)
class ClassLimits:
    """Limits of the activity classes."""

    churn_high: float = 0.5
    churn_low: float = 0.05
    batch_changes: int = 10_000
    batch_bytes: int = 1_000_000
    busy_bytes: int = 5_000_000
    busy_changes: int = 100_000


def change_total(inserts: Column, updates: Column, deletes: Column) -> Column:
    return inserts + updates + deletes


def weighted_changes(inserts: Column, updates: Column, deletes: Column) -> Column:
    """An update ships two row images."""
    return inserts + updates * 2 + deletes


def byte_throughput(
    inserts: Column, updates: Column, deletes: Column, row_len: Column, w: CostWeights = CostWeights()
) -> Column:
    """Bytes shipped: full rows, twice for updates, only the key for deletes."""
    return (inserts + updates * 2) * row_len + deletes * w.delete_bytes


def churn(changes: Column, num_rows: Column) -> Column:
    return F.when(num_rows > 0, changes / num_rows).otherwise(0.0)


def composite_cost(
    bytes_: Column, lobs: Column, partitions: Column, columns: Column, w: CostWeights = CostWeights()
) -> Column:
    wide = F.greatest(columns - w.wide_from, F.lit(0)) * w.wide
    return bytes_ + lobs * w.lob + partitions * w.partition + wide


def activity_class(churn_rate: Column, changes: Column, bytes_: Column, m: ClassLimits = ClassLimits()) -> Column:
    hot = churn_rate >= m.churn_high
    cold = churn_rate <= m.churn_low
    bulk = (changes > m.batch_changes) | (bytes_ > m.batch_bytes)
    busy = (bytes_ > m.busy_bytes) | (changes > m.busy_changes)
    return (
        F.when(changes == 0, "REFERENCE")
        .when(hot & (bytes_ > 0), "OLTP_HEAVY")
        .when(hot, "OLTP_LIGHT")
        .when(cold & bulk, "BATCH_HEAVY")
        .when(cold, "BATCH_LIGHT")
        .when(busy, "OLTP_HEAVY")
        .when(changes > m.batch_changes, "OLTP_LIGHT")
        .otherwise("REFERENCE")
    )


def imbalance_pct(lowest: Column, highest: Column) -> Column:
    return F.when(highest > 0, (highest - lowest) / highest * 100).otherwise(0.0)


def balance_word(pct: Column) -> Column:
    return F.when(pct < 30, "GOOD").when(pct < 50, "FAIR").otherwise("POOR")
