"""Current state and history from an append-only change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import OrderedRows, SkewGuard

ORDER = ["op_ts", "seq"]


def latest_change(log: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """The last change per key, deletes included.

    Spark plans the filter on ``row_number`` as a group limit ahead of the
    shuffle, so each map task ships one row per key, however hot the key is.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("__rn", F.row_number().over(newest_first)).where("__rn = 1").drop("__rn")


def current_state(log: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """Live rows: the last change per key, unless it is a delete."""
    return latest_change(log, keys, order).where("is_deleted = 0")


def fold(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """State with tombstones after some changes.

    Replayed and late changes lose against the newer row already stored, and
    deleted keys stay as tombstones so that nothing late can bring them back.
    """
    return latest_change(state.unionByName(changes), keys, order)


def scd2_history(
    log: DataFrame, keys: list[str], order: list[str] = ORDER, guard: SkewGuard = SkewGuard()
) -> DataFrame:
    """Type-2 history: a change is valid until the key's next one.

    A delete closes the open interval and opens none.
    """
    rows = OrderedRows(log, keys, order, guard).following({"valid_to": F.col(order[0]), "__more": F.lit(True)})
    return (
        rows.frame()
        .where("is_deleted = 0")
        .withColumn("valid_from", F.col(order[0]))
        .withColumn("is_current", F.col("__more").isNull())
        .drop("__more")
    )
