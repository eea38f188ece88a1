"""Shaping a change log: masking, dropping, images, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import OrderedRows, SkewGuard, checked_broadcast
from tidelog.operators.routes import WAREHOUSE
from tidelog.operators.state import ORDER


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the columns, lose their values (names compare case-insensitively)."""
    hidden = {c.upper() for c in columns}
    return df.select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name) if f.name.upper() in hidden else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    hidden = {c.upper() for c in columns}
    return df.drop(*[c for c in df.columns if c.upper() in hidden])


def for_target(df: DataFrame, target: str, excluded: list[str]) -> DataFrame:
    """A typed table's changes as one target gets them: the warehouse keeps excluded
    columns as nulls, the mirror has no such columns and no operation columns."""
    if target == WAREHOUSE:
        return mask_columns(df, excluded)
    return drop_columns(df, [*excluded, "op_type", "op_ts", "is_deleted"])


def mask_payload(payload: Column, excluded: Column) -> Column:
    """Null the excluded entries of a map payload (multi-table logs)."""
    return F.transform_values(
        payload, lambda k, v: F.when(~F.array_contains(F.coalesce(excluded, F.array()), F.upper(k)), v)
    )


def drop_payload(payload: Column, excluded: Column) -> Column:
    return F.map_filter(payload, lambda k, v: ~F.array_contains(F.coalesce(excluded, F.array()), F.upper(k)))


def before_after(
    log: DataFrame,
    keys: list[str],
    payload: list[str],
    order: list[str] = ORDER,
    guard: SkewGuard = SkewGuard(),
) -> DataFrame:
    """Add ``before``/``after`` images and the list of changed columns.

    An insert has no before image, a delete no after image.
    """
    image = F.struct(*payload)
    rows = OrderedRows(log, keys, order, guard).preceding({"__prev": image, "__prev_deleted": F.col("is_deleted")})
    df = rows.frame()
    before = F.when(F.col("__prev_deleted") == 0, F.col("__prev"))
    after = F.when(F.col("is_deleted") == 0, image)
    df = df.withColumn("before", before).withColumn("after", after)
    changed = [
        F.when(~F.col("before").getField(c).eqNullSafe(F.col("after").getField(c)), F.lit(c)) for c in payload
    ]
    return df.withColumn("changed", F.array_compact(F.array(*changed))).drop("__prev", "__prev_deleted")


def replay_from(log: DataFrame, start: int | Column, seq: str = "seq") -> DataFrame:
    """Changes at or after a position (the filter reaches the scan)."""
    return log.where(F.col(seq) >= start)


def subscribe(groups: DataFrame, log: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """Start positions of groups at the moment of subscribing: (group, start_seq).

    ``groups`` holds (group, start_seq); a group without a position starts "from now", after the last change that ``log``
    holds. Keep the result: read anew later, "now" would be another one.
    """
    now = log.agg(F.coalesce(F.max(seq) + 1, F.lit(0)).cast("bigint").alias("__now"))
    return groups.crossJoin(F.broadcast(now)).select(group, F.coalesce("start_seq", "__now").alias("start_seq"))  # one row


def replay_groups(log: DataFrame, starts: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """Changes of each group from its start position on (batch or stream); other groups get none.

    ``starts`` holds (group, start_seq), one row per group, as ``subscribe`` makes it.
    """
    joined = log.join(checked_broadcast(starts.select(group, "start_seq")), group)
    return joined.where(F.col(seq) >= F.col("start_seq")).drop("start_seq")


def position_at(log: DataFrame, when: Column, ts: str = "op_ts", seq: str = "seq") -> DataFrame:
    """One row: the last position committed at or before a time."""
    return log.where(F.col(ts) <= when).agg(F.max_by(seq, F.struct(ts, seq)).alias("position"))


def positions_at(
    log: DataFrame,
    times: DataFrame,
    keys: list[str],
    ts: str = "op_ts",
    seq: str = "seq",
    guard: SkewGuard = SkewGuard(),
) -> DataFrame:
    """As-of join: the last position of the key at or before each requested time.

    Both inputs become one ordered stream per key and the position is filled
    forward, so nothing is paired and the inputs are shuffled once.
    """
    known = log.select(*keys, F.col(ts).alias("__at"), F.lit(0).alias("__ask"), F.col(seq).alias("__tie"))
    asked = times.select(*keys, F.col(ts).alias("__at"), F.lit(1).alias("__ask"), F.lit(None).cast("bigint").alias("__tie"))
    merged = known.unionByName(asked)
    rows = OrderedRows(merged, keys, ["__at", "__ask", "__tie"], guard)
    filled = rows.last_known({"position": F.when(F.col("__ask") == 0, F.col("__tie"))}).frame()
    return filled.where("__ask = 1").select(*keys, F.col("__at").alias(ts), "position")
